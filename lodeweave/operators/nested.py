"""Deeply nested records turned into flat tables that keep parent and position.

All in the JVM and without a shuffle: nested ``transform`` calls attach the keys and places of the
ancestors, ``flatten`` joins the arrays of one level, and ``inline`` emits the rows.

Parts may be absent, null, empty, a single object where an array is meant, or JSON inside a string;
such strings are opened at any level. What cannot be read as an object or an array gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHILD = "array<struct<path:string,parent_pos:int,pos:int,child_key:string,body:string>>"


@dataclass(frozen=True)
class Node:
    """An object or an array of objects in a record: where it is, the key of its objects, what is in them."""

    name: str
    key: str | None = None
    children: tuple[Node, ...] = field(default=())
    emit: bool = True


LAYER10 = (
    Node("validation_report", emit=False, children=(Node("issues", "issue_id"),)),
    Node(
        "reasoning_report",
        emit=False,
        children=(Node("inferred_triples", "triple_id", (Node("provenance", "chunk_id"),)), Node("inferred_general_axioms", "axiom_id")),
    ),
)
LAYER11 = (
    Node("completed_triple", "triple_id", (Node("provenance", "chunk_id"),)),
    Node("completed_axiom", "axiom_id", (Node("evidence", "chunk_id"),)),
    Node("evidence", "chunk_id"),
)


def opened(text: Column) -> Column:
    """JSON text; JSON inside a JSON string is taken out of it (twice at most)."""
    out = text
    for _ in range(2):
        inner = F.from_json(F.concat(F.lit('{"x":'), out, F.lit("}")), "x string")["x"]
        out = F.when(F.ltrim(out).startswith('"'), inner).otherwise(out)
    return F.ltrim(out)


def members(body: Column, names: list[str]) -> Column:
    """Some members of a JSON object, each as JSON text (a string without its quotes)."""
    return F.from_json(body, ", ".join(f"`{n}` string" for n in names))


def objects(text: Column) -> Column:
    """The elements of a JSON array, or a single object as an array of one; null if it is neither."""
    t = opened(text)
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t.startswith("{"), F.array(t))


def _none() -> Column:
    return F.array().cast(CHILD)


def _rows(node: Node, parsed: Column, prefix: str, parent_pos: Column) -> list[Column]:
    """One array of rows for this node and each node inside it."""
    path = f"{prefix}.{node.name}" if prefix else node.name
    if not node.emit:
        inner = members(opened(parsed[node.name]), [c.name for c in node.children])
        return [x for c in node.children for x in _rows(c, inner, path, parent_pos)]
    items = F.coalesce(objects(parsed[node.name]), F.array().cast("array<string>"))
    wanted = [*([node.key] if node.key else []), *(c.name for c in node.children)]

    def place(item: Column, i: Column) -> Column:
        body = opened(item)
        return F.struct(body.alias("body"), i.cast("int").alias("pos"), members(body, wanted).alias("m"))

    placed = F.filter(F.transform(items, place), lambda x: x["body"].startswith("{"))
    own = F.transform(
        placed,
        lambda x: F.struct(
            F.lit(path).alias("path"), parent_pos.alias("parent_pos"), x["pos"].alias("pos"), F.coalesce(x["m"][node.key] if node.key else F.lit(""), F.lit("")).alias("child_key"), x["body"].alias("body")
        ),
    )
    under = lambda c: lambda x: F.concat(*_rows(c, x["m"], path, x["pos"]))
    deeper = [F.flatten(F.transform(placed, under(c))) for c in node.children]
    return [own.cast(CHILD), *[F.coalesce(d.cast(CHILD), _none()) for d in deeper]]


def flatten_json(df: DataFrame, id_col: str, payload: str, nodes: tuple[Node, ...], keep_body: bool = False) -> DataFrame:
    """``(id, path, parent_pos, pos, child_key[, body])``: a row for each object that is not null at a node.

    pos is the place in its array from 0 with nulls counted, 0 outside an array; parent_pos is the pos
    of the object around it, -1 for the record; child_key is '' where the key is missing.
    """
    top = members(opened(F.col(payload)), [n.name for n in nodes])
    arrays = [x for n in nodes for x in _rows(n, F.col("_top"), "", F.lit(-1))]
    out = df.select(F.col(id_col), top.alias("_top")).select(F.col(id_col), F.inline(F.concat(*arrays)))
    return out if keep_body else out.drop("body")


def flatten_typed(df: DataFrame, id_col: str, nodes: tuple[Node, ...]) -> DataFrame:
    """The same for typed struct and array columns; columns that a table lacks give no rows."""
    row = "array<struct<path:string,parent_pos:int,pos:int,child_key:string>>"

    def rows(node: Node, value: Column, kind, prefix: str, parent_pos: Column) -> list[Column]:
        path = f"{prefix}.{node.name}" if prefix else node.name
        is_array = kind.typeName() == "array"
        items = value if is_array else F.array(value)
        struct = kind.elementType if is_array else kind
        placed = F.filter(F.transform(items, lambda x, i: F.struct(x.alias("v"), i.cast("int").alias("pos"))), lambda x: x["v"].isNotNull())
        own = F.transform(
            placed,
            lambda x: F.struct(
                F.lit(path).alias("path"), parent_pos.alias("parent_pos"), x["pos"].alias("pos"), F.coalesce(x["v"][node.key] if node.key in struct.names else F.lit(""), F.lit("")).alias("child_key")
            ),
        )
        out = [F.coalesce(own.cast(row), F.array().cast(row))]
        for c in node.children:
            if c.name in struct.names:
                inner = F.flatten(F.transform(placed, under(c, struct, path)))
                out.append(F.coalesce(inner.cast(row), F.array().cast(row)))
        return out

    def under(c: Node, struct, path: str):
        return lambda x: F.concat(*rows(c, x["v"][c.name], struct[c.name].dataType, path, x["pos"]))

    arrays = [x for n in nodes if n.name in df.columns for x in rows(n, F.col(n.name), df.schema[n.name].dataType, "", F.lit(-1))]
    return df.select(F.col(id_col), F.inline(F.concat(*arrays)))


def layer10_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of the layer 10 reports: issues, triples, provenance and axioms, each with rec_id,
    parent_pos and pos; a table is one ``inline`` over its own branch, so only that branch is read."""
    out = {}
    shapes = {
        "issues": ((LAYER10[0],), "validation_report.issues", "issue_id string, issue_type string, severity string, message string, related_ids array<string>"),
        "triples": (
            (LAYER10[1],), "reasoning_report.inferred_triples",
            "triple_id string, subject_id string, subject_label string, predicate_label string, object_label string, chunk_id string, confidence double",
        ),
        "provenance": ((LAYER10[1],), "reasoning_report.inferred_triples.provenance", "chunk_id string, chunk_start_char int, snippet string"),
        "axioms": ((LAYER10[1],), "reasoning_report.inferred_general_axioms", "axiom_id string, axiom_type string, subject_label string"),
    }
    for name, (nodes, path, schema) in shapes.items():
        flat = flatten_json(df, "rec_id", "payload", nodes, keep_body=True).where(F.col("path") == path)
        out[name] = flat.select("rec_id", "parent_pos", "pos", F.from_json("body", schema).alias("x")).select("rec_id", "parent_pos", "pos", "x.*")
    return out
