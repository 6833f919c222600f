"""Schemas that drift between the files of a feed: every change reported, all files in one table.

Each file's schema is a graph: fields with their names, their types and their places in one another
are its nodes and edges. The graphs of two consecutive files are matched by similarity flooding: pairs
of fields and pairs of types start with a score from names, types and the share of equal values, and
pass it along the edges that both graphs have (to the pair of their parents, of their children and of
their types) until the scores settle. Of the settled scores a consistent set of correspondences is
taken, best first, one to one.

``changes`` reports what the definition of a rename asks for: of the correspondences only those under
one parent whose values an exact count confirms. ``one_table`` follows all correspondences, also
those between levels and between files that have no records in common, and drops nothing: what does
not fit the type of its column is kept as text beside it.

The records are read twice, once for the inventory of fields, counted within a task before the
shuffle, and once for the values of the few fields that are gone or new. Only schemas, never records,
reach a Python function as a whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.session import cut, rows_up_to

KINDS = {str: "string", int: "number", float: "number", bool: "boolean", dict: "object", list: "array"}
TYPES = ("string", "number", "boolean", "object", "array")
#: How alike two types are that are often exchanged for one another; equal types are 1, others 0.
KIN = {("string", "number"): 0.5, ("array", "object"): 0.6, ("string", "boolean"): 0.3, ("string", "array"): 0.3}
#: Settled score, as a share of the best, from which a pair without common records corresponds.
LEAST_SCORE = 0.45
#: Files for which a list of fields is broadcast; beyond, the lines are joined by a shuffle.
MOST_FILES = 20_000


_NUMBER = re.compile(r"\s*[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?\s*")


class _Number(str):
    """A number by its text."""


def _parse(payload: str | None) -> dict | None:
    try:
        value = json.loads(payload or "null", parse_int=_Number, parse_float=_Number)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _kind(value: object) -> str:
    return "number" if isinstance(value, _Number) else KINDS[type(value)]


def _text(value: object, kind: str) -> str:
    if kind in ("object", "array"):
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return ("true" if value else "false") if kind == "boolean" else str(value)


def _walk(value: dict, prefix: str, out: dict[str, list[tuple[str, object]]]) -> None:
    for k, v in value.items():
        if v is None:
            continue
        path = f"{prefix}.{k}" if prefix else k
        kind = _kind(v)
        out.setdefault(path, []).append((kind, v))
        for inner in [v] if kind == "object" else v if kind == "array" else []:
            if isinstance(inner, dict):
                _walk(inner, path, out)


def record_fields(payload: str | None) -> list[tuple[str, str, str]]:
    """``(path, kind, text)`` of each field of one JSON record that is not null; a field met several
    times, in an array of objects, has its texts one after the other. No object, no fields."""
    value, out = _parse(payload), {}
    if value is None:
        return []
    _walk(value, "", out)
    return [(p, x[0][0], "\u0001".join(_text(v, k) for k, v in x)) for p, x in out.items()]


def inventory(lines: DataFrame) -> DataFrame:
    """``(feed, file_name, path, kind, n, words)``: the fields of each file, the kind that most records have, their number, and
    that of records with a text that is no number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for feed, name, payload in zip(pdf["feed"], pdf["file_name"], pdf["payload"]):
                value, out = _parse(payload), {}
                if value is not None:
                    _walk(value, "", out)
                seen.update((feed, name, p, x[0][0], any(k == "string" and not _NUMBER.fullmatch(v) for k, v in x)) for p, x in out.items())
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feed", "file_name", "path", "kind", "words", "n"])

    raw = lines.select("feed", "file_name", "payload").mapInPandas(count, "feed string, file_name string, path string, kind string, words boolean, n bigint")
    n = raw.groupBy("feed", "file_name", "path", "kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("words"), F.col("n")).otherwise(0)).alias("words"))
    return n.groupBy("feed", "file_name", "path").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"), F.sum("n").alias("n"), F.sum("words").alias("words"))


def file_order(lines: DataFrame) -> DataFrame:
    """``(feed, file_name, before, seq)``: the file of the same feed written just before (null for the first)."""
    files = lines.groupBy("feed", "file_name").agg(F.min("written_at").alias("at"))
    w = Window.partitionBy("feed").orderBy("at", "file_name")
    return files.select("feed", "file_name", F.lag("file_name").over(w).alias("before"), F.row_number().over(w).alias("seq"))


@lru_cache(maxsize=100_000)
def name_similarity(a: str, b: str) -> float:
    """How alike two field names are, apart from case, separators and clipped words."""
    x, y = (" ".join(re.findall(r"[a-z]+|\d+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s).lower())) for s in (a, b))
    if x.replace(" ", "") == y.replace(" ", ""):
        return 1.0
    if " " not in x + y and min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)):
        return 0.95
    p, q = set(x.split()), set(y.split())
    words = len(p & q) / max(1, min(len(p), len(q)))
    return max(SequenceMatcher(None, x, y).ratio(), 0.8 * words)


def _up(path: str) -> str:
    return path.rpartition(".")[0]


def _graph(fields: dict[str, str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (the root first), each node's parent, the number of children, and its type as a unit row."""
    nodes = ["", *sorted(fields)]
    at = {p: i for i, p in enumerate(nodes)}
    parent = np.array([0, *[at.get(_up(p), 0) for p in nodes[1:]]])
    types = np.zeros((len(nodes), len(TYPES)))
    for p, i in at.items():
        types[i, TYPES.index(fields.get(p, "object"))] = 1.0
    return nodes, parent, np.bincount(parent[1:], minlength=len(nodes)), types


def flood(old: dict[str, str], new: dict[str, str], shared: dict[tuple[str, str], float], rounds: int = 200, eps: float = 1e-4) -> dict[tuple[str, str], float]:
    """Settled scores, the best 1, of all pairs of fields (path to kind) of two schemas.

    ``shared`` has the share of equal values for pairs where it is known. In each round a pair gets its own start
    and score and those of its neighbours: a pair of parents gives to each pair of children an equal part and gets
    from them the mean; a pair of types gives to and gets from the pairs of fields that have them in the same way.
    """
    (a_nodes, a_up, a_kids, a_types), (b_nodes, b_up, b_kids, b_types) = _graph(old), _graph(new)
    start = np.zeros((len(a_nodes), len(b_nodes)))
    start[0, 0] = 1.0
    for i, a in enumerate(a_nodes[1:], 1):
        for j, b in enumerate(b_nodes[1:], 1):
            value = shared.get((a, b))
            name = 1.0 if a == b else 0.8 * name_similarity(a.rpartition(".")[2], b.rpartition(".")[2]) + 0.1 * name_similarity(a, b)
            start[i, j] = name if value is None else 0.4 * name + 0.6 * value
    t_start = np.eye(len(TYPES))
    for (x, y), s in KIN.items():
        t_start[TYPES.index(x), TYPES.index(y)] = t_start[TYPES.index(y), TYPES.index(x)] = s
    share_down = 1.0 / np.maximum(np.sqrt(np.outer(a_kids, b_kids)), 1.0)
    share_up = 1.0 / np.maximum(np.maximum.outer(a_kids, b_kids), 1.0)
    a_in, b_in = np.zeros((len(a_nodes),) * 2), np.zeros((len(b_nodes),) * 2)
    a_in[np.arange(1, len(a_nodes)), a_up[1:]] = 1.0
    b_in[np.arange(1, len(b_nodes)), b_up[1:]] = 1.0
    of_type = np.maximum(np.outer(a_types.sum(axis=0), b_types.sum(axis=0)), 1.0)
    score, types = start.copy(), t_start.copy()
    for _ in range(rounds):
        s, t = start + score, t_start + types
        now = s + a_in @ (s * share_down) @ b_in.T + (a_in.T @ s @ b_in) * share_up + 0.5 * a_types @ t @ b_types.T
        types = t + a_types.T @ s @ b_types / of_type
        now /= now[1:, 1:].max(initial=0.0) or 1.0
        types /= types.max()
        moved = float(np.sqrt(((now - score) ** 2).sum()))
        score = now
        if moved < eps:
            break
    return {(a, b): float(score[i, j]) for i, a in enumerate(a_nodes) for j, b in enumerate(b_nodes) if i and j}


def correspondences(old: dict[str, str], new: dict[str, str], shared: dict[tuple[str, str], float], exact: bool = False, least: float = LEAST_SCORE) -> list[tuple[str, str, float]]:
    """A one-to-one choice of pairs, best score first; fields of the same path belong together.

    ``exact``: only pairs under one parent with more than half of their values equal. Otherwise a pair needs the score
    ``least``, and more than half of its values equal or a name that is alike; where no values are known it may also be the
    only field of its type that is gone and the only one that is new under its parent.
    """
    gone, come = set(old) - set(new), set(new) - set(old)
    same = [(p, p, 1.0) for p in sorted(set(old) & set(new))]
    if not gone or not come:
        return same
    score = flood(old, new, shared)
    lone = [c for side, kind in ((gone, old), (come, new)) for c in [Counter((_up(p), kind[p]) for p in side)]]
    out, left, right = [], set(gone), set(come)
    for s, a, b in sorted(((-score[a, b], a, b) for a in gone for b in come)):
        if a in left and b in right:
            share = shared.get((a, b))
            alike = name_similarity(a.rpartition(".")[2], b.rpartition(".")[2])
            only = share is None and _up(a) == _up(b) and lone[0][_up(a), old[a]] == lone[1][_up(a), old[a]] == 1 and old[a] == new[b]
            good = (share or 0.0) > 0.5 and _up(a) == _up(b) if exact else -s >= least and (only or (share or 0.0) > 0.5 or alike >= (0.7 if share is None else 0.9))
            if good:
                left.discard(a)
                right.discard(b)
                out.append((a, b, -s))
    return same + out


def _lists(lines: DataFrame, per_file: DataFrame) -> DataFrame:
    """Lines with what ``per_file(feed, file_name, wanted)`` lists for their file."""
    small = rows_up_to(per_file, MOST_FILES) is not None
    return lines.join(F.broadcast(per_file) if small else per_file, ["feed", "file_name"])


def _schemas(lines: DataFrame, inv: DataFrame) -> DataFrame:
    """One row per file that has one before it: ``(feed, file_name, before, seq, fields)`` with both kinds of each field."""
    follow = file_order(lines).where("before is not null")
    now = follow.join(inv, ["feed", "file_name"]).select("feed", "file_name", "before", "seq", "path", F.lit(None).cast("string").alias("was"), F.col("kind").alias("is"))
    then = follow.join(inv.withColumnRenamed("file_name", "before"), ["feed", "before"]).select("feed", "file_name", "before", "seq", "path", F.col("kind").alias("was"), F.lit(None).cast("string").alias("is"))
    both = now.unionByName(then).groupBy("feed", "file_name", "before", "seq", "path").agg(F.max("was").alias("was"), F.max("is").alias("is"))
    return both.groupBy("feed", "file_name", "before", "seq").agg(F.array_sort(F.collect_list(F.struct("path", "was", "is"))).alias("fields"))  # as long as the schemas


def _shares(lines: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(feed, file_name, shares)``: for each gone and each new field of a file, the share of common records with equal values."""
    hard = schemas.where(F.exists("fields", lambda x: x["is"].isNull()) & F.exists("fields", lambda x: x["was"].isNull()))
    pick = lambda test, role: F.transform(F.filter("fields", test), lambda x: F.struct(F.col("file_name").alias("target"), F.lit(role).alias("role"), x["path"].alias("path")))
    gone = hard.select("feed", F.col("before").alias("name"), pick(lambda x: x["is"].isNull(), "old").alias("wanted"))
    come = hard.select("feed", F.col("file_name").alias("name"), pick(lambda x: x["was"].isNull(), "new").alias("wanted"))
    wanted = cut(gone.unionByName(come).groupBy("feed", F.col("name").alias("file_name")).agg(F.flatten(F.collect_list("wanted")).alias("wanted")))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for feed, key, no, line, payload, want in zip(pdf["feed"], pdf["rec_key"], pdf["line_no"], pdf["line_id"], pdf["payload"], pdf["wanted"]):
                texts = {p: t for p, _, t in record_fields(payload)}
                rows += [(feed, x["target"], x["role"], x["path"], key, no, line, blake2b(texts[x["path"]].encode("utf-8", "surrogatepass"), digest_size=16).digest()) for x in want if x["path"] in texts]
            yield pd.DataFrame(rows, columns=["feed", "file_name", "role", "path", "rec_key", "line_no", "line_id", "value"])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = f"feed string, file_name string, role string, path string, rec_key {kinds['rec_key']}, line_no {kinds['line_no']}, line_id {kinds['line_id']}, value binary"
    found = _lists(lines.where("rec_key is not null").select("feed", "file_name", "rec_key", "line_no", "line_id", "payload"), wanted).mapInPandas(values, schema)
    last = found.groupBy("feed", "file_name", "role", "path", "rec_key").agg(F.max_by("value", F.struct("line_no", "line_id")).alias("value"))
    per_record = last.groupBy("feed", "file_name", "rec_key").agg(F.collect_list(F.when(F.col("role") == "old", F.struct("path", "value"))).alias("old"), F.collect_list(F.when(F.col("role") == "new", F.struct("path", "value"))).alias("new"))
    met = per_record.select("feed", "file_name", F.explode("old").alias("o"), "new").select("feed", "file_name", "o", F.explode("new").alias("n"))  # as many as gone and new fields
    share = met.groupBy("feed", "file_name", F.col("o.path").alias("old"), F.col("n.path").alias("new")).agg(F.avg((F.col("o.value") == F.col("n.value")).cast("double")).alias("share"))
    return share.groupBy("feed", "file_name").agg(F.collect_list(F.struct("old", "new", "share")).alias("shares"))


def _matched(lines: DataFrame, inv: DataFrame, exact: bool) -> DataFrame:
    """``(feed, file_name, seq, change_kind, field_path, new_path)``; without ``exact`` also of every field that stays or moves."""
    schemas = cut(_schemas(lines, inv))
    rows = schemas.join(_shares(lines, schemas), ["feed", "file_name"], "left").select("feed", "file_name", "seq", "fields", "shares")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for feed, name, seq, fields, shares in zip(pdf["feed"], pdf["file_name"], pdf["seq"], pdf["fields"], pdf["shares"]):
                old = {x["path"]: x["was"] for x in fields if x["was"] is not None}
                new = {x["path"]: x["is"] for x in fields if x["is"] is not None}
                shared = {(x["old"], x["new"]): x["share"] for x in (shares if shares is not None else [])}
                gone, come = set(old) - set(new), set(new) - set(old)
                for a, b, _ in correspondences(old, new, shared, exact):
                    if a != b:
                        out.append((feed, name, seq, "renamed", a, b))
                        gone.discard(a)
                        come.discard(b)
                    if old[a] != new[b]:
                        out.append((feed, name, seq, "retyped", b, ""))
                out += [(feed, name, seq, "removed", a, "") for a in sorted(gone)] + [(feed, name, seq, "added", b, "") for b in sorted(come)]
            yield pd.DataFrame(out, columns=["feed", "file_name", "seq", "change_kind", "field_path", "new_path"])

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a pair takes long for its few bytes, so tasks must not be put together by size
    return rows.repartition(n, F.xxhash64("file_name", "feed")).mapInPandas(match, "feed string, file_name string, seq int, change_kind string, field_path string, new_path string")


def changes(lines: DataFrame) -> DataFrame:
    """``(feed, file_name, change_kind, field_path, new_path)``: what each file changes against the one before.

    Lines that hold no JSON object add no fields; a feed's first file has no changes; a record
    written twice in a file counts by its last line; records without a key match none.
    """
    return _matched(lines, cut(inventory(lines)), True).drop("seq")


def canonical_paths(lines: DataFrame, inv: DataFrame) -> DataFrame:
    """``(feed, file_name, path, canonical)``: each file's fields under one name, the one that most records of all feeds have.

    Correspondences are followed from file to file; a field that comes back under an earlier name of a chain is that chain's.
    """
    order = file_order(lines).select("feed", "file_name", "seq")
    ren = _matched(lines, inv, False).where("change_kind = 'renamed'").select("feed", "file_name", "seq", F.col("field_path").alias("path"), "new_path")
    own = inv.join(order, ["feed", "file_name"]).select("feed", "file_name", "seq", "path", F.lit(None).cast("string").alias("new_path"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        group: dict[str, int] = {}
        size, rows = 0, []
        for (_, name), part in pdf.groupby(["seq", "file_name"], sort=True):
            here = part.loc[part["new_path"].isna(), "path"].tolist()
            moves = [(a, b) for a, b in part.loc[part["new_path"].notna(), ["path", "new_path"]].itertuples(index=False) if a in group]
            group |= dict([(b, group[a]) for a, b in moves])  # a moved field's old name stays with its chain
            taken: dict[int, str] = {}
            for p in sorted(here, key=lambda p: p not in {b for _, b in moves}):
                if p not in group or group[p] in taken:
                    group[p] = size
                    size += 1
                taken[group[p]] = p
                rows.append((name, p, group[p]))
        return pd.DataFrame([(pdf["feed"].iloc[0], *r) for r in rows], columns=["feed", "file_name", "path", "chain"])

    chains = cut(own.unionByName(ren).groupBy("feed").applyInPandas(chain, "feed string, file_name string, path string, chain int"))
    often = inv.groupBy("path").agg(F.sum("n").alias("n"))
    names = chains.select("feed", "chain", "path").distinct().join(often, "path").groupBy("feed", "chain").agg(F.max_by("path", F.struct("n", "path")).alias("canonical"))
    clash = names.withColumn("_r", F.row_number().over(Window.partitionBy("feed", F.lower("canonical")).orderBy("canonical", "chain")))
    return chains.join(clash.select("feed", "chain", F.when(F.col("_r") > 1, F.concat("canonical", F.lit("_"), F.col("_r"))).otherwise(F.col("canonical")).alias("canonical")), ["feed", "chain"]).drop("chain")


def merged_kinds(kinds: dict[str, dict[str, tuple[str, int]]], least: float = 0.8) -> dict[str, dict[str, str]]:
    """One schema for several (name to path to kind and number of records): for each, its paths under the common ones.

    The schema with most records comes first; each other one is flooded against what is there, and only pairs with the same
    name at the end, or the same words in order along the path, are taken; the rest is added.
    """
    whole: dict[str, str] = {}
    out: dict[str, dict[str, str]] = {}
    words = lambda p: re.sub(r"[^a-z0-9]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", p).lower()).split()
    for name in sorted(kinds, key=lambda k: (-sum(n for _, n in kinds[k].values()), k)):
        own = {p: k for p, (k, _) in kinds[name].items()}
        pairs = correspondences(own, whole, {}, least=0.3) if whole else []
        to = {a: b for a, b, s in pairs if a == b or words(a) == words(b) and s >= 0.3}
        lower = {p.lower(): p for p in whole}
        out[name] = {p: to.get(p, lower.get(p.lower(), p)) for p in own}
        whole |= {q: own[p] for p, q in out[name].items() if q not in whole}
    return out


def _place(root: dict, path: list[str], value: object) -> None:
    """Put a value at a path from the root, into each object of an array on the way."""
    head, rest = path[0], path[1:]
    if not rest:
        root.setdefault(head, value)
        return
    inner = root.setdefault(head, {})
    for x in [inner] if isinstance(inner, dict) else [y for y in inner if isinstance(y, dict)] if isinstance(inner, list) else []:
        _place(x, rest, value)


def _renamed(value: dict, prefix: str, names: dict[str, str], late: list[tuple[list[str], object]]) -> dict:
    """A record with its fields under their canonical names; fields that moved to another level are put there last."""
    out: dict = {}
    base = names.get(prefix, prefix)
    for k, v in value.items():
        if v is None:
            continue
        path = f"{prefix}.{k}" if prefix else k
        to = names.get(path, path)
        kind = _kind(v)
        if kind == "object":
            v = _renamed(v, path, names, late)
        elif kind == "array":
            v = [_renamed(x, path, names, late) if isinstance(x, dict) else x for x in v]
        if _up(to) == base:
            out.setdefault(to.rpartition(".")[2], v)
        else:
            late.append((to.split("."), v))
    return out


def _fitted(value: object, node: dict, path: str, lost: dict[str, str]) -> object:
    """A value in the form that its column has; what does not fit goes to ``lost`` under its path."""
    kind, want = _kind(value), node["kind"]
    if node["fields"]:
        many = [x for x in (value if kind == "array" else [value]) if isinstance(x, dict)]
        if kind not in ("array", "object") or kind == "array" and len(many) < len(value) or want == "object" and len(many) > 1:
            lost[path] = _text(value, kind)
        made = []
        for x in many:
            low = {f.lower(): f for f in node["fields"]}
            made.append({low[k.lower()]: _fitted(v, node["fields"][low[k.lower()]], f"{path}.{k}", lost) for k, v in x.items() if k.lower() in low})
        return made if want == "array" else made[0] if made else None
    if kind == "array" and want != "array" and len(value) == 1 and not isinstance(value[0], (dict, list)) and value[0] is not None:
        value, kind = value[0], _kind(value[0])
    if want == "array":
        return [x if x is None else _text(x, _kind(x)) for x in (value if kind == "array" else [value])]
    if want == "string":
        return _text(value, kind)
    if want == "number":
        try:
            number = float(_text(value, kind)) if kind in ("number", "string") else None
        except ValueError:
            number = None
        if number is None or number != number or abs(number) == float("inf"):
            lost[path] = _text(value, kind)
            return None
        return number
    if kind != want:
        lost[path] = _text(value, kind)
        return None
    return value


def _tree(kinds: dict[str, str]) -> dict:
    """Nested nodes ``{kind, fields}`` of canonical paths."""
    root: dict = {"kind": "object", "fields": {}}
    for path in sorted(kinds):
        at = root
        for part in path.split("."):
            at = at["fields"].setdefault(part, {"kind": "object", "fields": {}})
        at["kind"] = kinds[path]
    return root


def _type(node: dict) -> T.DataType:
    if node["fields"]:
        inner = T.StructType([T.StructField(n, _type(x)) for n, x in node["fields"].items()])
        return T.ArrayType(inner) if node["kind"] == "array" else inner
    return {"number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}.get(node["kind"], T.StringType())


def one_table(lines: DataFrame) -> DataFrame:
    """All lines in one table: ``(line_id, feed, export_kind, file_name, rec_key, record, unfitted)``.

    ``record`` has every field of every file under one name and type, nested as most records nest it; nothing is left out.
    A field has the type that most records give it (a number if all its texts are numbers and some values are; an array, where some
    have one object and others several); a list of one value becomes that value where others have a value, and numbers written as text become numbers. A value that cannot take
    its column's type, or a payload that is no JSON object, is in the map ``unfitted`` as text, by its path ('' for a payload).
    The fields, never the records, are collected.
    """
    inv = cut(inventory(lines))
    names = cut(canonical_paths(lines, inv))
    kind_of = lines.groupBy("feed", "file_name").agg(F.max("export_kind").alias("export_kind"))
    counted = inv.join(names, ["feed", "file_name", "path"]).join(kind_of, ["feed", "file_name"]).groupBy("export_kind", "canonical", "kind").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    found: dict[str, dict[str, Counter]] = {}
    words: Counter = Counter()
    for r in counted.collect():  # one row per kind of export, field and type
        words[r["export_kind"] or "", r["canonical"]] += r["words"]
        found.setdefault(r["export_kind"] or "", {}).setdefault(r["canonical"], Counter())[r["kind"]] += r["n"]
    top = lambda c: min(c, key=lambda k: (-c[k], k))
    merged = merged_kinds({e: {p: (top(c), sum(c.values())) for p, c in fields.items()} for e, fields in found.items()})
    totals: dict[str, Counter] = {}
    texts: Counter = Counter()
    for e, fields in found.items():
        for p, c in fields.items():
            totals.setdefault(merged[e][p], Counter()).update(c)
            texts[merged[e][p]] += words[e, p]
    for p, c in totals.items():
        if c["number"] and not texts[p]:
            c["number"] += c.pop("string", 0)  # all its texts are numbers
    parents = {_up(p) for p in totals}
    kinds = {p: ("array" if "array" in c else "object") if p in parents and (c["array"] or c["object"]) else top(c) for p, c in totals.items()}
    tree = _tree(kinds)
    per_file = names.groupBy("feed", "file_name").agg(F.collect_list(F.struct("path", "canonical")).alias("wanted"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            records, rest, known = [], [], {}
            for feed, name, export, payload, wanted in zip(pdf["feed"], pdf["file_name"], pdf["export_kind"], pdf["payload"], pdf["wanted"]):
                value, lost = _parse(payload), {}
                if value is None:
                    records.append(None)
                    rest.append({"": payload} if payload is not None else {})
                    continue
                if (feed, name, export) not in known:
                    known[feed, name, export] = {x["path"]: merged.get(export or "", {}).get(x["canonical"], x["canonical"]) for x in (wanted if wanted is not None else [])}
                late: list[tuple[list[str], object]] = []
                made = _renamed(value, "", known[feed, name, export], late)
                for path, v in late:
                    _place(made, path, v)
                records.append(json.dumps(_fitted(made, tree, "", lost), ensure_ascii=False))
                rest.append({k.removeprefix("."): v for k, v in lost.items()})
            yield pdf[["line_id", "feed", "export_kind", "file_name", "rec_key"]].assign(record=records, unfitted=rest)

    kinds_of = {f.name: f.dataType.simpleString() for f in lines.schema}
    cols = ["line_id", "feed", "export_kind", "file_name", "rec_key"]
    small = rows_up_to(per_file, MOST_FILES) is not None
    joined = lines.select(*cols, "payload").join(F.broadcast(per_file) if small else per_file, ["feed", "file_name"], "left")
    out = joined.select(*cols, "payload", "wanted").mapInPandas(read, ", ".join(f"{c} {kinds_of[c]}" for c in cols) + ", record string, unfitted map<string,string>")
    record = F.from_json("record", _type(tree)) if tree["fields"] else F.lit(None).cast("struct<none:string>")
    return out.select(*cols, record.alias("record"), "unfitted")
