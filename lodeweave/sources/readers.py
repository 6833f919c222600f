"""Readers of documents, gold data, graphs and ontologies."""

from __future__ import annotations

import ast
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF_SCHEMA = "s string, p string, o string, o_is_literal boolean"
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def binary_pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]]) -> DataFrame:
    """``(doc_id, path, page, text, error)`` of binary files; ``decode`` turns a file into pages. A file that fails is a row with an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(p, i, t, None) for i, t in enumerate(decode(content), 1)]
                except Exception as x:  # a broken file is data
                    out.append((p, None, None, str(x)[:500]))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"])

    got = files.mapInPandas(pages, "path string, page int, text string, error string")
    return got.withColumn("doc_id", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))


def blocks(pages: DataFrame) -> DataFrame:
    """Ordered text blocks of pages."""
    return pages.where("trim(text) <> ''").select(
        "doc_id", F.format_string("block_%05d", F.col("page")).alias("block_id"), F.lit("text").alias("type"), "page", F.col("page").alias("order"), F.col("doc_id").alias("document_key"),
        F.lit(None).cast("string").alias("section_key"), F.lit(None).cast("string").alias("subsection_key"), F.lit(None).cast("string").alias("title"), "text", F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("html_text"),
    )


def table_blocks(blocks_: DataFrame) -> DataFrame:
    return blocks_.where("type = 'table' and html is not null").select("doc_id", "page", "block_id", "html")


def _first(obj: Column, *names: str) -> Column:
    """The first of several fields of a JSON text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(obj, f"$.{n}")), F.lit("")) for n in names])


def benchmark_records(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """``(document_id, title, text, type, entities, relations)`` of a JSON-lines benchmark; lines are kept as JSON text inside."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    out = raw.select(
        _first(F.col("value"), "document_id", "doc_id", "id").alias("document_id"), _first(F.col("value"), "title").alias("title"), _first(F.col("value"), "text", "document").alias("text"),
        _first(F.col("value"), "type", "split").alias("type"), F.get_json_object("value", "$.entities").alias("entities"), F.get_json_object("value", "$.relations").alias("relations"),
    )
    return by_type(out, kinds)


def by_type(df: DataFrame, kinds: str | list[str] | None) -> DataFrame:
    """Rows of some types; None and "all" keep every row."""
    wanted = [kinds] if isinstance(kinds, str) else list(kinds or [])
    return df if not wanted or "all" in wanted else df.where(F.col("type").isin(*wanted))


def benchmark_entities(records: DataFrame) -> DataFrame:
    """``(document_id, id, type, mentions)`` from maps of entities."""
    m = F.from_json("entities", "map<string,struct<type:string,mentions:array<struct<trigger_word:string>>>>")
    return records.select("document_id", F.explode(m).alias("id", "e")).select("document_id", "id", F.col("e.type").alias("type"), F.col("e.mentions.trigger_word").alias("mentions"))


def benchmark_relations(records: DataFrame) -> DataFrame:
    """``(document_id, relation, head_id, tail_id)`` from maps of pairs."""
    m = F.from_json("relations", "map<string,array<array<string>>>")
    x = records.select("document_id", F.explode(m).alias("relation", "pairs")).select("document_id", "relation", F.explode("pairs").alias("p"))
    return x.select("document_id", "relation", F.try_element_at("p", F.lit(1)).alias("head_id"), F.try_element_at("p", F.lit(2)).alias("tail_id"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """``(document_id, parsed_ok, head, relation, tail, evidence)`` of prediction lines; a line without relations gives one row without them."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    rel = F.from_json(F.get_json_object("value", "$.prediction.relations"), "array<struct<head:string,relation:string,tail:string,evidence:string>>")
    ok = F.coalesce(F.get_json_object("value", "$.parsed_ok").cast("boolean"), F.lit(True))
    return raw.select(_first(F.col("value"), "document_id", "doc_id", "id").alias("document_id"), ok.alias("parsed_ok"), F.explode_outer(rel).alias("r")).select("document_id", "parsed_ok", "r.*")


def any_layout(df: DataFrame, text: str) -> DataFrame:
    """Triples of a JSON text that is a list, or an object with triples, relations, predictions or items.

    Ends may be labels or objects with a label; several names of the fields are understood.
    """
    t = F.ltrim(F.col(text))
    body = F.when(t.startswith("["), t).otherwise(F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in ("triples", "relations", "predictions", "items")]))
    item = df.select(*[c for c in df.columns if c != text], F.posexplode(F.from_json(body, "array<string>")).alias("ord", "x"))
    x = F.col("x")
    return item.select(
        *[c for c in item.columns if c != "x"],
        _first(x, "subject.label", "subject_label", "head", "source", "subject").alias("head"),
        _first(x, "predicate.label", "predicate_label", "relation", "predicate").alias("relation"),
        _first(x, "object.label", "object_label", "tail", "target", "object").alias("tail"),
        F.expr("try_cast(get_json_object(x, '$.confidence') AS double)").alias("confidence"), _first(x, "chunk_id").alias("chunk_id"), _first(x, "justification", "evidence").alias("evidence"),
    )


def triple_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, JSON or Parquet table of triples, its columns found by their usual names."""
    kind = path.rsplit(".", 1)[-1].lower()
    df = spark.read.csv(path, header=True) if kind == "csv" else spark.read.json(path) if kind in ("json", "jsonl") else spark.read.parquet(path)
    names = {c.lower(): c for c in df.columns}
    pick = lambda *ks: next((F.col(f"`{names[k]}`") for k in ks if k in names), F.lit(None).cast("string"))
    return df.select(
        pick("source", "subject", "head", "subject_label", "node 1").alias("head"), pick("relation", "predicate", "predicate_label").alias("relation"),
        pick("target", "object", "tail", "object_label", "node 2").alias("tail"), pick("confidence").alias("confidence"), pick("chunk_id").alias("chunk_id"),
    )


def flat_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Gold triples of a JSON list with the columns Node 1, RELATION, Node 2, Alarm No.: triples and the lookups derived from them."""
    g = spark.read.option("multiLine", True).json(path)
    t = g.select(F.trim("`Node 1`").alias("head"), F.upper(F.trim("RELATION")).alias("relation"), F.trim("`Node 2`").alias("tail"), F.col("`Alarm No.`").cast("string").alias("record_no"))
    anchor = F.when(F.col("relation") == "TRIGGERS", F.col("tail")).otherwise(F.col("head"))
    other = F.when(F.col("relation") == "TRIGGERS", F.col("head")).otherwise(F.col("tail"))
    return {
        "triples": t,
        "entities": t.select(F.col("head").alias("label")).unionByName(t.select(F.col("tail").alias("label"))).where("label <> ''").distinct(),
        "anchors": t.select(anchor.alias("anchor"), "record_no").distinct(),
        "lookup": t.select(anchor.alias("anchor"), "relation", other.alias("tail")).distinct(),
        "triggers": t.where("relation = 'TRIGGERS'").groupBy(F.col("tail").alias("anchor")).agg(F.array_sort(F.collect_set("head")).alias("causes")),
    }


def read_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Statements of N-Triples lines, blank nodes as ``_:name``; what is no statement (comments, blank lines) is left out."""
    node = r"(?:<([^>]*)>|(_:[^\s<>\"]+))"
    p = rf'^\s*{node}\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s<>"]*[^\s<>".])|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    c = F.col(column)
    part = lambda k: F.regexp_extract(c, p, k)
    lit = part(6)
    for a, b in (("\\\\", "\x00"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\x00", "\\")):
        lit = F.replace(lit, F.lit(a), F.lit(b))
    is_lit = c.rlike(rf'^\s*{node}\s+<[^>]*>\s+"')
    return lines.where(c.rlike(p)).select(F.concat(part(1), part(2)).alias("s"), part(3).alias("p"), F.when(is_lit, lit).otherwise(F.concat(part(4), part(5))).alias("o"), is_lit.alias("o_is_literal"))


_TURTLE = re.compile(
    r'''<[^>\s]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|@[A-Za-z][\w-]*|\^\^|#[^\n]*|[;,\[\]()]|\.(?=\s|$|[\]);,])|(?:[^\s;,\[\]()<>"#.^]|\.(?!\s|$|[\]);,]))+''', re.S
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
_RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def parse_turtle(text: str) -> list[tuple[str, str, str, bool]]:
    """Statements of Turtle: prefixes and bases (both spellings), ``a``, ``;``, ``,``, literals with language or type (which are left
    out), blank nodes by name or in brackets (``_:b0`` and so on), and collections as lists of ``rdf:first`` and ``rdf:rest``."""
    toks = [t for t in _TURTLE.findall(text) if not t.startswith("#")]
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str, bool]] = []
    at, blanks, base = 0, 0, ""

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:b{blanks - 1}"

    def peek() -> str:
        return toks[at] if at < len(toks) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return toks[at - 1] if at <= len(toks) else ""

    def iri(t: str) -> str:
        return urljoin(base, t[1:-1]) if base else t[1:-1]

    def term() -> tuple[str, bool]:
        t = take()
        if t == "[":
            s = fresh()
            statements(s, "]")
            take()
            return s, False
        if t == "(":
            items = []
            while peek() not in (")", ""):
                items.append(term())
            take()
            cells = [fresh() for _ in items]
            for k, (o, lit) in enumerate(items):
                out.append((cells[k], f"{_RDF_NS}first", o, lit))
                out.append((cells[k], f"{_RDF_NS}rest", cells[k + 1] if k + 1 < len(cells) else f"{_RDF_NS}nil", False))
            return (cells[0] if cells else f"{_RDF_NS}nil"), False
        if t.startswith("<"):
            return iri(t), False
        if t.startswith('"'):
            body = t[3:-3] if t.startswith('"""') and len(t) >= 6 else t[1:-1]
            if peek().startswith("@"):
                take()
            elif peek() == "^^":
                take()
                take()
            return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), body, flags=re.S), True
        if t == "a":
            return f"{_RDF_NS}type", False
        k, colon, v = t.partition(":")
        if colon and k in prefixes:
            return prefixes[k] + v, False
        return t, re.fullmatch(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?|true|false", t) is not None

    def statements(s: str, end: str) -> None:
        while peek() not in (end, "."):
            if peek() == "":
                return
            if peek() == ";":
                take()
                continue
            p = term()[0]
            while True:
                o, lit = term()
                out.append((s, p, o, lit))
                if peek() != ",":
                    break
                take()

    while at < len(toks):
        t = peek()
        if t.lower().lstrip("@") in ("prefix", "base") and (t.startswith("@") or t.isalpha()):
            take()
            if t.lower().endswith("prefix"):
                name = take().removesuffix(":")
                prefixes[name] = iri(take())
            else:
                base = iri(take())
            if peek() == ".":
                take()
            continue
        if t == ".":
            take()
            continue
        s = term()[0]
        statements(s, ".")
        take()
    return out


def parse_rdfxml(content: bytes) -> list[tuple[str, str, str, bool]]:
    """Statements of RDF/XML: described resources with their properties, nested ones too; nodes without a name are blank (``_:x0``)."""
    out: list[tuple[str, str, str, bool]] = []
    root = ET.fromstring(content)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")
    name = lambda tag: tag[1:].replace("}", "")
    full = lambda x: urljoin(base, x) if base else x
    blanks = iter(range(10**9))

    def node(e: ET.Element) -> str:
        about, own, blank = e.get(f"{_RDF}about"), e.get(f"{_RDF}ID"), e.get(f"{_RDF}nodeID")
        s = full(about) if about is not None else full(f"#{own}") if own else f"_:{blank}" if blank else f"_:x{next(blanks)}"
        if e.tag != f"{_RDF}Description":
            out.append((s, name(f"{_RDF}type"), name(e.tag), False))
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((_RDF, "{http://www.w3.org/XML/1998/namespace}")):
                out.append((s, name(k), v, True))
        for c in e:
            to, blank = c.get(f"{_RDF}resource"), c.get(f"{_RDF}nodeID")
            if to is not None or blank is not None:
                out.append((s, name(c.tag), full(to) if to is not None else f"_:{blank}", False))
            elif c.get(f"{_RDF}parseType") == "Collection":
                cells = [(f"_:x{next(blanks)}", node(inner)) for inner in c]
                out.append((s, name(c.tag), cells[0][0] if cells else f"{name(_RDF)}nil", False))
                for k, (cell, item) in enumerate(cells):
                    out.append((cell, f"{name(_RDF)}first", item, False))
                    out.append((cell, f"{name(_RDF)}rest", cells[k + 1][0] if k + 1 < len(cells) else f"{name(_RDF)}nil", False))
            elif c.get(f"{_RDF}parseType") == "Resource":
                inner = ET.Element(f"{_RDF}Description")
                inner.extend(list(c))
                out.append((s, name(c.tag), node(inner), False))
            elif len(c):
                for inner in c:
                    out.append((s, name(c.tag), node(inner), False))
            elif c.text and c.text.strip():
                out.append((s, name(c.tag), c.text.strip(), True))
        return s

    for e in [root] if root.tag != f"{_RDF}RDF" else root:
        node(e)
    return out


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Statements of Turtle, N-Triples or RDF/XML files, each once; a file is parsed as a whole by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                xml = p.lower().endswith((".owl", ".rdf", ".xml")) or content.lstrip()[:5] in (b"<?xml", b"<rdf:")
                rows = parse_rdfxml(content) if xml else parse_turtle(content.decode("utf-8", "replace"))
                yield pd.DataFrame(rows, columns=["s", "p", "o", "o_is_literal"])

    return files.mapInPandas(parse, RDF_SCHEMA).distinct()


def fault_tree(df: DataFrame, text: str = "text") -> DataFrame:
    """``(.., event, gate, child, pos)`` of fault trees written as Python literals ``{event: [(children), gate]}``; basic events have no child."""
    keys = [c for c in df.columns if c != text]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text], "event string, gate string, child string, pos int"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                rest = [getattr(row, k) for k in keys]
                try:
                    tree = ast.literal_eval(getattr(row, text) or "{}")
                except (ValueError, SyntaxError):
                    continue
                for event, spec in tree.items():
                    children, gate = (spec[0], spec[1]) if isinstance(spec, (list, tuple)) and len(spec) > 1 else ((), "BE")
                    children = children if isinstance(children, (list, tuple)) else (children,)
                    rows = [(str(event), str(gate), str(c), i) for i, c in enumerate(children)] or [(str(event), str(gate), None, None)]
                    out += [(*rest, *r) for r in rows]
            yield pd.DataFrame(out, columns=[*keys, "event", "gate", "child", "pos"])

    return df.mapInPandas(read, schema)


def prefix_folders(spark: SparkSession, path: str) -> DataFrame:
    """``(path, stop)`` of result files in folders named ``prefix_stop_after_<n>``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    stop = F.regexp_extract("path", r"prefix_stop_after_(?:layer_?)?(\d+)", 1)
    return files.where(stop != "").select("path", stop.cast("int").alias("stop"))
