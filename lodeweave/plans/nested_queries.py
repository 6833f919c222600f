"""Queries over the nested reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.nested import LAYER10, LAYER11, flatten_json, flatten_typed, layer10_tables
from lodeweave.session import table

L10, L11 = "layer10_validation_reasoning", "layer11_inference_completion"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each object nested in the layer 10 reports and the layer 11 completions."""
    a = flatten_json(table(spark, sf_dir, L10), "rec_id", "payload", LAYER10)
    b = flatten_typed(table(spark, sf_dir, L11), "rec_id", LAYER11)
    cols = ["rec_id", "path", "parent_pos", "pos", "child_key"]
    return a.select(F.lit(L10).alias("tbl"), *cols).unionByName(b.select(F.lit(L11).alias("tbl"), *cols))


def p3_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of issues."""
    return layer10_tables(table(spark, sf_dir, L10))["issues"].drop("related_ids")


def p3_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of inferred triples."""
    return layer10_tables(table(spark, sf_dir, L10))["triples"].withColumn("confidence", F.round("confidence", 6))


_OPEN = "CASE json_type({0}) WHEN 'VARCHAR' THEN try_cast(({0} ->> '$') AS JSON) ELSE {0} END"
_ARR = "CASE json_type({0}) WHEN 'ARRAY' THEN ({0})::JSON[] WHEN 'OBJECT' THEN [{0}] ELSE []::JSON[] END"


def _item(source: str, where: str) -> str:
    return f"(SELECT rec_id, parent_pos, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS v FROM (SELECT rec_id, parent_pos, {_ARR.format(where)} AS a FROM {source}))"


_P3 = f"""
WITH d AS (SELECT rec_id, {_OPEN.format('payload::JSON')} AS j FROM {L10} WHERE payload IS NOT NULL),
r AS (SELECT rec_id, -1 AS parent_pos, {_OPEN.format("(j -> 'validation_report')")} AS vr, {_OPEN.format("(j -> 'reasoning_report')")} AS rr FROM d),
r2 AS (SELECT rec_id, parent_pos, {_OPEN.format("(vr -> 'issues')")} AS i, {_OPEN.format("(rr -> 'inferred_triples')")} AS t, {_OPEN.format("(rr -> 'inferred_general_axioms')")} AS x FROM r),
i AS {_item('r2', 'i')}, t AS {_item('r2', 't')}, x AS {_item('r2', 'x')},
t2 AS (SELECT rec_id, pos AS parent_pos, {_OPEN.format("(v -> 'provenance')")} AS p FROM t WHERE json_type(v) = 'OBJECT'),
p AS {_item('t2', 'p')}
"""
_ALL10 = " UNION ALL ".join(
    f"SELECT '{L10}' AS tbl, rec_id, '{path}' AS path, parent_pos::INT AS parent_pos, pos::INT AS pos, coalesce(v ->> '{key}', '') AS child_key FROM {s} WHERE json_type(v) = 'OBJECT'"
    for s, path, key in (
        ("i", "validation_report.issues", "issue_id"),
        ("t", "reasoning_report.inferred_triples", "triple_id"),
        ("p", "reasoning_report.inferred_triples.provenance", "chunk_id"),
        ("x", "reasoning_report.inferred_general_axioms", "axiom_id"),
    )
)
_ARRAYS11 = " UNION ALL ".join(
    f"SELECT '{L11}', rec_id, '{path}', {parent}, pos::INT, coalesce(v.chunk_id, '') FROM (SELECT rec_id, generate_subscripts({a}, 1) - 1 AS pos, unnest({a}) AS v FROM {L11}) WHERE v IS NOT NULL"
    for a, path, parent in (("completed_triple.provenance", "completed_triple.provenance", 0), ("completed_axiom.evidence", "completed_axiom.evidence", 0), ("evidence", "evidence", -1))
)
_SINGLE11 = " UNION ALL ".join(
    f"SELECT '{L11}', rec_id, '{c}', -1, 0, coalesce({c}.{key}, '') FROM {L11} WHERE {c} IS NOT NULL" for c, key in (("completed_triple", "triple_id"), ("completed_axiom", "axiom_id"))
)

QUERIES = {"p3_found": p3_found, "p3_issues": p3_issues, "p3_triples": p3_triples}
ORACLE_SQL = {
    "p3_found": f"{_P3} {_ALL10} UNION ALL {_ARRAYS11} UNION ALL {_SINGLE11}",
    "p3_issues": _P3 + "SELECT rec_id, parent_pos::INT AS parent_pos, pos::INT AS pos, v ->> 'issue_id' AS issue_id, v ->> 'issue_type' AS issue_type, v ->> 'severity' AS severity, v ->> 'message' AS message FROM i WHERE json_type(v) = 'OBJECT'",
    "p3_triples": _P3 + "SELECT rec_id, parent_pos::INT AS parent_pos, pos::INT AS pos, v ->> 'triple_id' AS triple_id, v ->> 'subject_id' AS subject_id, v ->> 'subject_label' AS subject_label, v ->> 'predicate_label' AS predicate_label, v ->> 'object_label' AS object_label, v ->> 'chunk_id' AS chunk_id, round((v ->> 'confidence')::DOUBLE, 6) AS confidence FROM t WHERE json_type(v) = 'OBJECT'",
}
