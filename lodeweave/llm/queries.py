"""The queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.session import table

L4 = "layer04_candidate_relation_extraction"
L5 = "layer05_candidate_triple_generation"
L6 = "layer06_concept_relation_induction"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation labels that differ from the list's spelling, with the entry meant or -1."""
    from lodeweave.llm.relation_labels import map_rows

    rows = (
        table(spark, sf_dir, "kg_inferred")
        .select(F.lit("kg_inferred").alias("tbl"), "row_id", F.col("predicate.label").alias("label"))
        .unionByName(table(spark, sf_dir, L4).select(F.lit(L4).alias("tbl"), "row_id", F.col("relation_label").alias("label")))
        .unionByName(table(spark, sf_dir, L6).where("element_kind = 'relation'").select(F.lit(L6).alias("tbl"), "row_id", "label"))
    )
    return map_rows(rows, table(spark, sf_dir, "relation_catalog"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples exported again in another spelling, each with the earliest row of its group."""
    from lodeweave.llm.ledger import copies

    return copies(table(spark, sf_dir, "kg_inferred"))


def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct triple once, by its earliest row, with the number of its copies."""
    from lodeweave.llm.ledger import build_ledger, triple_keys

    return build_ledger(triple_keys(table(spark, sf_dir, "kg_inferred"))).read().select("keep_row_id", "copies")


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of persons and organisations in the three fields."""
    kg, l4 = table(spark, sf_dir, "kg_inferred"), table(spark, sf_dir, L4)
    cells = [kg.select(F.col(f"{x}.type").alias("kind"), F.col(f"{x}.label").alias("label")) for x in ("subject", "object")]
    cells.append(l4.select(F.col("source_candidate_type").alias("kind"), F.col("source_candidate_label").alias("label")))
    rows = cells[0].unionByName(cells[1]).unionByName(cells[2])
    return rows.where("kind in ('person', 'organisation') and trim(label) <> ''").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    from lodeweave.llm.names import same_entity_pairs

    return same_entity_pairs(entity_names(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group of repeated triples, the row that each field of the survivor comes from."""
    from lodeweave.llm.survivor import choose

    return choose(*(table(spark, sf_dir, t) for t in ("kg_inferred", L5, "export_sources")))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records."""
    from lodeweave.llm.survivor import survivors

    return survivors(*(table(spark, sf_dir, t) for t in ("kg_inferred", L5, "export_sources")))


def export_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Justifications of kg_inferred and snippets of layer 5, one per row."""
    kg = table(spark, sf_dir, "kg_inferred").select(F.lit("kg_inferred").alias("tbl"), "row_id", F.lit(-1).alias("ev_pos"), "source_code", F.col("justification").alias("text"))
    l5 = table(spark, sf_dir, L5).select("row_id", "source_code", F.posexplode("provenance").alias("ev_pos", "e"))
    return kg.unionByName(l5.select(F.lit(L5).alias("tbl"), "row_id", "ev_pos", "source_code", F.col("e.snippet").alias("text")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Justifications and snippets that were cut off."""
    from lodeweave.llm.truncation import find_truncated

    return find_truncated(export_texts(spark, sf_dir)).drop("source_code")


def p7_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts texts off."""
    from lodeweave.llm.truncation import find_truncated

    texts = export_texts(spark, sf_dir).where("trim(text) <> ''")
    n = texts.groupBy("tbl", "source_code").agg(F.count("*").alias("n_texts"))
    bad = find_truncated(texts).groupBy("tbl", "source_code").agg(F.count("*").alias("n_cut"))
    return n.join(bad, ["tbl", "source_code"], "left").select("tbl", "source_code", "n_texts", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_texts"), 6).alias("share"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, whole or in part."""
    from lodeweave.llm.leakage import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of each document."""
    from lodeweave.llm.subject_areas import assign

    return assign(*(table(spark, sf_dir, t) for t in ("documents", "area_labels", "subject_areas"))).select("doc_id", "area_code")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mixture."""
    from lodeweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: which document is taken in which pass over its source."""
    from lodeweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mixture as large as the corpus: the exponent is bisected to the repetition limits."""
    from lodeweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), budget="corpus")[1]


def p9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mixture of the natural token shares to the power that gives it the entropy of the targets."""
    from lodeweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), entropy="targets")[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_ledger": p2_ledger,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_survivors": p6_survivors,
    "p7_found": p7_found,
    "p7_by_source": p7_by_source,
    "p8_found": p8_found,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_budget": p9_budget,
    "p9_entropy": p9_entropy,
    "p10_found": p10_found,
}


def _label_key(x: str) -> str:
    """The key of a label in SQL; overlapping runs between digits need two passes."""
    mark = f"regexp_replace(lower({x}), '([\\p{{N}}])[^\\p{{L}}\\p{{N}}]+([\\p{{N}}])', '\\1\x02\\2', 'g')"
    again = f"regexp_replace({mark}, '([\\p{{N}}])[^\\p{{L}}\\p{{N}}\x02]+([\\p{{N}}])', '\\1\x02\\2', 'g')"
    return f"regexp_replace({again}, '[^\\p{{L}}\\p{{N}}\x02]', '', 'g')"


_GROUPS = f"""
WITH k AS (
  SELECT row_id, doc_id, {_label_key('subject.label')} AS s, {_label_key('predicate.label')} AS p, {_label_key('object.label')} AS o,
    CASE WHEN metadata IS NOT NULL THEN list_sort([x || '=' || json_extract(metadata, '$."' || x || '"')::VARCHAR FOR x IN json_keys(metadata)])::VARCHAR END AS m
  FROM kg_inferred WHERE subject.label IS NOT NULL AND predicate.label IS NOT NULL AND object.label IS NOT NULL),
g AS (SELECT *, min(row_id) OVER (PARTITION BY doc_id, s, p, o, m) AS keep_row_id FROM k)
"""

ORACLE_SQL: dict[str, str] = {
    "p2_found": _GROUPS + "SELECT keep_row_id, row_id AS copy_row_id FROM g WHERE row_id <> keep_row_id",
    "p6_found": _GROUPS
    + f"""
, m AS (SELECT keep_row_id, k.* FROM (SELECT keep_row_id, row_id, count(*) OVER (PARTITION BY keep_row_id) AS c FROM g) JOIN kg_inferred k USING (row_id) WHERE c > 1),
c AS (SELECT keep_row_id, row_id, row_number() OVER (PARTITION BY keep_row_id ORDER BY trust_rank ASC NULLS LAST, exported_at DESC NULLS LAST, row_id) AS r
  FROM m LEFT JOIN export_sources USING (source_code) WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND confidence <> -1),
j AS (SELECT keep_row_id, row_id, row_number() OVER (PARTITION BY keep_row_id ORDER BY length(trim(justification)) DESC, exported_at DESC NULLS LAST, row_id) AS r
  FROM m WHERE length(trim(justification)) >= 20),
l AS (SELECT run_id, triple_id, row_id, created_at, list_max([length(e.snippet) FOR e IN provenance IF trim(e.snippet) <> '']) AS n FROM {L5}),
s AS (SELECT keep_row_id, l.row_id, row_number() OVER (PARTITION BY keep_row_id ORDER BY n DESC, created_at DESC NULLS LAST, l.row_id) AS r
  FROM (SELECT DISTINCT keep_row_id, run_id, triple_id FROM m) JOIN l USING (run_id, triple_id) WHERE n > 0)
SELECT keep_row_id, 'confidence' AS field, row_id AS from_row_id FROM c WHERE r = 1
UNION ALL SELECT keep_row_id, 'justification', row_id FROM j WHERE r = 1
UNION ALL SELECT keep_row_id, 'snippet', row_id FROM s WHERE r = 1""",
    "p6_survivors": _GROUPS
    + f"""
, m AS (SELECT keep_row_id, k.* FROM (SELECT keep_row_id, row_id, count(*) OVER (PARTITION BY keep_row_id) AS c FROM g) JOIN kg_inferred k USING (row_id) WHERE c > 1),
r AS (SELECT source_code, min(trust_rank) AS tr FROM export_sources WHERE source_code IS NOT NULL GROUP BY 1),
mt AS (SELECT m.*, greatest(1, 100 - coalesce(tr, 100)) AS trust FROM m LEFT JOIN r USING (source_code)),
c AS (SELECT keep_row_id, confidence, source_code, row_number() OVER (PARTITION BY keep_row_id ORDER BY trust DESC, exported_at DESC NULLS LAST, row_id) AS n
  FROM mt WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND confidence <> -1),
j0 AS (SELECT keep_row_id, chunk_id, justification, exported_at AS made_at, row_id, length(trim(justification)) * trust AS worth FROM mt WHERE length(trim(justification)) >= 20),
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keep_row_id, chunk_id ORDER BY worth DESC, made_at DESC NULLS LAST, row_id) AS n FROM j0) WHERE n = 1),
l AS (SELECT run_id, triple_id, row_id, chunk_id, created_at AS made_at, provenance, list_max([length(e.snippet) FOR e IN provenance IF trim(e.snippet) <> '']) AS len, greatest(1, 100 - coalesce(tr, 100)) AS trust
  FROM {L5} LEFT JOIN r USING (source_code)),
s0 AS (SELECT keep_row_id, l.chunk_id, l.made_at, l.row_id, len * trust AS worth, provenance, len FROM (SELECT DISTINCT keep_row_id, run_id, triple_id FROM m) JOIN l USING (run_id, triple_id) WHERE len > 0),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keep_row_id, chunk_id ORDER BY worth DESC, made_at DESC NULLS LAST, row_id) AS n FROM s0) WHERE n = 1),
k0 AS (SELECT DISTINCT keep_row_id FROM m),
jj AS (SELECT keep_row_id, chunk_id, justification, made_at, row_id, worth FROM j UNION ALL SELECT keep_row_id, NULL, NULL, NULL, NULL, 0 FROM k0),
ss AS (SELECT keep_row_id, chunk_id, provenance, len, made_at, row_id, worth FROM s UNION ALL SELECT keep_row_id, NULL, NULL, NULL, NULL, NULL, 0 FROM k0),
b AS (SELECT jj.keep_row_id, jj.row_id AS j_row, justification, jj.chunk_id AS j_chunk, ss.row_id AS s_row, [x FOR x IN provenance IF length(x.snippet) = len AND trim(x.snippet) <> ''][1] AS e,
  row_number() OVER (PARTITION BY jj.keep_row_id ORDER BY jj.worth + ss.worth DESC, jj.row_id IS NULL, jj.worth DESC, jj.made_at DESC NULLS LAST, jj.row_id, ss.row_id IS NULL, ss.worth DESC, ss.made_at DESC NULLS LAST, ss.row_id) AS n
  FROM jj JOIN ss ON jj.keep_row_id = ss.keep_row_id AND (jj.chunk_id IS NULL OR ss.chunk_id IS NULL OR jj.chunk_id = ss.chunk_id))
SELECT k.row_id AS keep_row_id, k.doc_id, k.subject.label AS subject_label, k.predicate.label AS predicate_label, k.object.label AS object_label, c.confidence, c.source_code, b.justification, b.j_chunk AS chunk_id,
  b.e.snippet AS snippet, b.e.chunk_id AS snippet_chunk_id
FROM k0 JOIN kg_inferred k ON k.row_id = k0.keep_row_id LEFT JOIN c ON c.keep_row_id = k0.keep_row_id AND c.n = 1 JOIN b ON b.keep_row_id = k0.keep_row_id AND b.n = 1
WHERE c.keep_row_id IS NOT NULL OR b.j_row IS NOT NULL OR b.s_row IS NOT NULL""",
    "p2_ledger": _GROUPS + "SELECT keep_row_id, count(*)::BIGINT AS copies FROM g GROUP BY 1",
}
