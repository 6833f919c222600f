"""Relation assertions and triples with provenance (layers 4 and 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.normalizers import by_alias, slug
from lodeweave.operators.extraction import ROLE_ALIASES
from lodeweave.operators.keys import dense_id, keep_first

#: The relation that each field of a record stands for.
FIELD_RELATIONS = {"cause": "TRIGGERS", "effect": "CAUSES", "intervention": "REQUIRES", "responsible": "HANDLED_BY", "reference": "REFERENCES"}
CENTRAL = ("alarm", "message", "record")


def role(c: Column) -> Column:
    return by_alias(F.translate(F.trim(F.lower(c)), "- ", "__"), ROLE_ALIASES)


def chunk_roles(candidates: DataFrame, expression_roles: DataFrame) -> DataFrame:
    """``(doc_id, chunk_id, role, candidate_id, ord)`` from ``candidates(doc_id, candidate_id, ord, hints, mentions(expr_id, evidence))``.

    The roles are those in the candidate's hints, else the label of the expression mentioned, else unknown.
    """
    hinted = F.transform(F.filter(F.coalesce("hints", F.array().cast("array<string>")), lambda h: h.startswith("semantic_role:")), lambda h: role(F.substring_index(h, ":", -1)))
    m = candidates.select("doc_id", "candidate_id", "ord", hinted.alias("hinted"), F.explode("mentions").alias("m"))
    m = m.select("doc_id", "candidate_id", "ord", "hinted", F.col("m.expr_id").alias("expr_id"), F.explode("m.evidence").alias("e"))
    m = m.join(expression_roles.select("doc_id", "expr_id", role(F.col("label")).alias("expr_role")), ["doc_id", "expr_id"], "left")
    roles = F.when(F.size("hinted") > 0, F.col("hinted")).otherwise(F.array(F.coalesce(F.nullif("expr_role", F.lit("")), F.lit("unknown"))))
    out = m.select("doc_id", F.col("e.chunk_id").alias("chunk_id"), F.explode(F.array_distinct(roles)).alias("role"), "candidate_id", "ord")
    return out.groupBy("doc_id", "chunk_id", "role", "candidate_id").agg(F.min("ord").alias("ord"))


def record_assertions(roles: DataFrame, candidates: DataFrame, relations: DataFrame, field_relations: dict[str, str] | None = None) -> DataFrame:
    """Assertions between a chunk's central candidate and those in its fields.

    The central one is the first alarm, else message, else record. A cause points to it, everything
    else is pointed to by it. ``candidates(doc_id, candidate_id, canonical_label, candidate_type)``,
    ``relations(relation_label, relation_candidate_id)``: one row per label, of a fixed vocabulary.
    """
    spark = roles.sparkSession
    mapping = list((field_relations or FIELD_RELATIONS).items())
    fields = spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(mapping)], "field_ord int, role string, relation_label string")
    rank = F.array_position(F.array(*[F.lit(c) for c in CENTRAL]), F.col("role"))
    central = roles.where(rank > 0).groupBy("doc_id", "chunk_id").agg(F.min_by("candidate_id", F.struct(rank, F.col("ord"), F.col("candidate_id"))).alias("central_id"))
    vocabulary = relations.select(F.upper(F.replace(F.trim("relation_label"), F.lit(" "), F.lit("_"))).alias("key"), "relation_candidate_id", F.col("relation_label").alias("label"))
    named = fields.withColumn("key", F.upper(F.replace(F.trim("relation_label"), F.lit(" "), F.lit("_")))).join(vocabulary, "key").select("field_ord", "role", "label", "relation_candidate_id")
    met = roles.join(F.broadcast(named), "role").join(central, ["doc_id", "chunk_id"])  # named: one row per field of a record
    swap = F.col("role") == "cause"
    pairs = met.select(
        "doc_id", "chunk_id", "field_ord", F.col("ord"), "role", F.col("label").alias("relation_label"), "relation_candidate_id",
        F.when(swap, F.col("candidate_id")).otherwise(F.col("central_id")).alias("source_candidate_id"),
        F.when(swap, F.col("central_id")).otherwise(F.col("candidate_id")).alias("target_candidate_id"),
    )
    side = lambda s: candidates.select("doc_id", F.col("candidate_id").alias(f"{s}_candidate_id"), F.col("canonical_label").alias(f"{s}_candidate_label"), F.col("candidate_type").alias(f"{s}_candidate_type"))
    full = pairs.join(side("source"), ["doc_id", "source_candidate_id"]).join(side("target"), ["doc_id", "target_candidate_id"])
    once = dedup_assertions(full.withColumn("confidence", F.lit(1.0)), ["chunk_id", "field_ord", "ord", "target_candidate_id"])
    return dense_id(once, "assertion_id", "rel_assert_", ["chunk_id", "field_ord", "ord", "source_candidate_id", "target_candidate_id"])


def dedup_assertions(df: DataFrame, order: list) -> DataFrame:
    """The first assertion of each source, relation, target and chunk."""
    return keep_first(df, ["doc_id", "source_candidate_id", "relation_candidate_id", "target_candidate_id", "chunk_id"], order)


def local_pairs(candidates_in_chunks: DataFrame, least: int = 2) -> DataFrame:
    """Chunks with at least two candidates, the input of a model that finds relations among them."""
    return candidates_in_chunks.groupBy("doc_id", "chunk_id").agg(F.count_distinct("candidate_id").alias("n"), F.array_sort(F.collect_set("candidate_id")).alias("candidates")).where(F.col("n") >= least)


def wants_promotion(*hints: Column) -> Column:
    """Whether any of the hint lists asks for promotion to the ontology."""
    every = F.concat(*[F.coalesce(h, F.array().cast("array<string>")) for h in hints])
    return F.exists(every, lambda h: F.lower(F.trim(h)) == "promote_to_ontology:true")


def assertions_to_triples(assertions: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Triples from assertions: the first of each subject, predicate, object and chunk; ids are dense after that."""
    by = by or ["doc_id"]
    t = assertions.select(
        *by, F.col("source_candidate_id").alias("subject_id"), F.col("source_candidate_label").alias("subject_label"), F.col("source_candidate_type").alias("subject_type"),
        F.col("relation_candidate_id").alias("predicate_id"), F.col("relation_label").alias("predicate_label"),
        F.col("target_candidate_id").alias("object_id"), F.col("target_candidate_label").alias("object_label"), F.col("target_candidate_type").alias("object_type"),
        "chunk_id", "justification", "confidence", F.col("evidence").alias("provenance"), *[c for c in order if isinstance(c, str) and c not in (*by, "chunk_id", "confidence", "justification")],
    )
    once = keep_first(t, [*by, "subject_id", "predicate_id", "object_id", "chunk_id"], order)
    return dense_id(once, "triple_id", "triple_", order, by)


def records_to_triples(records: DataFrame, label: str = "label") -> DataFrame:
    """Directed triples from ``records(doc_id, chunk_id, record_no, label, <field>_items)``.

    A cause triggers the record; everything else hangs on it. Once per subject, relation, object
    (case apart) and record number.
    """
    arrays = [_items(f, i, rel) for i, (f, rel) in enumerate(FIELD_RELATIONS.items())]
    t = records.where(F.trim(label) != "").select("doc_id", "chunk_id", "record_no", F.trim(label).alias("_label"), F.explode(F.concat(*arrays)).alias("x")).where("x.item <> ''")
    cause = F.col("x.field") == "cause"
    t = t.select(
        "doc_id", "chunk_id", "record_no", F.col("x.f").alias("field_ord"), F.col("x.k").alias("item_ord"), F.col("x.field").alias("field"),
        F.when(cause, F.col("x.item")).otherwise(F.col("_label")).alias("subject_label"), F.when(cause, "cause").otherwise("alarm").alias("subject_type"),
        F.col("x.relation").alias("predicate_label"),
        F.when(cause, F.col("_label")).otherwise(F.col("x.item")).alias("object_label"), F.when(cause, "alarm").otherwise(F.col("x.field")).alias("object_type"),
    )
    order = ["chunk_id", "record_no", "field_ord", "item_ord", "subject_label", "object_label"]
    once = keep_first(t, ["doc_id", F.lower("subject_label"), F.upper("predicate_label"), F.lower("object_label"), "record_no"], order)
    out = dense_id(once, "triple_id", "triple_", order)
    return out.withColumn("subject_id", slug(F.col("subject_label"), "node")).withColumn("object_id", slug(F.col("object_label"), "node")).withColumn("predicate_id", F.lower("predicate_label"))


def _items(field: str, i: int, relation: str) -> Column:
    """A field's items with the field's and their own place."""
    values = F.coalesce(F.col(f"{field}_items"), F.array().cast("array<string>"))
    return F.transform(values, lambda x, k: F.struct(F.lit(i).alias("f"), k.cast("int").alias("k"), F.lit(field).alias("field"), F.lit(relation).alias("relation"), F.trim(x).alias("item")))


def best_evidence(evidence: Column, chunk_id: Column) -> Column:
    """The evidence from one chunk, each place once."""
    from lodeweave.operators.keys import dedup_evidence

    return dedup_evidence(F.filter(evidence, lambda e: e["chunk_id"] == chunk_id))


def merge_chunk_states(parts: list[DataFrame], key: list[str], order: list) -> DataFrame:
    """Results of chunks put together; rows of one id (within its document and chunk) once."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return keep_first(every, key, order)


def last_wins(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One value per key: that of the last row."""
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
