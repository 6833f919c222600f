"""Concepts, hierarchies, axiom schemata and axioms (layers 6 to 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.normalizers import grouping, slug
from lodeweave.operators.keys import dense_id, keep_first

AXIOM_KEY = ["axiom_type", "subject_id", "predicate", "object_id", "object_label", "literal_value"]
AXIOM = ["doc_id", "ord", "axiom_type", "subject_id", "subject_label", "predicate", "object_id", "object_label", "literal_value", "confidence"]


def parse_hints(hints: Column) -> Column:
    """Hints as a map: ``k:v`` (the last of a key wins), ``class_uri`` the first IRI, ``class_label`` the last plain one."""
    every = F.filter(F.transform(F.coalesce(hints, F.array().cast("array<string>")), lambda h: F.trim(h)), lambda h: h != "")
    is_iri = lambda h: h.rlike(r"^https?://")
    keyed = F.filter(every, lambda h: h.contains(":") & ~is_iri(h))
    start = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def put(acc: Column, h: Column) -> Column:
        k = F.substring_index(h, ":", 1)
        rest = F.map_filter(acc, lambda kk, v: kk != k)
        return F.map_concat(rest, F.map_from_arrays(F.array(k), F.array(F.trim(F.regexp_replace(h, "^[^:]*:", "")))))

    pairs = F.aggregate(keyed, start, put)
    plain = F.filter(every, lambda h: ~h.contains(":"))
    label = F.try_element_at(plain, F.lit(-1))
    iri = F.try_element_at(F.filter(every, is_iri), F.lit(1))
    add = lambda m, k, v: F.when(v.isNotNull(), F.map_concat(F.map_filter(m, lambda kk, x: kk != k), F.map_from_arrays(F.array(F.lit(k)), F.array(v)))).otherwise(m)
    return add(add(pairs, "class_uri", iri), "class_label", label)


def promoted(parsed: Column) -> Column:
    """Whether a candidate goes into the ontology; one without the hint does."""
    v = F.lower(F.trim(F.try_element_at(parsed, F.lit("promote_to_ontology"))))
    return F.coalesce(v.isin("true", "1", "yes"), F.lit(True))


def triples_of(triples: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(doc_id, candidate_id, triple_ids)``: the triples that a candidate is part of, as subject, predicate or object.

    The three roles are unpivoted and joined by equality, not by an OR.
    """
    parts = triples.select("doc_id", "triple_id", F.explode(F.array_distinct(F.array("subject_id", "predicate_id", "object_id"))).alias("candidate_id")).where("candidate_id <> ''")
    if candidates is not None:
        parts = parts.join(candidates.select("doc_id", "candidate_id").distinct(), ["doc_id", "candidate_id"], "left_semi")
    return parts.groupBy("doc_id", "candidate_id").agg(F.array_sort(F.collect_set("triple_id")).alias("triple_ids"))


def induce_concepts(candidates: DataFrame) -> DataFrame:
    """Concepts from ``candidates(doc_id, candidate_id, canonical_label, candidate_type, ord, confidence, definition, hints)``.

    Candidates that are promoted and have one normalized label and parent are one concept; the first
    gives the label, kind, description and confidence, all give their ids.
    """
    c = candidates.withColumn("h", parse_hints(F.col("hints"))).where(promoted(F.col("h")) & (F.trim("canonical_label") != ""))
    hint = lambda k: F.try_element_at("h", F.lit(k))
    parent = F.coalesce(hint("class_label"), hint("semantic_role"))
    kind = F.coalesce(hint("semantic_role"), F.col("candidate_type"))
    c = c.select(
        "doc_id", "candidate_id", "ord", F.trim("canonical_label").alias("label"), grouping(F.trim("canonical_label")).alias("normalized_label"), parent.alias("parent_hint"), kind.alias("concept_kind"),
        F.coalesce("definition", hint("definition"), F.concat(F.lit("Concept for "), F.trim("canonical_label"), F.lit("."))).alias("description"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
    first = lambda x: F.min_by(x, F.struct("ord", "candidate_id")).alias(x)
    out = c.groupBy("doc_id", "normalized_label", F.coalesce("parent_hint", "concept_kind", F.lit("")).alias("_key")).agg(
        first("label"), first("parent_hint"), first("concept_kind"), first("description"), first("confidence"), F.min("ord").alias("ord"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "candidate_id"))), lambda x: x["candidate_id"]).alias("source_candidate_ids"),
    )
    return dense_id(out.drop("_key"), "concept_id", "concept_", ["ord", "normalized_label", F.coalesce("parent_hint", F.lit(""))])


def induce_relations(candidates: DataFrame) -> DataFrame:
    """Ontology relations from relation candidates: one per normalized label, domain and range."""
    c = candidates.withColumn("h", parse_hints(F.col("hints"))).where(promoted(F.col("h")))
    hint = lambda k: F.try_element_at("h", F.lit(k))
    label = F.trim(F.coalesce(hint("controlled_relation"), F.col("canonical_label")))
    c = c.select("doc_id", "candidate_id", "ord", label.alias("label"), grouping(label).alias("normalized_label"), hint("domain").alias("domain_hint"), hint("range").alias("range_hint"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")).where("label <> ''")
    out = c.groupBy("doc_id", "normalized_label", "domain_hint", "range_hint").agg(
        F.min_by("label", F.struct("ord", "candidate_id")).alias("label"), F.min_by("confidence", F.struct("ord", "candidate_id")).alias("confidence"), F.min("ord").alias("ord"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "candidate_id"))), lambda x: x["candidate_id"]).alias("source_candidate_ids"),
    )
    return dense_id(out, "relation_id", "ont_rel_", ["ord", "normalized_label"])


def concept_links(concepts: DataFrame) -> DataFrame:
    """Concepts under the classes their hints name; none under its own label."""
    parent = F.trim(F.coalesce("parent_hint", F.lit("")))
    c = concepts.where((parent != "") & (F.lower(F.trim("label")) != F.lower(parent)))
    links = c.select("doc_id", "ord", F.col("concept_id").alias("child_id"), F.col("label").alias("child_label"), F.concat(F.lit("ontology_parent_"), slug(parent)).alias("parent_id"), parent.alias("parent_label"), "confidence")
    return dense_id(keep_first(links, ["doc_id", "child_id", "parent_id"], ["ord", "child_id"]), "link_id", "concept_h_", ["ord", "child_id"])


def relation_links(relations: DataFrame, parent_label: str = "Object Property") -> DataFrame:
    """Relations under one parent relation."""
    r = relations.where(F.lower(F.trim("label")) != parent_label.lower())
    links = r.select("doc_id", "ord", F.col("relation_id").alias("child_id"), F.col("label").alias("child_label"), F.lit("ontology_relation_parent_object_property").alias("parent_id"), F.lit(parent_label).alias("parent_label"), "confidence")
    return dense_id(links, "link_id", "relation_h_", ["ord", "child_id"])


def related_triples(relations: DataFrame, triples: DataFrame) -> DataFrame:
    """``(doc_id, relation_id, triple_ids)``: triples with the relation's label or predicate, or named by it.

    The three ways to be related are three equi-joins, put together.
    """
    t = triples.select("doc_id", "triple_id", "predicate_id", "predicate_label")
    r = relations.select("doc_id", "relation_id", F.col("label").alias("predicate_label"))
    by_label = r.join(t, ["doc_id", "predicate_label"]).select("doc_id", "relation_id", "triple_id")
    ids = relations.select("doc_id", "relation_id", F.explode("source_candidate_ids").alias("predicate_id"))
    by_id = ids.join(t, ["doc_id", "predicate_id"]).select("doc_id", "relation_id", "triple_id")
    every = by_label.unionByName(by_id)
    if "source_triple_ids" in relations.columns:
        named = relations.select("doc_id", "relation_id", F.explode("source_triple_ids").alias("triple_id"))
        every = every.unionByName(named.join(t, ["doc_id", "triple_id"]).select("doc_id", "relation_id", "triple_id"))
    return every.groupBy("doc_id", "relation_id").agg(F.array_sort(F.collect_set("triple_id")).alias("triple_ids"))


def axiom_schemata(relations: DataFrame, links: DataFrame, relation_links_: DataFrame, spelled: str = "subClassOf") -> DataFrame:
    """Domain and range of each relation, then subclasses, then subproperties, with dense ids in that order.

    ``spelled``: the predicate of subclasses as exporters expect it ("subclassOf" for old readers).
    """
    cls = lambda c: F.concat(F.lit("ontology_class::"), slug(c, ""))
    both = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("relation_domain").alias("schema_type"), F.lit("domain").alias("predicate"), F.trim("domain_hint").alias("object_label")),
        F.struct(F.lit(1).alias("k"), F.lit("relation_range").alias("schema_type"), F.lit("range").alias("predicate"), F.trim("range_hint").alias("object_label")),
    )
    r = relations.select("doc_id", "ord", F.col("relation_id").alias("subject_id"), F.col("label").alias("subject_label"), "confidence", F.explode(both).alias("x")).where("x.object_label <> ''")
    r = r.select("doc_id", F.lit(0).alias("phase"), "ord", F.col("subject_id").alias("by"), "x.k", "x.schema_type", "subject_id", "subject_label", "x.predicate", cls(F.col("x.object_label")).alias("object_id"), "x.object_label", "confidence")
    link = lambda df, phase, kind, pred: df.select("doc_id", F.lit(phase).alias("phase"), "ord", F.col("link_id").alias("by"), F.lit(0).alias("k"), F.lit(kind).alias("schema_type"), F.col("child_id").alias("subject_id"), F.col("child_label").alias("subject_label"), F.lit(pred).alias("predicate"), F.col("parent_id").alias("object_id"), F.col("parent_label").alias("object_label"), "confidence")
    every = r.unionByName(link(links, 1, "subclass", spelled)).unionByName(link(relation_links_, 2, "subproperty", "subPropertyOf"))
    return dense_id(every, "schema_id", "schema_", ["phase", "ord", "by", "k"])


def general_axioms(schemata: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """Axioms from schemata, then a description of each concept and relation; each once by its six-part key (nulls are equal)."""
    s = schemata.select("doc_id", F.lit(0).alias("phase"), F.col("schema_id").alias("by"), F.col("schema_type").alias("axiom_type"), "subject_id", "subject_label", "predicate", "object_id", "object_label", F.lit(None).cast("string").alias("literal_value"), "confidence")

    def described(df: DataFrame, id_col: str, phase: int, what: str) -> DataFrame:
        own = F.nullif(F.trim(F.col("description")), F.lit("")) if "description" in df.columns else F.lit(None).cast("string")
        text = F.coalesce(own, F.concat(F.lit(f"Ontology {what} candidate representing "), F.col("label"), F.lit(".")))
        none = F.lit(None).cast("string")
        return df.select("doc_id", F.lit(phase).alias("phase"), F.col(id_col).alias("by"), F.lit("description").alias("axiom_type"), F.col(id_col).alias("subject_id"), F.col("label").alias("subject_label"), F.lit("rdfs:description").alias("predicate"), none.alias("object_id"), none.alias("object_label"), text.alias("literal_value"), "confidence")

    every = s.unionByName(described(concepts, "concept_id", 1, "concept")).unionByName(described(relations, "relation_id", 2, "relation"))
    once = keep_first(every, ["doc_id", *AXIOM_KEY], ["phase", "by"])
    return dense_id(once, "axiom_id", "axiom_", ["phase", "by"])


def promotion_threshold(base: float, depth: str = "balanced", bias: float = 0.5) -> float:
    """The confidence needed for promotion: raised for shallow ontologies, lowered for deep ones, shifted by the bias."""
    t = max(base, 0.65) if depth == "shallow" else min(base, 0.35) if depth == "deep" else base
    return min(1.0, max(0.0, t - (bias - 0.5) * 0.30))


def hierarchy_threshold(base: float, depth: str = "balanced") -> float:
    return max(base, 0.70) if depth == "shallow" else min(base, 0.35) if depth == "deep" else base


def accept(confidence: Column, threshold: float, depth: str = "balanced") -> Column:
    """Whether a confidence passes; one that is missing does unless the ontology is shallow."""
    return F.when(confidence.isNull(), F.lit(depth != "shallow")).otherwise(confidence >= threshold)


def token_subset_hierarchy(labels: DataFrame) -> DataFrame:
    """``(child, parent)``: labels whose words contain all words of another label that is shorter (red valve, valve).

    The model-free stand-in for judging all pairs: labels meet on the rarest word of the parent, so no
    two labels without a common word are compared.
    """
    w = labels.select("label").distinct().withColumn("w", F.array_distinct(F.filter(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"), lambda x: x != "")))
    each = w.select("label", "w", F.explode("w").alias("t"))
    df = each.groupBy("t").agg(F.count("*").alias("df"))
    rare = each.join(df, "t").groupBy("label").agg(F.min_by("t", F.struct("df", "t")).alias("t"), F.first("w").alias("w"))
    return each.select(F.col("label").alias("child"), F.col("w").alias("cw"), "t").join(rare.select(F.col("label").alias("parent"), F.col("w").alias("pw"), "t"), "t").where((F.size("pw") < F.size("cw")) & (F.size(F.array_except("pw", "cw")) == 0)).select("child", "parent")
