"""The pipeline from texts to a validated graph, as one lazily planned set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.cleaning import clean_native
from lodeweave.operators import chunking, extraction, ontology, triples, validation
from lodeweave.session import cut


@dataclass(frozen=True)
class Settings:
    size: int = 1500
    overlap: int = 200
    relation: str = "CO_OCCURS_WITH"


def from_documents(docs: DataFrame, lexicon: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """``docs(doc_id, text)`` and ``lexicon(term, label)`` to chunks, expressions, candidates and triples.

    Terms met in one chunk become neighbours in the order of their first places, each linked to the next.
    """
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.repartition(tasks) if docs.rdd.getNumPartitions() < tasks else docs  # a few large files would clean in a few tasks
    cleaned = docs.where("text is not null").select("doc_id", clean_native(F.col("text")).alias("text"))
    chunks = cut(chunking.fixed_chunks(cleaned, "text", settings.size, settings.overlap).drop("text"))  # read twice below
    found = extraction.lexicon_expressions(chunks, lexicon)
    found = found.withColumn("ord", F.struct("doc_start_char", "chunk_id", "text"))
    mentions = found.select("doc_id", F.lit("entity").alias("candidate_type"), F.col("text").alias("label"), F.lit(1.0).alias("confidence"), "ord", F.concat_ws("/", "chunk_id", "text").alias("expr_id"))
    candidates = extraction.resolve_candidates(mentions)
    in_chunk = found.select("doc_id", "chunk_id", F.col("text").alias("normalized_label"), "chunk_start_char").join(candidates.select("doc_id", "normalized_label", "candidate_id", "canonical_label"), ["doc_id", "normalized_label"])
    row = F.array_sort(F.collect_list(F.struct("chunk_start_char", "candidate_id", "canonical_label")))
    seq = in_chunk.groupBy("doc_id", "chunk_id").agg(row.alias("r"))  # the terms of one chunk
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.struct(a["candidate_id"].alias("sid"), a["canonical_label"].alias("sl"), b["candidate_id"].alias("oid"), b["canonical_label"].alias("ol")))
    links = seq.where(F.size("r") > 1).select("doc_id", "chunk_id", F.posexplode(pairs).alias("pos", "p"))
    assertions = links.select(
        "doc_id", "chunk_id", "pos", F.col("p.sid").alias("source_candidate_id"), F.col("p.sl").alias("source_candidate_label"), F.lit("entity").alias("source_candidate_type"), F.lit("cand_r_00000").alias("relation_candidate_id"),
        F.lit(settings.relation).alias("relation_label"), F.col("p.oid").alias("target_candidate_id"), F.col("p.ol").alias("target_candidate_label"), F.lit("entity").alias("target_candidate_type"),
        F.lit("Both occur in one chunk.").alias("justification"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("evidence"),
    )
    graph = triples.assertions_to_triples(assertions, ["chunk_id", "pos"])
    return {"chunks": chunks, "expressions": found, "candidates": candidates, "assertions": assertions, "triples": graph}


def ontology_of(candidates: DataFrame, relation_candidates: DataFrame, graph: DataFrame) -> dict[str, DataFrame]:
    """Concepts, links, schemata, axioms, issues and completions of resolved candidates and their triples."""
    concepts = ontology.induce_concepts(candidates)
    relations = ontology.induce_relations(relation_candidates)
    links, rlinks = ontology.concept_links(concepts), ontology.relation_links(relations)
    schemata = ontology.axiom_schemata(relations, links, rlinks)
    axioms = ontology.general_axioms(schemata, concepts, relations.withColumn("description", F.lit(None).cast("string")))
    found = validation.issues(graph, links, rlinks, axioms, schemata, concepts)
    inferred = validation.inferred_graph(graph, ["triple_id"])
    return {
        "concepts": concepts, "relations": relations, "links": links, "relation_links": rlinks, "schemata": schemata, "axioms": axioms, "issues": found, "inferred": inferred,
        "completions": validation.complete_graph(inferred, graph),
    }
