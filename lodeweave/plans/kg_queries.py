"""Queries over the graph's tables: layers 3 to 11, matching, metrics, consolidation, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import normalizers as N
from lodeweave.operators import consolidation, extraction, graph, keys, matching, metrics, ontology, rules, triples, validation
from lodeweave.plans import pipeline
from lodeweave.session import table

L4, L5, L6, L11 = "layer04_candidate_relation_extraction", "layer05_candidate_triple_generation", "layer06_concept_relation_induction", "layer11_inference_completion"


def _kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "kg_inferred")
    node = lambda s: [F.col(f"{s}.id").alias(f"{s}_id"), F.col(f"{s}.label").alias(f"{s}_label"), *([F.col(f"{s}.type").alias(f"{s}_type")] if s != "predicate" else [])]
    return k.select("row_id", "doc_id", "run_id", "source_code", "triple_id", *node("subject"), *node("predicate"), *node("object"), "chunk_id", "justification", "confidence", "exported_at")


def _short(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("subject_label").alias("head"), F.col("predicate_label").alias("relation"), F.col("object_label").alias("tail"))


def _gold_pred(spark, sf_dir):
    """Layer 5's triples as gold and the exported ones as predictions, by run and spelling apart."""
    key = lambda c: N.consolidation(F.col(c))
    g = table(spark, sf_dir, L5).select("run_id", key("subject_label").alias("head"), N.relation(F.col("predicate_label")).alias("relation"), key("object_label").alias("tail"))
    p = _kg(spark, sf_dir).select("run_id", key("subject_label").alias("head"), N.relation(F.col("predicate_label")).alias("relation"), key("object_label").alias("tail"))
    return g, p


def resolve_candidates(spark, sf_dir):
    k = _kg(spark, sf_dir).where("subject_label is not null")
    m = k.select("doc_id", F.coalesce("subject_type", F.lit("entity")).alias("candidate_type"), F.col("subject_label").alias("label"), F.when(F.col("confidence") >= 0, F.col("confidence")).alias("confidence"), F.col("row_id").alias("ord"), F.col("triple_id").alias("expr_id"))
    out = extraction.resolve_candidates(m)
    return out.select("doc_id", "candidate_type", "normalized_label", "canonical_label", F.round("confidence", 6).alias("confidence"), "n_mentions", "ord", "candidate_id")


def assertions_to_triples(spark, sf_dir):
    a = table(spark, sf_dir, L4)
    return triples.assertions_to_triples(a, ["row_id"], ["run_id"]).select("run_id", "triple_id", "row_id", "subject_id", "predicate_id", "object_id", "chunk_id")


def records_to_triples(spark, sf_dir):
    """Orders as records: the priority is their cause, the status their effect, the customer responsible."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    none = F.array().cast("array<string>")
    r = o.join(c, "o_custkey").select(
        F.pmod("o_custkey", F.lit(100)).alias("doc_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.col("o_orderkey").cast("string").alias("record_no"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("label"),
        F.array("o_orderpriority").alias("cause_items"), F.array("o_orderstatus").alias("effect_items"), none.alias("intervention_items"), F.array("c_name").alias("responsible_items"), none.alias("reference_items"),
    )
    return triples.records_to_triples(r).select("doc_id", "chunk_id", "subject_label", "predicate_label", "object_label", "triple_id")


def duplicate_triples(spark, sf_dir):
    t = table(spark, sf_dir, L5).withColumnRenamed("run_id", "doc_id")
    return validation.repeated_triples(t, ["row_id"]).select("doc_id", "row_id", "triple_id")


def incomplete_triples(spark, sf_dir):
    return validation.incomplete_triples(_kg(spark, sf_dir)).select("row_id", "triple_id")


def inferred_graph(spark, sf_dir):
    return validation.inferred_graph(_kg(spark, sf_dir), ["row_id"]).select("doc_id", "row_id", "subject_id", "predicate_id", "object_id", "chunk_id")


def graph_completion(spark, sf_dir):
    """Exported triples that layer 5 of their run does not have."""
    k = _kg(spark, sf_dir).drop("doc_id").withColumnRenamed("run_id", "doc_id")
    e = table(spark, sf_dir, L5).withColumnRenamed("run_id", "doc_id")
    return validation.complete_graph(k, e).select("row_id", "triple_id")


def _relations(spark, sf_dir):
    r = table(spark, sf_dir, L6).where("element_kind = 'relation' and label is not null")
    return r.select(F.col("run_id").alias("doc_id"), F.col("element_id").alias("relation_id"), "label", "domain_hint", "range_hint", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("row_id").alias("ord"), "description", F.array("element_id").alias("source_candidate_ids"), "source_triple_ids")


def _links(spark, sf_dir):
    c = table(spark, sf_dir, L6).where("element_kind = 'concept' and label is not null")
    return ontology.concept_links(c.select(F.col("run_id").alias("doc_id"), F.col("element_id").alias("concept_id"), "label", F.col("domain_hint").alias("parent_hint"), "confidence", F.col("row_id").alias("ord")))


def parent_hierarchy(spark, sf_dir):
    return _links(spark, sf_dir).select("doc_id", "link_id", "child_id", "child_label", "parent_id", "parent_label")


def axiom_schemata(spark, sf_dir):
    rel = _relations(spark, sf_dir)
    out = ontology.axiom_schemata(rel, _links(spark, sf_dir), ontology.relation_links(rel))
    return out.select("doc_id", "schema_id", "schema_type", "subject_id", "predicate", "object_label")


def general_axioms(spark, sf_dir):
    rel, links = _relations(spark, sf_dir), _links(spark, sf_dir)
    c = table(spark, sf_dir, L6).where("element_kind = 'concept' and label is not null").select(F.col("run_id").alias("doc_id"), F.col("element_id").alias("concept_id"), "label", "description", "confidence")
    out = ontology.general_axioms(ontology.axiom_schemata(rel, links, ontology.relation_links(rel)), c, rel)
    return out.groupBy("axiom_type", "predicate").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count("literal_value").alias("literals"))


def domain_ranges(spark, sf_dir):
    rel = _relations(spark, sf_dir)
    ax = ontology.axiom_schemata(rel, _links(spark, sf_dir).limit(0), ontology.relation_links(rel).limit(0)).withColumn("axiom_type", F.col("schema_type"))
    return metrics.domain_ranges(ax).groupBy("domain", "range").agg(F.count("*").alias("n"))


def triples_per_candidate(spark, sf_dir):
    out = ontology.triples_of(_kg(spark, sf_dir).where("subject_id is not null"))
    return out.select("doc_id", "candidate_id", F.size("triple_ids").alias("n"), F.array_join("triple_ids", ",").alias("triples"))


def concept_induction(spark, sf_dir):
    k = _kg(spark, sf_dir).where("subject_label is not null and subject_id is not null")
    c = k.select("doc_id", F.col("subject_id").alias("candidate_id"), F.col("subject_label").alias("canonical_label"), F.coalesce("subject_type", F.lit("entity")).alias("candidate_type"), F.col("row_id").alias("ord"), "confidence", F.lit(None).cast("string").alias("definition"), F.array(F.concat(F.lit("semantic_role:"), F.coalesce("subject_type", F.lit("entity")))).alias("hints"))
    return ontology.induce_concepts(c).select("doc_id", "concept_id", "label", "parent_hint", F.size("source_candidate_ids").alias("n"))


def prf_exact(spark, sf_dir):
    g, p = _gold_pred(spark, sf_dir)
    return metrics.exact_prf(p, g, ["run_id", "head", "relation", "tail"])


def prf_sets(spark, sf_dir):
    g, p = _gold_pred(spark, sf_dir)
    return metrics.strict_sets(p, g, ["run_id", "head", "relation", "tail"])


def prf_per_relation(spark, sf_dir):
    g, p = _gold_pred(spark, sf_dir)
    return metrics.per_relation(p, g, ["run_id", "head", "relation", "tail"])


def predicate_only(spark, sf_dir):
    g, p = _gold_pred(spark, sf_dir)
    return metrics.predicate_only(p, g)


def validation_metrics(spark, sf_dir):
    """STR, CR, PC, OC, CV and DVS of each source, against layer 5 with equal labels."""
    p = _kg(spark, sf_dir).select("source_code", F.col("row_id").alias("id"), "run_id", F.col("subject_label").alias("head"), F.col("predicate_label").alias("relation"), F.col("object_label").alias("tail"), (F.trim(F.coalesce("justification", F.lit(""))) != "").alias("has_provenance"))
    g = table(spark, sf_dir, L5).select("run_id", F.col("subject_label").alias("head"), F.col("predicate_label").alias("relation"), F.col("object_label").alias("tail"))
    s = metrics.exact_support(p, g, ("run_id",)).select("id", "supported", "contradicted")
    return metrics.validation_summary(p.drop("run_id"), s.join(p.select("id", "source_code"), "id"), by=("source_code",), allowed=None)


def contradiction_pairs(spark, sf_dir):
    return metrics.contradiction_pairs(table(spark, sf_dir, L5), ["run_id"], "row_id")


def faithfulness(spark, sf_dir):
    f = metrics.faithfulness(table(spark, sf_dir, L5))
    return f.select("row_id", "has_provenance", "subject_grounded", "object_grounded", "grounded")


def best_evidence(spark, sf_dir):
    l5 = table(spark, sf_dir, L5)
    return l5.select("row_id", F.coalesce(F.size(keys.dedup_evidence(F.col("provenance"))), F.lit(-1)).alias("n"))


def _hierarchy(spark, sf_dir):
    """Customers under nations and, as a short cut, under regions; nations under regions."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    low = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    of = c.join(low, c.c_nationkey == low.n_nationkey)
    edges = low.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return edges.unionByName(of.select(F.col("c_name").alias("child"), F.col("n_name").alias("parent"))).unionByName(of.select(F.col("c_name").alias("child"), F.col("r_name").alias("parent")))


def hierarchy_closure(spark, sf_dir):
    """All ancestors of customers, nations and regions, with the shortest way."""
    return graph.closure(_hierarchy(spark, sf_dir))


def hierarchy_depth(spark, sf_dir):
    """The longest way to each of them."""
    return graph.depths(_hierarchy(spark, sf_dir))


def _clusters(spark, sf_dir):
    k = _kg(spark, sf_dir).where("subject_label is not null and predicate_label is not null and object_label is not null")
    return k.select(F.pmod("row_id", F.lit(13)).cast("int").alias("stop"), F.col("subject_label").alias("head"), F.col("predicate_label").alias("predicate"), F.col("object_label").alias("tail"), F.when(F.col("confidence") >= 0, F.col("confidence")).alias("confidence"), F.col("row_id").alias("ord"))


def consolidate_exact(spark, sf_dir):
    return consolidation.exact_clusters(_clusters(spark, sf_dir)).select("predicate", "head", "tail", "support", "layers", "first_seen", "last_seen", "ord")


def cluster_topk(spark, sf_dir):
    """The best 226 clusters, the export's budget."""
    s = consolidation.cluster_score(consolidation.exact_clusters(_clusters(spark, sf_dir)), 12)
    return consolidation.select_clusters(s).select("ord", "support", F.round("score", 6).alias("score"))


def consolidate_fuzzy(spark, sf_dir):
    return consolidation.fuzzy_clusters(_clusters(spark, sf_dir)).select("ord", "p", "cluster")


def _membership(spark, sf_dir):
    r = _clusters(spark, sf_dir)
    return r.select(F.concat_ws("|", N.consolidation(F.col("head")), N.relation(F.col("predicate")), N.consolidation(F.col("tail"))).alias("cluster"), "stop")


def layer_contribution(spark, sf_dir):
    m = _membership(spark, sf_dir)
    l5 = table(spark, sf_dir, L5)
    g = l5.select(F.concat_ws("|", N.consolidation(F.col("subject_label")), N.relation(F.col("predicate_label")), N.consolidation(F.col("object_label"))).alias("reference")).distinct()
    return consolidation.layer_contribution(m, m.join(g, F.col("cluster") == F.col("reference")).select("reference", "stop"))


def cluster_inventory(spark, sf_dir):
    return consolidation.inventory(_membership(spark, sf_dir))


def cumulative_prefixes(spark, sf_dir):
    r = _clusters(spark, sf_dir)
    return consolidation.up_to(r, r.select("stop").distinct()).groupBy("prefix").agg(F.count("*").alias("records"), F.count_distinct("stop").alias("stops"))


def ablation_metrics(spark, sf_dir):
    g, p = _gold_pred(spark, sf_dir)
    k = ["run_id", "head", "relation", "tail"]
    src = table(spark, sf_dir, "run_manifest").select("run_id", F.coalesce("source_code", F.lit("?")).alias("variant"))
    n = lambda df, name: df.join(src, "run_id").groupBy("variant").agg(F.count("*").alias(name))
    tp = p.select(*k).distinct().join(g.select(*k).distinct(), k, "left_semi")
    c = n(p, "raw").join(n(g.distinct(), "gold"), "variant", "full_outer").join(n(tp, "tp"), "variant", "left").na.fill(0)
    return consolidation.ablation(c)


def closure_inverse(spark, sf_dir):
    return graph.inverse_closure(_short(_kg(spark, sf_dir)).na.drop(), {"part of": "has part", "monitors": "monitored by", "drives": "driven by"})


def closure_two_hop(spark, sf_dir):
    k = _kg(spark, sf_dir).select(F.concat_ws("/", F.col("doc_id").cast("string"), N.consolidation(F.col("subject_label"))).alias("head"), F.col("predicate_label").alias("relation"), F.concat_ws("/", F.col("doc_id").cast("string"), N.consolidation(F.col("object_label"))).alias("tail"))
    return graph.two_hop(k.na.drop(), "part of", "located in", "located in")


def evidence_links(spark, sf_dir):
    k = _kg(spark, sf_dir).select("doc_id", F.col("chunk_id").alias("window"), F.explode(F.array(N.spacing(F.col("subject_label")), N.spacing(F.col("object_label")))).alias("entity")).where("entity is not null and window is not null")
    return rules.evidence_links(k)


def graph_degrees(spark, sf_dir):
    e = _kg(spark, sf_dir).select(N.spacing(F.col("subject_label")).alias("source"), N.spacing(F.col("object_label")).alias("target")).na.drop()
    return graph.degrees(e)


def graph_root(spark, sf_dir):
    e = _kg(spark, sf_dir).select(N.spacing(F.col("subject_label")).alias("source"), N.spacing(F.col("object_label")).alias("target")).na.drop()
    return graph.root(e)


def graph_levels(spark, sf_dir):
    """Steps from the graph's root along the edges of all exported triples, for the nodes it reaches."""
    e = _kg(spark, sf_dir).select(N.spacing(F.col("subject_label")).alias("source"), N.spacing(F.col("object_label")).alias("target")).na.drop()
    return graph.levels(e, graph.root(e)).where("level is not null")


def rdf_counts(spark, sf_dir):
    return graph.kg_rdf(_kg(spark, sf_dir)).groupBy("p", "o_is_literal").agg(F.count("*").alias("n"))


def turtle(spark, sf_dir):
    """The exported graph as Turtle, one block per subject."""
    return graph.turtle(graph.kg_rdf(_kg(spark, sf_dir)))


def set_operations(spark, sf_dir):
    """Triples of both layers, of both at once, and of one only, by run."""
    g, p = (df.distinct() for df in _gold_pred(spark, sf_dir))
    sets = {"union": g.union(p).distinct(), "intersect": g.intersect(p), "except": p.exceptAll(g)}
    rows = [df.groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "run_id", "n") for k, df in sets.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def alias_labels(spark, sf_dir):
    """Predicates as typed, by the list's French aliases."""
    cat = table(spark, sf_dir, "relation_catalog").select(F.col("canon_label_fr").alias("alias"), F.col("canon_label").alias("canonical"), F.col("canon_id").alias("ord"))
    return matching.by_alias_table(_kg(spark, sf_dir).where("predicate_label is not null").select("row_id", "predicate_label"), cat, "predicate_label")


def exact_counts(spark, sf_dir):
    """One-to-one matches of equal triples, copies counted as often as both sides have them."""
    g, p = _gold_pred(spark, sf_dir)
    return matching.exact_counts(p, g, ["run_id", "head", "relation", "tail"])


def role_typing(spark, sf_dir):
    """Roles and relations read from keywords of justifications."""
    k = _kg(spark, sf_dir).where("justification is not null")
    roles = matching.infer_roles(F.col("justification"), [("alarm", ["alarm", "alarme"]), ("part", ["filter", "motor", "valve"]), ("record", ["record", "sheet", "row"])])
    rel = matching.infer_relation(F.col("justification"), [("CAUSES", ["because", "since"]), ("CONFIRMS", ["confirms"]), ("NAMES", ["names"])])
    return k.select("row_id", F.array_join(roles, ",").alias("roles"), rel.alias("relation"))


def located_snippets(spark, sf_dir):
    """Where the subject stands in its justification, and the text around it."""
    k = _kg(spark, sf_dir).where("justification is not null and subject_label is not null")
    at = extraction.locate(F.col("justification"), F.col("subject_label"))
    return k.select("row_id", at.alias("start"), F.md5(extraction.snippet(F.col("justification"), at, F.length("subject_label"), 20)).alias("digest"))


def confidence_edges(spark, sf_dir):
    """Edges of the exported graph with enough confidence; of parallel ones the last."""
    e = _kg(spark, sf_dir).select(N.spacing(F.col("subject_label")).alias("source"), N.spacing(F.col("object_label")).alias("target"), F.col("predicate_label").alias("label"), "confidence", F.col("row_id").alias("ord")).where("source is not null and target is not null and label is not null")
    return graph.confident_edges(e, 0.5)


def parsed_tuples(spark, sf_dir):
    """Records in tuple form, written from the exported triples and read again."""
    k = _kg(spark, sf_dir).where("subject_label is not null and object_label is not null")
    text = F.concat(F.lit('("entity"<|>'), F.col("subject_label"), F.lit("<|>"), F.coalesce("subject_type", F.lit("thing")), F.lit(')##("relationship"<|>'), F.col("subject_label"), F.lit("<|>"), F.col("object_label"), F.lit(")"))
    return rules.parse_tuples(k.select("row_id", text.alias("text"))).select("row_id", "pos", "kind", F.size("fields").alias("n_fields"), F.md5(F.array_join("fields", "|")).alias("digest"))


def ntriples(spark, sf_dir):
    return graph.ntriples(graph.kg_rdf(_kg(spark, sf_dir)))


def label_sources(spark, sf_dir):
    f = _kg(spark, sf_dir).where("subject_label is not null").select(N.spacing(F.col("subject_label")).alias("item"), F.col("source_code").alias("source"), F.col("row_id").alias("ord"))
    return extraction.merge_sources(f).select("item", F.array_join("sources", ",").alias("sources"))


def label_diagnosis(spark, sf_dir):
    return rules.diagnosis(_kg(spark, sf_dir).select(F.col("predicate_label").alias("relation")).where("relation is not null"))


def id_overlap(spark, sf_dir):
    return rules.id_sets(_kg(spark, sf_dir), table(spark, sf_dir, L5), "run_id")


def predicate_rules(spark, sf_dir):
    """Relabel and reject relations by ordered rules."""
    k = _kg(spark, sf_dir).select("row_id", N.relation(F.col("predicate_label")).alias("relation"), F.col("subject_type").alias("head_type"), F.col("object_type").alias("tail_type"))
    r = [(F.col("relation") == "", None, "empty"), *rules.type_rules({"HANDLED_BY": (["component", "event", "symptom"], ["person", "organisation"])}), (F.col("relation") == "PROVOQUE", "CAUSES", "translated")]
    return rules.apply_rules(k, r).groupBy("mapped", "reason").agg(F.count("*").alias("n"))


def panel_verdicts(spark, sf_dir):
    """Sources as judges of the triples they exported."""
    k = _kg(spark, sf_dir).where("confidence >= 0")
    v = k.select(F.concat_ws("/", "run_id", "triple_id").alias("triple_id"), F.col("source_code").alias("judge"), F.when(F.col("confidence") >= 0.7, "correct").when(F.col("confidence") < 0.5, "incorrect").otherwise("unsure").alias("verdict"), F.col("confidence").alias("score"))
    return metrics.panel(v)


def axiom_completion(spark, sf_dir):
    """Completed axioms of layer 11, each once by its key."""
    a = table(spark, sf_dir, L11).where("completed_axiom is not null").select(F.col("run_id").alias("doc_id"), "rec_id", F.col("completed_axiom.axiom_type").alias("axiom_type"), F.col("completed_axiom.subject_label").alias("subject_id"), F.col("completed_axiom.predicate").alias("predicate"), F.lit(None).cast("string").alias("object_id"), F.col("completed_axiom.object_label").alias("object_label"), F.col("completed_axiom.literal_value").alias("literal_value"))
    once = keys.keep_first(a, ["doc_id", *ontology.AXIOM_KEY], ["rec_id"])
    return once.select("doc_id", "rec_id", "axiom_type", "subject_id", "predicate", "object_label", "literal_value")


def top_orders(spark, sf_dir):
    return triples.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


def greedy_entities(spark, sf_dir):
    """Entities of layer 5 (gold) matched with those exported, by run."""
    g = table(spark, sf_dir, L5).select("run_id", F.col("subject_label").alias("label"))
    return matching.greedy_entities(_kg(spark, sf_dir).select("run_id", F.col("subject_label").alias("label")), g, by=("run_id",))


def greedy_triples(spark, sf_dir):
    p = _kg(spark, sf_dir).select("run_id", F.col("row_id").alias("id"), F.col("subject_label").alias("head"), F.col("predicate_label").alias("relation"), F.col("object_label").alias("tail"))
    g = table(spark, sf_dir, L5).select("run_id", F.col("row_id").alias("id"), F.col("subject_label").alias("head"), F.col("predicate_label").alias("relation"), F.col("object_label").alias("tail"))
    return matching.greedy_triples(p, g, by=("run_id",)).select("run_id", "pred_id", "gold_id", F.round("score", 4).alias("score"))


def bleu_items(spark, sf_dir):
    l5 = table(spark, sf_dir, L5)
    pairs = l5.select(F.col("row_id").alias("item_id"), F.array_join(F.transform("provenance", lambda e: e["snippet"]), " ").alias("reference"), F.col("justification").alias("hypothesis"))
    return metrics.bleu_items(pairs).select("item_id", F.round("bleu", 6).alias("bleu"))


def document_graph(spark, sf_dir):
    """The pipeline end to end: relations of the catalogue and areas found in documents, as a graph."""
    cat = table(spark, sf_dir, "relation_catalog").select(F.col("canon_label").alias("term"), F.lit("relation").alias("label"))
    words = table(spark, sf_dir, "subject_areas").select(F.explode(F.split(F.lower("description"), r"[^\p{L}]+")).alias("term"), F.lit("area").alias("label")).where("length(term) > 4")
    out = pipeline.from_documents(table(spark, sf_dir, "documents"), cat.unionByName(words))["triples"]
    return out.select("doc_id", "triple_id", "subject_label", "predicate_label", "object_label", "chunk_id")


QUERIES = {f.__name__: f for f in (
    resolve_candidates, assertions_to_triples, records_to_triples, duplicate_triples, incomplete_triples, inferred_graph, graph_completion, parent_hierarchy, axiom_schemata, general_axioms, domain_ranges,
    triples_per_candidate, concept_induction, prf_exact, prf_sets, prf_per_relation, predicate_only, validation_metrics, contradiction_pairs, faithfulness, best_evidence, hierarchy_closure, hierarchy_depth,
    consolidate_exact, cluster_topk, consolidate_fuzzy, layer_contribution, cluster_inventory, cumulative_prefixes, ablation_metrics, closure_inverse, closure_two_hop, evidence_links, graph_degrees, graph_root,
    graph_levels, rdf_counts, ntriples, turtle, set_operations, alias_labels, exact_counts, role_typing, located_snippets, confidence_edges, parsed_tuples, label_sources, label_diagnosis, id_overlap, predicate_rules, panel_verdicts, axiom_completion, top_orders, greedy_entities, greedy_triples, bleu_items, document_graph,
)}
