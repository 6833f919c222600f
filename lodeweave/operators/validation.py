"""Validation, reasoning and completion of a graph (layers 10 and 11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.normalizers import compatibility
from lodeweave.operators.extraction import alt_labels
from lodeweave.operators.keys import append_new, dense_id, keep_first
from lodeweave.operators.ontology import AXIOM_KEY

#: Names under which the classes of the record vocabulary go.
CLASS_ALIASES = {
    "plcalarmormessage": ["plcalarmormessage", "plcalarm", "plcmessage", "alarm", "message", "entityalarm", "entitymessage"],
    "plcalarm": ["plcalarm", "alarm", "entityalarm"],
    "plcmessage": ["plcmessage", "message", "entitymessage"],
    "alarmcause": ["alarmcause", "cause", "eventcause", "semanticrolecause"],
    "machineeffect": ["machineeffect", "effect", "eventeffect", "semanticroleeffect"],
    "interventionaction": ["interventionaction", "intervention", "action", "eventintervention", "semanticroleintervention"],
    "responsibleactor": ["responsibleactor", "responsible", "actor", "operator", "technician", "entityresponsible", "semanticroleresponsible"],
    "technicalreference": ["technicalreference", "reference", "entityreference", "semanticrolereference"],
}
#: Roles that go with each relation, on either side.
RELATION_ROLES = {
    "TRIGGERS": (["alarmcause", "cause"], ["plcalarmormessage", "plcalarm", "plcmessage", "alarm", "message"]),
    "CAUSES": (["plcalarmormessage", "plcalarm", "plcmessage", "alarm", "message"], ["machineeffect", "effect"]),
    "REQUIRES": (["plcalarmormessage", "plcalarm", "plcmessage", "alarm", "message"], ["interventionaction", "intervention", "action"]),
    "HANDLED_BY": (["plcalarmormessage", "plcalarm", "plcmessage", "alarm", "message"], ["responsibleactor", "responsible", "actor", "operator", "technician"]),
    "REFERENCES": (["plcalarmormessage", "plcalarm", "plcmessage", "alarm", "message"], ["technicalreference", "reference"]),
}
#: Words of a class's name that fit a coarse type.
COARSE = {
    "entity": ["component", "resource", "machine", "object", "device", "entity", "actor", "reference", "alarm", "message"],
    "event": ["event", "failure", "state", "process", "alarm", "cause", "effect", "intervention", "action"],
    "attribute": ["value", "property", "attribute", "state", "measurement"],
}


def _issue(df: DataFrame, kind: str, severity: str, related: str, phase: int, order: list) -> DataFrame:
    return df.select("doc_id", F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.col(related).alias("related_id"), F.lit(phase).alias("phase"), F.struct(*order).cast("string").alias("at"))


def incomplete_triples(t: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return t.where(empty("subject_id") | empty("predicate_id") | empty("object_id"))


def repeated_triples(t: DataFrame, order: list) -> DataFrame:
    """Second and later triples of one subject, predicate, object and chunk.

    Each key's first row is an aggregate; the rest is what is not the first, so no task sorts a whole key.
    """
    keys = ["doc_id", "subject_id", "predicate_id", "object_id", "chunk_id"]
    first = keep_first(t.select(*keys, *order), keys, order).select(*[F.col(c).alias(f"_{c}") for c in [*keys, *order]])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, *order]]
    return t.join(first, on, "left_anti")


def coarse_fit(node_type: Column, label: Column) -> Column:
    """Whether a coarse type goes with a class's name; types without a rule go with every class."""
    t, s = F.lower(F.trim(F.coalesce(node_type, F.lit("")))), F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.lit(True)
    for kind, words in COARSE.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | s.contains(w)
        out = F.when(t == kind, hit).otherwise(out)
    return F.when(s == "", True).otherwise(out)


def fits(expected_label: Column, signals: Column, relation: Column, node_type: Column, side: int) -> Column:
    """Whether a node may stand where a class is expected: one name within the other, an alias, a role of the relation, or a coarse type."""
    expected = compatibility(expected_label)
    norm = F.filter(F.transform(F.array_compact(signals), compatibility), lambda x: x != "")
    within = F.exists(norm, lambda s: F.contains(s, expected) | F.contains(expected, s))
    aliases = F.create_map(*[x for k, v in CLASS_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    alias = F.arrays_overlap(norm, F.coalesce(F.try_element_at(aliases, expected), F.array(expected)))
    roles = F.create_map(*[x for k, v in RELATION_ROLES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v[side]]))])
    wanted = F.try_element_at(roles, relation)
    by_role = F.coalesce(F.array_contains(wanted, expected) & F.arrays_overlap(norm, wanted), F.lit(False))
    return (expected == "") | within | alias | by_role | coarse_fit(node_type, expected_label)


def mismatches(triples: DataFrame, schemata: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(doc_id, triple_id, issue_type, expected)``: ends of triples that do not go with their relation's domain or range.

    Of several schemata of a label, and of several concepts of a candidate, the last one counts.
    """
    last = lambda kind, to: schemata.where(F.col("schema_type") == kind).groupBy("doc_id", F.col("subject_label").alias("predicate_label")).agg(F.max_by("object_label", "schema_id").alias(to))
    c = concepts.select("doc_id", F.explode("source_candidate_ids").alias("node_id"), "concept_id", "label", "normalized_label", "concept_kind", "parent_hint")
    c = c.groupBy("doc_id", "node_id").agg(F.max_by(F.array("label", "normalized_label", "concept_kind", "parent_hint"), "concept_id").alias("concept_signals"))
    t = triples.join(last("relation_domain", "domain"), ["doc_id", "predicate_label"], "left").join(last("relation_range", "range"), ["doc_id", "predicate_label"], "left").where("domain is not null or range is not null")
    for s in ("subject", "object"):
        t = t.join(c.select("doc_id", F.col("node_id").alias(f"{s}_id"), F.col("concept_signals").alias(f"{s}_signals")), ["doc_id", f"{s}_id"], "left")
    sig = lambda s: F.concat(F.array(F.col(f"{s}_label"), F.col(f"{s}_type")), F.coalesce(f"{s}_signals", F.array().cast("array<string>")))
    bad = F.array_compact(
        F.array(
            F.when(F.col("domain").isNotNull() & ~fits(F.col("domain"), sig("subject"), F.col("predicate_label"), F.col("subject_type"), 0), F.struct(F.lit("domain_mismatch").alias("issue_type"), F.col("domain").alias("expected"))),
            F.when(F.col("range").isNotNull() & ~fits(F.col("range"), sig("object"), F.col("predicate_label"), F.col("object_type"), 1), F.struct(F.lit("range_mismatch").alias("issue_type"), F.col("range").alias("expected"))),
        )
    )
    return t.select("doc_id", "triple_id", F.inline(bad))


def issues(triples: DataFrame, links: DataFrame, relation_links: DataFrame, axioms: DataFrame, schemata: DataFrame, concepts: DataFrame) -> DataFrame:
    """All issues of all documents with dense ids in the order of the checks."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    parts = [
        _issue(incomplete_triples(triples), "missing_triple_component", "error", "triple_id", 0, ["triple_id"]),
        _issue(repeated_triples(triples, ["triple_id"]), "duplicate_triple", "warning", "triple_id", 0, ["triple_id"]),
        _issue(links.where("child_id = parent_id"), "self_subclass", "error", "link_id", 1, ["link_id"]),
        _issue(relation_links.where("child_id = parent_id"), "self_subrelation", "error", "link_id", 2, ["link_id"]),
        _issue(axioms.where((F.col("axiom_type") == "description") & blank("literal_value")), "empty_description_axiom", "warning", "axiom_id", 3, ["axiom_id"]),
        _issue(axioms.where(F.col("axiom_type").isin("subclass", "relation_domain", "relation_range") & blank("object_label")), "empty_structural_axiom_target", "warning", "axiom_id", 3, ["axiom_id"]),
        mismatches(triples, schemata, concepts).select("doc_id", "issue_type", F.lit("warning").alias("severity"), F.col("triple_id").alias("related_id"), F.lit(4).alias("phase"), F.col("triple_id").alias("at")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return dense_id(every, "issue_id", "issue_", ["phase", "at", "issue_type"]).drop("at")


def validity(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, n_issues, is_valid)``: valid is a document without an error."""
    s = found.groupBy("doc_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"))
    return docs.select("doc_id").distinct().join(s, "doc_id", "left").select("doc_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), (F.coalesce("n_errors", F.lit(0)) == 0).alias("is_valid"))


def inferred_graph(triples: DataFrame, order: list, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The distinct triples of a document; the first of equal ones."""
    return keep_first(triples, [*by, "subject_id", "predicate_id", "object_id", "chunk_id"], order)


def complete_graph(inferred: DataFrame, existing: DataFrame) -> DataFrame:
    """Inferred triples that the graph does not have yet."""
    return append_new(inferred, existing, ["doc_id", "subject_id", "predicate_id", "object_id", "chunk_id"])


def complete_ontology(inferred: DataFrame, existing: DataFrame) -> DataFrame:
    """Inferred axioms that the ontology does not have yet."""
    return append_new(inferred, existing, ["doc_id", *AXIOM_KEY])


def semantic_completions(candidates: DataFrame, concepts: DataFrame, existing: DataFrame) -> DataFrame:
    """Types, alignments, preferred labels, comments and alternative labels that follow from candidates and their concepts.

    ``candidates(doc_id, candidate_id, canonical_label, aliases, ord)``. Each axiom once, and none that exists.
    """
    c = concepts.select("doc_id", F.explode("source_candidate_ids").alias("candidate_id"), "concept_id", "label", "description", F.col("ord").alias("c_ord"))
    m = c.join(candidates.select("doc_id", "candidate_id", "canonical_label", "aliases"), ["doc_id", "candidate_id"])
    none = F.lit(None).cast("string")

    def axiom(k: int, completion: str, kind: str, sid: Column, slabel: Column, pred: str, oid: Column = none, olabel: Column = none, lit: Column = none) -> Column:
        return F.struct(
            F.lit(k).alias("k"), F.lit(0).alias("j"), F.lit(completion).alias("completion_type"), F.lit(kind).alias("axiom_type"), sid.alias("subject_id"), slabel.alias("subject_label"),
            F.lit(pred).alias("predicate"), oid.alias("object_id"), olabel.alias("object_label"), lit.alias("literal_value"),
        )

    node, label, cid, clabel = F.col("candidate_id"), F.col("canonical_label"), F.col("concept_id"), F.col("label")
    fixed = F.array(
        axiom(0, "rdf_type_completion", "type_link", node, label, "rdf:type", cid, clabel),
        axiom(1, "candidate_concept_alignment_completion", "same_as", node, label, "owl:sameAs", cid, clabel),
        axiom(2, "skos_pref_label_completion", "pref_label", cid, clabel, "skos:prefLabel", lit=clabel),
        axiom(3, "rdfs_comment_completion", "comment", cid, clabel, "rdfs:comment", lit=F.col("description")),
    )
    others = F.transform(alt_labels(clabel, F.col("aliases")), lambda a: axiom(4, "skos_alt_label_completion", "alt_label", cid, clabel, "skos:altLabel", lit=a))
    rows = m.select("doc_id", "candidate_id", "c_ord", F.explode(F.concat(fixed, others)).alias("x")).select("doc_id", "candidate_id", "c_ord", "x.*")
    rows = rows.where((F.col("axiom_type") != "comment") | F.coalesce(F.col("literal_value") != "", F.lit(False)))
    order = ["candidate_id", "c_ord", "k", "literal_value"]
    once = keep_first(append_new(rows, existing, ["doc_id", *AXIOM_KEY]), ["doc_id", *AXIOM_KEY], order)
    return dense_id(once, "completion_id", "completion_", order)


def combined_confidence(a: Column, b: Column, default: float = 0.75) -> Column:
    """The lower of two confidences; the default if both are missing."""
    return F.coalesce(F.least(a, b), F.lit(default))


def ranked_issues(found: DataFrame) -> DataFrame:
    """Counts by type and severity, most frequent first."""
    w = Window.orderBy(F.col("n").desc(), "issue_type")
    return found.groupBy("issue_type", "severity").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w))  # a row per type of issue
