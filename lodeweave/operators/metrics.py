"""Scores of a graph or an ontology, with and without gold; each is one aggregate over a flagged table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import normalizers as N
from lodeweave.functions import similarity as S
from lodeweave.operators.graph import closure, depths, on_cycles
from lodeweave.operators.matching import GENERAL, GENERIC, Profile, triple_pairs

RELATIONS = ("TRIGGERS", "CAUSES", "REQUIRES", "HANDLED_BY", "REFERENCES")
MALFORMED = r"^(concept_|ont_rel_|cand_)"


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, pred: Column, gold: Column) -> list[Column]:
    """precision, recall and f1 from counts."""
    p, r = safe_div(tp, pred), safe_div(tp, gold)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(safe_div(2 * p * r, p + r), 6).alias("f1")]


def exact_prf(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    from lodeweave.operators.matching import exact_counts

    c = exact_counts(pred, gold, keys)
    return c.select("pred_n", "gold_n", "tp", *prf(F.col("tp"), F.col("pred_n"), F.col("gold_n")))


def per_relation(pred: DataFrame, gold: DataFrame, keys: list[str], relation: str = "relation") -> DataFrame:
    """One row per relation that either side has, and one for all of them (relation null), in one pass."""
    others = [k for k in keys if k != relation]
    count = lambda df, n: df.groupBy(relation, *others).agg(F.count("*").alias(n))
    both = count(pred, "p").join(count(gold, "g"), [relation, *others], "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    s = both.select(F.coalesce(F.col(relation), F.lit("")).alias(relation), z("p").alias("p"), z("g").alias("g")).rollup(relation)
    agg = s.agg(F.sum("p").alias("pred_count"), F.sum("g").alias("gold_count"), F.sum(F.least("p", "g")).alias("tp"))
    return agg.select(relation, "pred_count", "gold_count", "tp", *prf(F.col("tp"), F.col("pred_count"), F.col("gold_count")))


def flags(triples: DataFrame, allowed: tuple[str, ...] | None = RELATIONS, raw_ids: bool = True) -> DataFrame:
    """Adds ``conforms`` and ``violates`` to triples (head, relation, tail).

    Ids of pipeline objects in place of labels are recognised in the raw label; with ``raw_ids`` false
    only after normalization, which has no underscore left and so finds none.
    """
    h, t = N.evaluation(F.col("head")), N.evaluation(F.col("tail"))
    bad = lambda c, n: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).rlike(MALFORMED) if raw_ids else n.rlike(MALFORMED)
    malformed = bad("head", h) | bad("tail", t)
    generic = h.isin(*GENERIC) | t.isin(*GENERIC)
    rel = F.upper(F.trim(F.coalesce("relation", F.lit(""))))
    known = rel.isin(*allowed) if allowed else rel != ""
    empty = (h == "") | (t == "")
    return triples.withColumn("conforms", known & ~empty & ~malformed & ~generic).withColumn("violates", empty | (h == t) | generic | malformed)


def support(pred: DataFrame, gold: DataFrame, profile: Profile = GENERAL, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(by, id, supported, contradicted)`` for each predicted triple.

    Supported: a gold triple of the same relation whose ends are similar. Contradicted: not supported,
    but one end is like that of a gold triple of the relation and the other is not.
    """
    p = triple_pairs(pred, gold, list(by))
    tail = F.when(F.col("rel") == "REQUIRES", profile.fair_tail_requires).otherwise(profile.fair_tail)
    ok = (F.col("head_score") >= profile.fair_head) & (F.col("tail_score") >= tail)
    against = (F.col("head_score") >= profile.same) & (F.col("tail_score") < profile.low) | (F.col("tail_score") >= profile.same) & (F.col("head_score") < profile.low)
    s = p.groupBy(*by, F.col("pred_id").alias("id")).agg(F.bool_or(ok).alias("ok"), F.bool_or(against).alias("against"))
    out = pred.select(*by, "id").distinct().join(s, [*by, "id"], "left")
    yes = F.coalesce("ok", F.lit(False))
    return out.select(*by, "id", yes.alias("supported"), (~yes & F.coalesce("against", F.lit(False))).alias("contradicted"))


def exact_support(pred: DataFrame, gold: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same with equal labels: contradicted is a triple whose head and relation are in gold, but not with this tail."""
    key = lambda df: df.select(*by, N.domain(F.col("head")).alias("h"), F.upper(N.domain(F.col("relation"))).alias("r"), N.domain(F.col("tail")).alias("t"), *(["id"] if "id" in df.columns else []))
    p, g = key(pred), key(gold).distinct()
    full = g.select(*by, "h", "r", "t", F.lit(True).alias("_s"))
    half = g.select(*by, "h", "r").distinct().withColumn("_h", F.lit(True))
    j = p.join(full, [*by, "h", "r", "t"], "left").join(half, [*by, "h", "r"], "left")
    return j.select(*by, "id", F.coalesce("_s", F.lit(False)).alias("supported"), (F.coalesce("_h", F.lit(False)) & F.col("_s").isNull()).alias("contradicted"))


def validation_summary(pred: DataFrame, supported: DataFrame, profile: Profile = GENERAL, by: tuple[str, ...] = ("doc_id",), allowed: tuple[str, ...] | None = RELATIONS) -> DataFrame:
    """STR, CR, PC, OC, CV and DVS per group; ``pred`` has has_provenance besides id, head, relation, tail."""
    d = flags(pred, allowed).join(supported, [*by, "id"])
    share = lambda c: F.avg(F.col(c).cast("double"))
    s = d.groupBy(*by).agg(share("supported").alias("STR"), share("contradicted").alias("CR"), share("has_provenance").alias("PC"), share("conforms").alias("OC"), share("violates").alias("CV"), F.count("*").alias("n"))
    good = (F.col("STR") >= profile.min_str) & (F.col("CR") <= profile.max_cr) & (F.col("OC") >= profile.min_oc) & (F.col("CV") <= profile.max_cv)
    return s.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("STR", "CR", "PC", "OC", "CV")], good.cast("double").alias("DVS"))


def mean_of_documents(per_doc: DataFrame) -> DataFrame:
    """The means over documents."""
    return per_doc.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("STR", "CR", "PC", "OC", "CV", "DVS")], F.count("*").alias("documents"))


def faithfulness(triples: DataFrame) -> DataFrame:
    """``(doc_id, triple_id, has_provenance, subject_grounded, object_grounded, grounded)``: labels found in the snippets."""
    snippets = F.filter(F.transform(F.coalesce("provenance", F.expr("array()").cast(triples.schema["provenance"].dataType)), lambda e: N.plain(e["snippet"])), lambda s: s != "")
    t = triples.withColumn("_s", snippets)
    found = lambda c: F.exists("_s", lambda s: F.contains(s, N.plain(F.coalesce(F.col(c), F.lit(""))))) & (F.coalesce(F.col(c), F.lit("")) != "")
    has = F.size("_s") > 0
    keys = [c for c in ("run_id", "doc_id", "row_id") if c in triples.columns]
    return t.select(*keys, "triple_id", has.alias("has_provenance"), found("subject_label").alias("subject_grounded"), found("object_label").alias("object_grounded"), (has & found("subject_label") & found("object_label")).alias("grounded"))


def contradiction_pairs(triples: DataFrame, by: list[str], ord_col: str) -> DataFrame:
    """``(by, first_ord, second_ord)``: triples of one subject and predicate with different objects.

    Of equal triples the first counts; each pair once, the earlier one first. Keys are normalized to
    lower case; the pairs grow with the distinct objects of a subject and predicate, not with its rows.
    """
    k = triples.select(*by, N.plain(F.col("subject_label")).alias("s"), N.plain(F.col("predicate_label")).alias("p"), N.plain(F.col("object_label")).alias("o"), F.col(ord_col).alias("ord"))
    first = k.where("s is not null and p is not null and o is not null").groupBy(*by, "s", "p", "o").agg(F.min("ord").alias("ord"))
    a, b = first.withColumnsRenamed({"o": "o1", "ord": "first_ord"}), first.withColumnsRenamed({"o": "o2", "ord": "second_ord"})
    return a.join(b, [*by, "s", "p"]).where("first_ord < second_ord").select(*by, "first_ord", "second_ord")


def outcomes(issues: DataFrame, triples: DataFrame, inferred: DataFrame, completions: DataFrame, concepts: DataFrame, links: DataFrame, axioms: DataFrame, relations: DataFrame, by: str = "doc_id") -> DataFrame:
    """What validation, reasoning and completion gave, per document."""
    c = lambda df, name, *more: df.groupBy(by).agg(F.count("*").alias(name), *more)
    specified = axioms.where(F.col("axiom_type").isin("relation_domain", "relation_range")).groupBy(by, "subject_id").agg(F.count_distinct("axiom_type").alias("n")).where("n = 2").groupBy(by).agg(F.count("*").alias("specified"))
    lone = concepts.select(by, "concept_id").distinct().join(links.select(by, F.col("child_id").alias("concept_id")).distinct(), [by, "concept_id"], "left_anti").groupBy(by).agg(F.count("*").alias("orphans"))
    out = c(triples, "candidate_triples", F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    for df in (
        c(issues, "issues", F.count_if(F.col("severity") == "error").alias("errors")), c(inferred, "inferred_triples"), c(completions, "completions"),
        concepts.groupBy(by).agg(F.count_distinct("concept_id").alias("concepts")), c(relations, "relations"), c(axioms, "axioms"), specified, lone,
    ):
        out = out.join(df, by, "full_outer")
    out = out.na.fill(0, [x for x in out.columns if x not in (by, "avg_confidence")])
    return (
        out.withColumn("dedup_ratio", F.round(safe_div(F.col("inferred_triples"), F.col("candidate_triples")), 6))
        .withColumn("orphan_ratio", F.round(safe_div(F.col("orphans"), F.col("concepts")), 6))
        .withColumn("domain_range_coverage", F.round(safe_div(F.col("specified"), F.col("relations")), 6))
    )


def bleu_items(pairs: DataFrame) -> DataFrame:
    """``pairs(item_id, reference, hypothesis)`` with a sentence BLEU each."""
    return pairs.where("trim(reference) <> '' and trim(hypothesis) <> ''").withColumn("bleu", S.bleu_udf("reference", "hypothesis"))


def bleu_report(items: DataFrame, low: float = 0.2) -> DataFrame:
    return items.agg(F.count("*").alias("pairs"), F.round(F.avg("bleu"), 4).alias("avg"), F.round(F.median("bleu"), 4).alias("median"), F.round(F.max("bleu"), 4).alias("max"), F.round(F.min("bleu"), 4).alias("min"), F.count_if(F.col("bleu") < low).alias("low"))


def ontology_structure(classes: DataFrame, properties: DataFrame, links: DataFrame, seed_classes: int = 0, seed_properties: int = 0) -> DataFrame:
    """Counts, coverages, repeated labels, depth, nodes on cycles and growth, in one row.

    ``classes(label, description)``, ``properties(label, description, domain, range)``, ``links(child, parent)``.
    """
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    c = classes.agg(F.count("*").alias("classes"), filled("description").alias("cd"))
    p = properties.agg(F.count("*").alias("properties"), filled("description").alias("pd"), filled("domain").alias("with_domain"), filled("range").alias("with_range"))
    again = lambda df, name: df.select(N.evaluation(F.col("label")).alias("l")).where("l <> ''").agg((F.count("*") - F.count_distinct("l")).alias(name))
    norm = links.select(N.evaluation(F.col("child")).alias("child"), N.evaluation(F.col("parent")).alias("parent"))
    depth = depths(norm).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    ring = on_cycles(norm).agg(F.count("*").alias("nodes_on_cycles"))
    rows = [c, p, again(classes, "repeated_classes"), again(properties, "repeated_properties"), links.agg(F.count("*").alias("links")), depth, ring]
    out = None
    for r in rows:  # one row each
        r = r.withColumn("_k", F.lit(1))
        out = r if out is None else out.join(r, "_k")
    total, seed = F.col("classes") + F.col("properties"), seed_classes + seed_properties
    delta = F.greatest(total - seed, F.lit(0))
    return out.select(
        "classes", "properties", "links", "repeated_classes", "repeated_properties", "depth", "nodes_on_cycles",
        F.round(safe_div(F.col("cd") + F.col("pd"), total), 6).alias("description_coverage"), F.round(safe_div(F.col("with_domain"), F.col("properties")), 6).alias("domain_coverage"),
        F.round(safe_div(F.col("with_range"), F.col("properties")), 6).alias("range_coverage"), delta.alias("delta"),
        (F.round(delta / seed, 6) if seed else (delta > 0).cast("double")).alias("growth"),
    )


def hierarchy_scores(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mean depth of concepts, each following one parent (the last one given), and the share without a parent."""
    one = links.select(N.benchmark(F.col("child")).alias("child"), N.benchmark(F.col("parent")).alias("parent"), "ord").groupBy("child").agg(F.max_by("parent", "ord").alias("parent"))
    up = closure(one).where("node <> ancestor").groupBy("node").agg(F.count("*").alias("depth"))
    c = concepts.select(N.benchmark(F.col("label")).alias("node")).distinct().join(up, "node", "left").join(one.select(F.col("child").alias("node")).withColumn("has", F.lit(1)), "node", "left")
    return c.agg(F.round(F.avg(F.coalesce("depth", F.lit(0))), 2).alias("avg_depth"), F.round(safe_div(F.count_if(F.col("has").isNull()), F.count("*")), 4).alias("orphan_ratio"))


def domain_ranges(axioms: DataFrame, by: str = "doc_id") -> DataFrame:
    """``(by, relation, domain, range)``: domains and ranges of the same subject."""
    d = axioms.where("axiom_type = 'relation_domain' and object_label <> ''").select(by, "subject_id", F.col("subject_label").alias("relation"), F.col("object_label").alias("domain"))
    r = axioms.where("axiom_type = 'relation_range' and object_label <> ''").select(by, "subject_id", F.col("object_label").alias("range"))
    return d.join(r, [by, "subject_id"]).select(by, "relation", "domain", "range")


def predicate_only(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the sets of relations."""
    p, g = (df.select(N.benchmark(F.col("relation")).alias("r")).where("r <> ''").distinct() for df in (pred, gold))
    return exact_prf(p, g, ["r"])


def strict_sets(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of two sets of rows."""
    return exact_prf(pred.select(*keys).distinct(), gold.select(*keys).distinct(), keys)


def semantic_detail(triples: DataFrame, classes: DataFrame, properties: DataFrame, node_threshold: float = 0.92, predicate_threshold: float = 0.90, strict_schema: bool = True) -> DataFrame:
    """Triples with their ends and relation found in an ontology, and whether domain and range hold.

    Labels are joined by equality first; the rest go to the nearest label. ``classes(label, ord)``,
    ``properties(label, ord, domain, range)``.
    """
    from lodeweave.operators.matching import best_match

    nodes = best_match(triples.select(F.col("head").alias("label")).unionByName(triples.select(F.col("tail").alias("label"))), classes.select("label", "ord"), node_threshold)
    rels = best_match(triples.select(F.col("relation").alias("label")), properties.select("label", "ord"), predicate_threshold)
    t = triples
    for c in ("head", "tail"):
        t = t.join(nodes.select(F.col("label").alias(c), F.col("match").alias(f"{c}_class")), c, "left")
    t = t.join(rels.select(F.col("label").alias("relation"), F.col("match").alias("property")), "relation", "left")
    t = t.join(properties.groupBy(F.col("label").alias("property")).agg(F.min_by("domain", "ord").alias("domain"), F.min_by("range", "ord").alias("range")), "property", "left")
    same = lambda a, b: N.schema_compact(F.col(a)) == N.schema_compact(F.col(b))
    missing = F.lit(not strict_schema)
    return (
        t.withColumn("empty", (F.coalesce("head", F.lit("")) == "") | (F.coalesce("tail", F.lit("")) == "") | (F.coalesce("relation", F.lit("")) == ""))
        .withColumn("domain_ok", F.when(F.col("domain").isNull() | F.col("head_class").isNull(), missing).otherwise(same("domain", "head_class")))
        .withColumn("range_ok", F.when(F.col("range").isNull() | F.col("tail_class").isNull(), missing).otherwise(same("range", "tail_class")))
        .withColumn("conforms", ~F.col("empty") & F.col("property").isNotNull())
    )


def semantic_summary(detail: DataFrame, provenance: str = "has_provenance") -> DataFrame:
    """STR, CR, PC, OC, CV and DVS of the detail table, from one aggregate of counts."""
    share = lambda c: F.round(safe_div(F.count_if(c), F.count("*")), 6)
    invalid = F.col("empty") | ~F.col("conforms") | ~F.col("domain_ok") | ~F.col("range_ok")
    s = detail.agg(
        share(F.col("head_class").isNotNull() & F.col("tail_class").isNotNull() & F.col("property").isNotNull()).alias("STR"), share(invalid).alias("CR"), share(F.coalesce(F.col(provenance), F.lit(False))).alias("PC"),
        share(F.col("conforms")).alias("OC"), share(~F.col("domain_ok") | ~F.col("range_ok")).alias("CV"), F.count("*").alias("n"),
    )
    good = (F.col("STR") >= 0.95) & (F.col("CR") <= 0.05) & (F.col("PC") >= 0.95) & (F.col("OC") >= 0.95) & (F.col("CV") <= 0.05)
    return s.withColumn("DVS", good.cast("double"))


def harmonic(*parts: Column) -> Column:
    """The harmonic mean; 0 if a part is missing or not positive."""
    ok, total = F.lit(True), F.lit(0.0)
    for p in parts:
        ok = ok & F.coalesce(p > 0, F.lit(False))
        total = total + 1.0 / p
    return F.when(ok, len(parts) / total).otherwise(0.0)


def alignment(detail: DataFrame) -> DataFrame:
    """Rates at which a graph's labels are in its ontology, and their harmonic mean."""
    s = detail.agg(
        F.count("*").alias("triples"), F.avg(F.col("head_class").isNotNull().cast("double")).alias("subject_rate"), F.avg(F.col("tail_class").isNotNull().cast("double")).alias("object_rate"),
        F.avg(F.col("property").isNotNull().cast("double")).alias("predicate_rate"), F.avg(F.col("domain_ok").cast("double")).alias("domain_rate"), F.avg(F.col("range_ok").cast("double")).alias("range_rate"),
    )
    node = harmonic(F.col("subject_rate"), F.col("object_rate"))
    return s.select("triples", *[F.round(c, 6).alias(c) for c in ("subject_rate", "object_rate", "predicate_rate", "domain_rate", "range_rate")], F.round(node, 6).alias("node_alignment"), F.round(harmonic(node, F.col("predicate_rate")), 6).alias("alignment"))


def source_grounding(triples: DataFrame, chunks: DataFrame, markers: dict[str, list[str]], record_marker: str = r"(?i)\b(alarm|message|alarme)\b", need_record: bool = True) -> DataFrame:
    """Five signals of grounding per triple and their weighted score (.20 .15 .20 .25 .20, at most 1).

    ``triples(doc_id, id, head, relation, tail, chunk_id, has_provenance)``, ``chunks(doc_id, chunk_id, chunk)``.
    Grounded: provenance, record marker (unless not asked for), a marker of the relation, and both ends.
    """
    t = triples.join(chunks.select("doc_id", "chunk_id", N.grounding(F.col("chunk")).alias("_t")), ["doc_id", "chunk_id"], "left").withColumn("_t", F.coalesce("_t", F.lit("")))
    words = F.filter(F.split("_t", r"[^a-z0-9]+"), lambda w: F.length(w) >= 2)

    def end(c: str) -> Column:
        n = N.grounding(F.col(c))
        own = F.array_distinct(F.filter(F.split(n, r"[^a-z0-9]+"), lambda w: F.length(w) >= 2))
        k = F.size(own)
        return (n != "") & (F.contains(F.col("_t"), n) | (F.size(F.array_intersect(own, words)) >= F.greatest(F.lit(2), F.least(F.lit(4), F.floor(k / 2)))))

    rel = F.lit(False)
    for r, ms in markers.items():
        hit = F.lit(False)
        for m in ms:
            hit = hit | F.contains(F.col("_t"), N.grounding(F.lit(m)))
        rel = rel | (F.upper("relation") == r) & hit
    d = t.withColumn("s_prov", F.coalesce("has_provenance", F.lit(False))).withColumn("s_record", F.col("_t").rlike(record_marker)).withColumn("s_rel", rel).withColumn("s_head", end("head")).withColumn("s_tail", end("tail"))
    both = F.col("s_head") & F.col("s_tail")
    score = 0.20 * F.col("s_prov").cast("int") + 0.15 * F.col("s_record").cast("int") + 0.20 * F.col("s_rel").cast("int") + 0.25 * both.cast("int") + 0.20 * (F.col("s_record") & both).cast("int")
    ok = F.col("s_prov") & F.col("s_rel") & both & (F.col("s_record") if need_record else F.lit(True))
    return d.select("doc_id", "id", F.round(F.least(score, F.lit(1.0)), 6).alias("score"), ok.alias("grounded"))


def panel(votes: DataFrame, agree: float = 0.5) -> DataFrame:
    """``votes(triple_id, judge, verdict, score)`` to one verdict per triple: the majority's, or inconclusive."""
    s = votes.groupBy("triple_id").agg(F.count("*").alias("judges"), F.count_if(F.col("verdict") == "correct").alias("yes"), F.count_if(F.col("verdict") == "incorrect").alias("no"), F.round(F.avg("score"), 6).alias("score"))
    verdict = F.when(F.col("yes") > agree * F.col("judges"), "correct").when(F.col("no") > agree * F.col("judges"), "incorrect").otherwise("inconclusive")
    return s.withColumn("verdict", verdict)


def recover_json(df: DataFrame, text: str) -> DataFrame:
    """Adds ``json``: the first balanced JSON object in a model's answer, fences and prose around it dropped; null if there is none."""

    def first(t: str | None) -> str | None:
        depth, start, quoted, skip = 0, -1, False, False
        for i, ch in enumerate(t or ""):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"' and depth:
                quoted = True
            elif ch == "{":
                start = i if not depth else start
                depth += 1
            elif ch == "}" and depth:
                depth -= 1
                if not depth:
                    return t[start : i + 1]
        return None

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(json=[first(t) for t in pdf[text]])

    return df.mapInPandas(read, f"{schema}, json string")


def dataset_scores(gold: DataFrame, predictions: DataFrame, keys: list[str], pooled: bool = False) -> DataFrame:
    """Exact scores of a dataset; documents without a prediction count with none. ``pooled`` ignores documents."""
    use = [k for k in keys if not (pooled and k == "doc_id")]
    return exact_prf(predictions, gold, use)


def select_weak(triples: DataFrame, grounding: DataFrame, confidence: float = 0.6, score: float = 0.5) -> DataFrame:
    """Triples for a judge: those with a low confidence, a low grounding score or none."""
    j = triples.join(grounding.select("id", F.col("score").alias("_g")), "id", "left")
    return j.where((F.coalesce("confidence", F.lit(0.0)) < confidence) | (F.coalesce("_g", F.lit(0.0)) < score)).drop("_g")
