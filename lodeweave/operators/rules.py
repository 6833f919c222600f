"""Vocabularies, mapping rules and rule-based closures of relation benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import normalizers as N
from lodeweave.operators.keys import keep_first
from lodeweave.operators.triples import top_per_group


def vocabulary(records: DataFrame, relations: str = "relations") -> DataFrame:
    """``(relation, n)``: keys of the relation maps, with the number of records that have them."""
    return records.select(F.explode(F.map_keys(relations)).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


def merge_vocabularies(parts: list[DataFrame]) -> DataFrame:
    """``(relation, aliases)`` of several vocabularies together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("relation").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def alias_index(entities: DataFrame, by: str = "doc_id") -> DataFrame:
    """``(by, alias, id)``: each alias of a document once; the first entity that has it keeps it."""
    a = entities.select(by, "id", "ord", F.posexplode("aliases").alias("k", "alias"))
    a = a.select(by, "id", "ord", "k", N.docred(F.col("alias")).alias("alias")).where("alias <> ''")
    return a.groupBy(by, "alias").agg(F.min_by("id", F.struct("ord", "k", "id")).alias("id"))


def link_ends(predictions: DataFrame, index: DataFrame, by: str = "doc_id") -> DataFrame:
    """Predictions with the ids of their ends, null where no alias fits."""
    out = predictions
    for c in ("head", "tail"):
        out = out.withColumn("_a", N.docred(F.col(c))).join(index.select(by, F.col("alias").alias("_a"), F.col("id").alias(f"{c}_id")), [by, "_a"], "left").drop("_a")
    return out


def strict_entities_relations(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Counts of the global sets ``(doc_id, head_id, relation, tail_id)``: in both, only predicted, only gold."""
    k = ["doc_id", "head_id", "relation", "tail_id"]
    g, p = (df.select(*k).na.drop().distinct() for df in (gold, pred))
    parts = [("tp", p.intersect(g)), ("fp", p.exceptAll(g)), ("fn", g.exceptAll(p))]
    out = None
    for name, df in parts:
        one = df.groupBy().agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
        out = one if out is None else out.join(one, "_k")
    return out.drop("_k")


def apply_rules(df: DataFrame, rules: list[tuple[Column, str | None, str]]) -> DataFrame:
    """Adds ``mapped`` and ``reason``: the first rule ``(condition, relation or None to reject, reason)`` that holds; else the relation stays."""
    mapped, reason = F.col("relation"), F.lit("kept")
    for condition, to, why in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        mapped = F.when(hit, F.lit(to).cast("string")).otherwise(mapped)
        reason = F.when(hit, why).otherwise(reason)
    return df.withColumn("mapped", mapped).withColumn("reason", reason)


def type_rules(constraints: dict[str, tuple[list[str], list[str]]], relabel: dict[str, str] | None = None) -> list[tuple[Column, str | None, str]]:
    """Rules from type constraints: relations whose ends have other types are renamed if a name is given, else rejected."""
    out = []
    for rel, (heads, tails) in constraints.items():
        wrong = (F.col("relation") == rel) & ~(F.col("head_type").isin(*heads) & F.col("tail_type").isin(*tails))
        out.append((wrong, (relabel or {}).get(rel), "relabelled_type" if rel in (relabel or {}) else "type_mismatch"))
    return out


def direct_checks(df: DataFrame, vocabulary_: list[str]) -> DataFrame:
    """Adds ``reasons``: why a direct extraction is rejected (empty: accepted)."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reasons = F.array_compact(
        F.array(
            F.when(empty("head"), "missing_head"), F.when(empty("tail"), "missing_tail"), F.when(~F.coalesce(F.col("relation").isin(*vocabulary_), F.lit(False)), "unknown_relation"),
            F.when(~empty("head") & (N.docred(F.col("head")) == N.docred(F.col("tail"))), "self_relation"),
        )
    )
    return df.withColumn("reasons", reasons)


def merge_predictions(parts: list[DataFrame], order: list) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return keep_first(every, ["doc_id", N.docred(F.col("head")), F.col("relation"), N.docred(F.col("tail"))], order)


def propagate(triples: DataFrame, containment: str, to: str) -> DataFrame:
    """``x to c`` from ``x to y`` and ``y containment c``."""
    from lodeweave.operators.graph import two_hop

    return two_hop(triples, to, containment, to)


def date_triples(texts: DataFrame, relation: str = "point in time") -> DataFrame:
    """``(doc_id, head, relation, tail)`` for entities followed by a date within their sentence."""
    pattern = r"(\d{1,2} \p{L}+ \d{4}|\d{4}-\d{2}-\d{2}|\b(?:1[5-9]|20)\d{2}\b)"
    at = F.position(F.lower("entity"), F.lower("sentence"))
    rest = F.when(at > 0, F.col("sentence").substr(at + F.length("entity"), F.length("sentence")))
    date = F.nullif(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return texts.select("doc_id", F.col("entity").alias("head"), F.lit(relation).alias("relation"), date.alias("tail")).where("tail is not null").distinct()


def near(text: Column, aliases: Column, words: list[str], window: int = 80) -> Column:
    """Whether a word stands within ``window`` characters of any occurrence of an alias of three letters or more."""
    t = F.lower(text)

    def around(a: Column) -> Column:
        parts = F.split(t, F.concat(F.lit("\\Q"), F.lower(a), F.lit("\\E")), -1)
        edge = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        n = F.size(parts)
        close = lambda x: F.concat(F.when(x["i"] > 0, F.substring(x["p"], 1, window)).otherwise(""), F.lit(" "), F.when(x["i"] < n - 1, F.right(x["p"], F.lit(window))).otherwise(""))
        hit = F.lit(False)
        joined = F.array_join(F.transform(edge, close), " ")
        for w in words:
            hit = hit | F.contains(joined, F.lit(w.lower()))
        return (n > 1) & hit

    return F.coalesce(F.exists(F.filter(aliases, lambda a: F.length(a) >= 3), around), F.lit(False))


def pick_place(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``(doc_id, place)``: the place named most clearly in a text: tiers of names 100 to 20, plus 10 for each occurrence and 5 more.

    ``names(place, alias, tier)``; texts meet aliases on words.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    d = docs.select("doc_id", F.explode(words).alias("w"))
    low = docs.select("doc_id", F.lower("text").alias("t"))
    a = names.select("place", F.lower("alias").alias("alias"), "tier", F.element_at(F.split(F.lower("alias"), r"[^\p{L}]+"), 1).alias("w"))
    hits = d.join(a, "w").drop("w").distinct().join(low, "doc_id").withColumn("n", (F.length("t") - F.length(F.replace(F.col("t"), F.col("alias"), F.lit("")))) / F.length("alias")).where("n > 0")
    s = hits.groupBy("doc_id", "place").agg(F.max(F.col("tier") + 10 * F.col("n") + 5).alias("score"))
    return s.groupBy("doc_id").agg(F.max_by("place", F.struct("score", "place")).alias("place"))


def relation_family(df: DataFrame, by_type: dict[str, list[str]], by_word: dict[str, list[str]], every: list[str]) -> DataFrame:
    """Adds ``relations``: those that a text's entity types and words suggest, all of them if there are none."""
    none = F.array().cast("array<string>")
    out = none
    for kind, ids in by_type.items():
        out = F.array_union(out, F.when(F.array_contains("types", kind), F.array(*[F.lit(i) for i in ids])).otherwise(none))
    for word, ids in by_word.items():
        out = F.array_union(out, F.when(F.contains(F.lower("text"), F.lit(word)), F.array(*[F.lit(i) for i in ids])).otherwise(none))
    return df.withColumn("relations", F.when(F.size(out) > 0, out).otherwise(F.array(*[F.lit(e) for e in every])))


def evidence_links(mentions: DataFrame, most: int = 16) -> DataFrame:
    """``(doc_id, window, a, b)``: ordered pairs of entities in one window; at most ``most`` partners each, the operator's limit."""
    m = mentions.select("doc_id", "window", "entity").distinct()
    first = top_per_group(m, ["doc_id", "window"], ["entity"], most + 1)  # nobody has partners beyond these
    pairs = m.withColumnRenamed("entity", "a").join(first.withColumnRenamed("entity", "b"), ["doc_id", "window"]).where("a <> b")
    return top_per_group(pairs, ["doc_id", "window", "a"], ["b"], most)


def parse_tuples(df: DataFrame, text: str = "text") -> DataFrame:
    """Records of the form ``("entity"<|>name<|>type<|>description)##...``: ``(.., pos, kind, fields)``."""
    keys = [c for c in df.columns if c != text]
    rec = df.select(*keys, F.posexplode(F.split(text, "##")).alias("pos", "r"))
    inner = F.regexp_extract(F.col("r"), r"(?s)\((.*)\)", 1)
    parts = F.transform(F.split(inner, r"<\|>"), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    return rec.select(*keys, "pos", F.lower(F.element_at(parts, 1)).alias("kind"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("fields")).where("kind in ('entity', 'relationship')")


def few_shots(docs: DataFrame, target_id, k: int = 3, seed: int = 7) -> DataFrame:
    """k documents with annotations other than the target, chosen by a seeded hash (a sample is what the operator is for)."""
    pool = docs.where((F.col("doc_id") != F.lit(target_id)) & (F.col("n_annotations") > 0))
    return pool.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(k)


def diagnosis(relations: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent relation labels with their counts."""
    n = relations.groupBy("relation").agg(F.count("*").alias("n"))
    first = n.orderBy(F.col("n").desc(), "relation").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "relation")))  # k rows


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of what two tables have in common and what only one has."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full_outer")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))
