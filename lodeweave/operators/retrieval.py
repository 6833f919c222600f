"""Context for a query from an ontology, from what is extracted so far, and from offline sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import similarity as S
from lodeweave.operators.extraction import word_grams, word_lengths, words
from lodeweave.operators.triples import top_per_group


def nearest_labels(queries: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """``(query, label, score, rank)``: the k entries most like each query with a score above 0.

    Queries and entries meet on a common pair of letters, without which a match of two letters in a row
    is impossible; entries that share none score next to nothing and are left out.
    """
    pair = lambda c: F.explode(S.trigrams(F.lower(c), 2))
    q = queries.select("query").distinct().withColumn("g", pair("query"))
    e = entries.select("label", "ord").distinct().withColumn("g", pair("label"))
    pairs = q.join(e, "g").select("query", "label", "ord").distinct()
    scored = pairs.withColumn("score", S.matcher_udf(F.lower("query"), F.lower("label"))).where("score > 0")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "ord", "label")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("ord")


def class_context(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``(iri, label, parents, children)``: labels of the classes above and below."""
    names = classes.select("iri", "label")
    up = links.join(names.withColumnsRenamed({"iri": "parent", "label": "pl"}), "parent").groupBy(F.col("child").alias("iri")).agg(F.array_sort(F.collect_set("pl")).alias("parents"))
    down = links.join(names.withColumnsRenamed({"iri": "child", "label": "cl"}), "child").groupBy(F.col("parent").alias("iri")).agg(F.array_sort(F.collect_set("cl")).alias("children"))
    return names.join(up, "iri", "left").join(down, "iri", "left")


def property_context(properties: DataFrame, classes: DataFrame) -> DataFrame:
    """``(iri, label, domain_labels, range_labels)``."""
    out = properties.select("iri", "label")
    for side, col in (("domain_labels", "domains"), ("range_labels", "ranges")):
        x = properties.select("iri", F.explode(col).alias("c")).join(classes.select(F.col("iri").alias("c"), F.col("label").alias("cl")), "c", "left")
        out = out.join(x.groupBy("iri").agg(F.array_sort(F.collect_set(F.coalesce("cl", "c"))).alias(side)), "iri", "left")
    return out


def ontology_space(queries: DataFrame, classes: DataFrame, properties: DataFrame, k: int = 5) -> DataFrame:
    """Classes, then properties, cut to k in all."""
    c = nearest_labels(queries, classes, k).withColumn("kind", F.lit(0))
    p = nearest_labels(queries, properties, k).withColumn("kind", F.lit(1))
    w = Window.partitionBy("query").orderBy("kind", "rank")
    return c.unionByName(p).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("query", F.when(F.col("kind") == 0, "class").otherwise("property").alias("kind"), "label", "score", "pos")


def artifact_space(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """Concepts, relations and triples with the query's text in them: ``items(kind, text, ord)``, k per query.

    A query is looked up by that one of its trigrams (or itself, if it is shorter) which the fewest items
    have, so no query meets every item; it may lie anywhere, also within words.
    """
    q = queries.where("query <> ''").select("query", F.lower("query").alias("low"))
    sizes = sorted(r[0] for r in q.select(F.least(F.length("low"), F.lit(3))).distinct().collect())  # at most 1, 2, 3
    grams = lambda c, ns: F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[S.trigrams(F.col(c), n) for n in ns])))
    own = q.withColumn("g", grams("low", [3]))
    every = items.select("kind", "text", "ord", F.lower("text").alias("lower"), F.xxhash64("kind", "ord", "text").alias("_key"))
    i = every.select("_key", "lower").withColumn("g", grams("lower", sizes)).drop("lower").distinct()
    seen = i.join(own.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "g", "left").groupBy("query", "low").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), F.col("g"))).alias("g"))
    met = q.join(rarest, ["query", "low"])  # a query asked twice is answered twice
    hits = met.join(i, "g").join(every, "_key").where(F.contains("lower", "low")).select("query", "kind", "text", "ord")
    return top_per_group(hits, ["query"], ["ord", "kind", "text"], k)


def taxonomy_hits(docs: DataFrame, taxonomy: DataFrame, most: int = 40) -> DataFrame:
    """``(doc_id, label)``: taxonomy labels whose words, any number of them, follow each other in a text; at most ``most`` per document by the alphabet (the operator's limit)."""
    labels = taxonomy.select("label", F.array_join(words(F.col("label")), " ").alias("g")).distinct()
    grams = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(word_grams(F.col("w"), word_lengths(labels, "g"))).alias("g"))
    hits = grams.join(labels, "g").select("doc_id", "label")
    return top_per_group(hits, ["doc_id"], ["label"], most)


def drop_overlaps(spans: DataFrame) -> DataFrame:
    """Spans ``(doc_id, start, end, label)`` of a document, the longest first, without those that overlap one already taken."""
    kind = "array<struct<len:int,start:int,end:int,label:string>>"
    every = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).cast("int").alias("len"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label"))).cast(kind)
    start = F.array().cast(kind)
    keep = F.aggregate(every, start, lambda acc, s: F.when(F.exists(acc, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return spans.groupBy("doc_id").agg(keep.alias("k")).select("doc_id", F.inline("k")).drop("len")


def context_text(rows: DataFrame, k: int = 5) -> DataFrame:
    """``(query, context)``: the first k snippets as lines."""
    top = F.slice(F.array_sort(F.collect_list(F.struct("pos", "label"))), 1, k)
    return rows.groupBy("query").agg(F.array_join(F.transform(top, lambda x: F.concat(F.lit("- "), x["label"])), "\n").alias("context"))


class Registry:
    """Named retrieval spaces: functions from a table of queries to ``(query, kind, label, score, pos)``."""

    def __init__(self) -> None:
        self._spaces: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, space: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._spaces:
            raise ValueError(f"space {name!r} is registered already")
        self._spaces[name] = space

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self._spaces:
            raise KeyError(f"no space {name!r}; there are: {', '.join(sorted(self._spaces)) or 'none'}")
        return self._spaces[name]

    def names(self) -> list[str]:
        return sorted(self._spaces)

    def ground(self, queries: DataFrame, names: list[str] | None = None, summarize: Callable[[Column], Column] | None = None) -> DataFrame:
        """Selected spaces asked and merged: ``(query, context)``, summarized if a model is given."""
        rows = None
        for i, n in enumerate(names or self.names()):
            r = self.get(n)(queries).select("query", "label", (F.col("pos") + 1000 * i).alias("pos"))
            rows = r if rows is None else rows.unionByName(r)
        if rows is None:
            raise ValueError("no space to ask")
        out = context_text(rows)
        return out.withColumn("context", summarize(F.col("context"))) if summarize else out


def offline_source(lookup: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A space over a table ``(term, text, source)``, in place of an encyclopedia or a web search."""

    def ask(queries: DataFrame) -> DataFrame:
        hits = queries.select("query", F.lower(F.trim("query")).alias("t")).join(lookup.select(F.lower(F.trim("term")).alias("t"), "text", "source"), "t")
        w = Window.partitionBy("query").orderBy("source", "text")
        return hits.select("query", F.col("source").alias("kind"), F.col("text").alias("label"), F.lit(1.0).alias("score"), F.row_number().over(w).alias("pos"))

    return ask


def alias_enrichment(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items with the sorted union of their aliases and those of every key that occurs in their label as a word.

    ``items(id, label, aliases)``, ``aliases(key, aliases)`` with keys of one word.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    hits = items.select("id", F.explode(words).alias("k")).join(aliases.select(F.lower("key").alias("k"), F.col("aliases").alias("more")), "k")
    extra = hits.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"))
    none = F.array().cast("array<string>")
    return items.join(extra, "id", "left").withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("more", none)))).drop("more")
