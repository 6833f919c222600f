"""Triples of several stages merged into clusters, ranked, and compared stage by stage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import normalizers as N
from lodeweave.functions import similarity as S
from lodeweave.operators.metrics import harmonic, safe_div

#: Words too general for an entity's name.
GENERIC_TERMS = ("message", "alarm", "alarme", "operator", "system", "machine", "component", "condition", "action", "issue", "problem", "error", "warning", "fault")


def verbosity(label: Column) -> Column:
    n = F.size(F.filter(F.split(N.consolidation(label), " "), lambda w: w != ""))
    return F.when(n <= 8, 0.0).otherwise(F.least(F.lit(1.0), (n - 8) / 20.0))


def generic(label: Column) -> Column:
    t = N.tokens(N.consolidation(label))
    g = F.array(*[F.lit(w) for w in GENERIC_TERMS])
    hit = F.size(F.array_intersect(t, g))
    return F.when(F.size(t) == 0, 0.5).when((F.size(t) <= 2) & (hit > 0), 0.35).when(hit == F.size(t), 0.5).otherwise(0.0)


def exact_clusters(records: DataFrame) -> DataFrame:
    """Clusters of records ``(stop, head, predicate, tail, confidence, ord)`` with equal keys, each with its most frequent labels.

    Of labels equally frequent the shortest stands for the cluster, then the first in the alphabet.
    """
    r = records.select("*", N.consolidation(F.col("head")).alias("h"), N.relation(F.col("predicate")).alias("p"), N.consolidation(F.col("tail")).alias("t"))
    keys = ["h", "p", "t"]

    def label(c: str) -> DataFrame:
        n = r.groupBy(*keys, F.trim(c).alias("_l")).agg(F.count("*").alias("_n"))
        return n.groupBy(*keys).agg(F.min_by("_l", F.struct(-F.col("_n"), F.length("_l"), F.lower("_l"), F.col("_l"))).alias(c))

    s = r.groupBy(*keys).agg(
        F.count("*").alias("support"), F.count_distinct("stop").alias("layers"), F.min("stop").alias("first_seen"), F.max("stop").alias("last_seen"),
        F.avg("confidence").alias("confidence"), F.min("ord").alias("ord"), F.array_sort(F.collect_set("stop")).alias("stops"),
    )
    return s.join(label("head"), keys).join(label("tail"), keys).withColumnRenamed("p", "predicate")


def cluster_score(clusters: DataFrame, stop: int) -> DataFrame:
    """Adds ``score``: support over the stages, repetition, recency and confidence, less what general or long labels cost."""
    recency = F.when(F.array_contains("stops", stop), 1.0).otherwise(0.5 + 0.5 * F.col("last_seen") / max(1, stop))
    penalty = 0.35 * generic(F.col("head")) + 0.35 * generic(F.col("tail")) + 0.20 * verbosity(F.col("head")) + 0.20 * verbosity(F.col("tail"))
    score = 2.25 * F.col("layers") / max(1, stop + 1) + 1.10 * F.log1p("support") + 0.85 * recency + 0.40 * F.coalesce("confidence", F.lit(0.5)) - penalty
    return clusters.withColumn("score", score)


def select_clusters(scored: DataFrame, budget: int | None = 226, least: float | None = None) -> DataFrame:
    """The best clusters by score, then support, then age; the budget is what the operator is for."""
    s = scored if least is None else scored.where(F.col("score") >= least)
    order = [F.col("score").desc(), F.col("support").desc(), "ord"]
    return s.orderBy(*order).limit(budget) if budget else s


def fuzzy_clusters(records: DataFrame, threshold: float = 0.86) -> DataFrame:
    """Records with the cluster each one joins, in their order: one with its key, else the most similar of its predicate, else a new one.

    Predicates do not meet, so each is decided by itself. Only distinct keys, in the order of their first record,
    reach the function; the records join its answer.
    """
    r = records.select("*", N.consolidation(F.col("head")).alias("h"), N.relation(F.col("predicate")).alias("p"), N.consolidation(F.col("tail")).alias("t"))
    keys = r.groupBy("p", "h", "t").agg(F.min("ord").alias("first"))

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k in _by_predicate(batches):
            yield k[["p", "h", "t"]].assign(cluster=k["first"].to_numpy()[founders(k["h"].tolist(), k["t"].tolist(), threshold)])

    # A number given is kept: by their bytes the predicates would end up in very few tasks.
    tasks = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartition(tasks, "p").sortWithinPartitions("p", "first", "h", "t")
    got = ordered.mapInPandas(cluster, f"p string, h string, t string, cluster {keys.schema['first'].dataType.simpleString()}")
    return r.join(got, ["p", "h", "t"]).drop("h", "t")


def _by_predicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each predicate together; they come sorted by it."""
    parts: list[pd.DataFrame] = []
    for b in batches:
        for p, rows in b.groupby("p", sort=False):
            if parts and parts[0]["p"].iloc[0] != p:
                yield pd.concat(parts, ignore_index=True)
                parts = []
            parts.append(rows)
    if parts:
        yield pd.concat(parts, ignore_index=True)


#: Keys decided at once, at least; keys and labels compared in one table; pairs held at once.
BLOCK, ROWS, COLUMNS, PAIRS = 1000, 512, 8192, 1_000_000
#: Bounds are single precision.
SLACK = 1e-5


def founders(heads: list[str], tails: list[str], threshold: float = 0.86) -> np.ndarray:
    """For each key of one predicate, in order, the place of the key that founded its cluster.

    A key joins the most similar founder before it, of equal ones the first, if that is similar enough, else it founds
    a cluster. Blocks of keys are compared with the founders so far and with each other; only the few pairs
    that are similar enough are then gone through in order.
    """
    places = [pd.factorize(np.array(x, dtype=object)) for x in (heads, tails)]
    sides = [(at, S.Texts(list(names))) for at, names in places]
    of, first = np.arange(len(heads)), np.zeros(0, dtype=np.int64)
    start = 0
    while start < len(heads):
        block = np.arange(start, min(len(heads), start + max(BLOCK, len(first) // 2)))
        near: dict[int, list[tuple[float, int]]] = {}
        for i, j, s in _similar(block, np.concatenate((first, block)), sides, threshold):
            for x, y, z in zip(i.tolist(), j.tolist(), s.tolist()):
                near.setdefault(x, []).append((-z, y))
        for i in sorted(near):
            of[i] = min(((s, j) for s, j in near[i] if of[j] == j), default=(0.0, i))[1]
        first = np.concatenate((first, block[of[block] == block]))
        start = int(block[-1]) + 1
    return of


def _score(head, tail):
    return 0.52 * head + 0.42 * tail + 0.06


def _similar(block: np.ndarray, known: np.ndarray, sides: list, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a key of the block and an earlier known one whose similarity is at least ``threshold``, with it.

    Of the founders before the block only the best one of a key is kept: nothing can undo them.
    """
    (h, heads), (t, tails) = sides
    least = (threshold - SLACK - _score(0.0, 1.0)) / 0.52  # a head less similar than this is too far whatever the tails are
    block, known = block[np.argsort(h[block], kind="stable")], known[np.argsort(h[known], kind="stable")]
    names, begins, many = np.unique(h[known], return_index=True, return_counts=True)
    held: list[tuple] = []
    for c in range(0, len(names), COLUMNS):
        for b in range(0, len(block), ROWS):
            rows = block[b : b + ROWS]
            own, place = np.unique(h[rows], return_inverse=True)
            most = heads.bounds(own, names[c : c + COLUMNS])
            x, y = np.nonzero((most >= least)[place])
            for lo, hi in _pieces(many[c + y]):
                n = many[c + y[lo:hi]]
                at = np.repeat(np.arange(lo, hi), n)
                i, j = rows[x[at]], known[np.repeat(begins[c + y[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(len(at))]
                before = j < i
                i, j, ends = i[before], j[before], most[place[x[at]], y[at]][before]
                good = _score(ends, tails.bound(t[i], t[j])) >= threshold - SLACK
                held.append((i[good], j[good]))
                if sum(len(p[0]) for p in held) > PAIRS:
                    yield from _exact(held, block.min(), sides, threshold)
                    held = []
    yield from _exact(held, block.min(), sides, threshold)


def _pieces(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that stand for not much over ``PAIRS`` pairs together."""
    ends, lo = np.cumsum(many), 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        yield lo, hi
        lo = hi


def _exact(held: list[tuple], start: int, sides: list, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not held:
        return
    i, j = (np.concatenate(x) for x in zip(*held))
    (h, heads), (t, tails) = sides
    head = _once(heads, h[i], h[j])
    good = _score(head, tails.bound(t[i], t[j])) >= threshold - SLACK
    i, j, head = i[good], j[good], head[good]
    s = _score(head, _once(tails, t[i], t[j]))
    good = s >= threshold
    i, j, s = i[good], j[good], s[good]
    order = np.lexsort((j, -s, j >= start, i))
    i, j, s = i[order], j[order], s[order]
    again = np.zeros(len(i), dtype=bool)
    again[1:] = (i[1:] == i[:-1]) & (j[1:] < start)
    yield i[~again], j[~again], s[~again]


def _once(texts: S.Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of pairs, each different pair compared once."""
    pairs, at = np.unique(a * texts.n + b, return_inverse=True)
    return texts.near(pairs // texts.n, pairs % texts.n)[at]


def up_to(records: DataFrame, stops: DataFrame) -> DataFrame:
    """Records repeated for each prefix that includes them: those of its stage and before; prefixes are few."""
    return records.join(F.broadcast(stops.select(F.col("stop").alias("prefix"))), F.col("stop") <= F.col("prefix"))  # stops: one row per stage


def layer_contribution(membership: DataFrame, covered: DataFrame) -> DataFrame:
    """New and reinforced clusters and newly covered references per stage, with cumulative coverage.

    ``membership(cluster, stop)`` and ``covered(reference, stop)``.
    """
    first = membership.groupBy("cluster").agg(F.min("stop").alias("first"))
    m = membership.distinct().join(first, "cluster")
    per = m.groupBy("stop").agg(F.count_if(F.col("first") == F.col("stop")).alias("new_clusters"), F.count_if(F.col("first") < F.col("stop")).alias("reinforced"))
    ref = covered.groupBy("reference").agg(F.min("stop").alias("stop")).groupBy("stop").agg(F.count("*").alias("newly_covered"))
    out = per.join(ref, "stop", "left").na.fill(0, ["newly_covered"])
    w = Window.orderBy("stop").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("covered", F.sum("newly_covered").over(w)).withColumn("clusters", F.sum("new_clusters").over(w))  # one row per stage


def inventory(membership: DataFrame) -> DataFrame:
    """First and last stage, span and presence of each cluster."""
    return membership.groupBy("cluster").agg(
        F.min("stop").alias("first"), F.max("stop").alias("last"), (F.max("stop") - F.min("stop") + 1).alias("span"), F.count_distinct("stop").alias("n_stops"),
        F.array_join(F.transform(F.array_sort(F.collect_set("stop")), lambda x: x.cast("string")), ",").alias("present"),
    )


def category(n_stops: Column, final: Column, matched: Column) -> Column:
    """confirmed, adopted, noise or uncertain."""
    return F.when(matched & (n_stops > 1), "confirmed").when(matched & final, "adopted").when(~matched & (n_stops == 1) & ~final, "noise").otherwise("uncertain")


def ablation(counts: DataFrame) -> DataFrame:
    """Robust ablation metrics from ``counts(variant, tp, gold, raw)``; tp, gold and raw are whole numbers."""
    coverage, efficiency = safe_div(F.col("tp"), F.col("gold")), safe_div(F.col("tp"), F.col("raw"))
    r = lambda c: F.round(c, 6)
    return counts.select(
        "variant", "tp", "gold", "raw", r(coverage).alias("coverage"), r(efficiency).alias("efficiency"), r(harmonic(coverage, efficiency)).alias("coverage_efficiency"),
        F.when(F.col("tp") > 0, r(F.col("raw") / F.col("tp"))).alias("overgeneration"), F.when(F.col("tp") > 0, r(F.greatest(F.col("raw") - F.col("tp"), F.lit(0)) / F.col("tp"))).alias("excess_per_match"),
        F.when(F.col("raw") > 0, r(1.0 - efficiency)).otherwise(0.0).alias("noise"), F.when(F.col("gold") > 0, r(1.0 - coverage)).otherwise(0.0).alias("miss_rate"),
        r(safe_div(F.col("raw"), F.col("gold"))).alias("triples_per_gold"), r(100.0 * efficiency).alias("matched_per_100"),
    )


def merge_variants(parts: list[DataFrame], keys: list[Column], order: list) -> DataFrame:
    """Local and inferred triples together, each once."""
    from lodeweave.operators.keys import keep_first

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return keep_first(every, keys, order)
