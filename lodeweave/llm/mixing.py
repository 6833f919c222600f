"""Sources mixed to target shares of tokens, small sources repeated a capped number of times.

Token counts of a public tokenizer give each source its natural share. Temperature mixing raises
shares to a power and normalises them; the power is found by bisection:

* towards targets (``mix`` without ``entropy``): target shares to the power times the shares of what
  the sources may give at most to the rest of it; the power is the largest (1: the targets exactly)
  at which the budget needs no source more often than its limit;
* towards an entropy (``entropy``): natural shares to the power (1: as they are, 0: all alike), the
  largest at which the mixture has that entropy, or "targets" for the entropy of the target shares.

Without a budget it is the largest that the limits allow at these weights, so the targets are met
exactly. The weights are realised as budgeted block permutations: each pass over a source takes its
documents in a new random order of blocks, and the last pass stops where the budget is used up.
Only sums per source and block are ordered; no task sorts a whole source.

Sources without a target get no share, sources without documents none of theirs (it goes to the
others in proportion); both are reported. Null and empty texts have no tokens and are never taken.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.session import cut

#: Ranks of a public byte-level BPE vocabulary of 50,256 entries (a file of base64 token and rank per line, as published
#: with the vocabulary under many names) and the pattern that goes with it; both are parameters, nothing of them is kept here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def temperature(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares to a power, normalised."""
    raw = {s: x**exponent if x > 0 else 0.0 for s, x in shares.items()}
    total = sum(raw.values())
    return {s: x / total if total else 0.0 for s, x in raw.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in shares.values() if x > 0)


def bisect(good: Callable[[float], bool], low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The largest exponent between low (good) and high that is good."""
    if good(high):
        return high
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def exponent_for_entropy(shares: dict[str, float], target: float) -> float:
    """The largest exponent (0: all alike, 1: as they are, up to 16) at which temperature mixing has the entropy wanted."""
    return bisect(lambda e: entropy(temperature(shares, e)) >= target, 0.0, 16.0)


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None, goal_entropy: float | str | None = None) -> tuple[dict[str, float], int, float]:
    """Weights per source, the budget in tokens, and the exponent; see the module's text.

    A budget beyond all limits together is reduced to what they allow. With an entropy and a budget that would need a
    source more often than its limit, the exponent goes towards 1 until it does not; if it still does, the budget is reduced.
    """
    live = {s: (t, max(1, r)) for s, (t, r) in targets.items() if t and t > 0 and tokens.get(s, 0) > 0}
    if not live:
        return {}, 0, 1.0
    room = {s: live[s][1] * tokens[s] for s in live}
    goal = temperature({s: t for s, (t, _) in live.items()}, 1.0)
    most = lambda w: int(min(room[s] / w[s] for s in live if w[s] > 0))
    fits = lambda w: budget is None or all(w[s] * budget <= room[s] * (1 + 1e-12) for s in live)
    budget = None if budget is None else min(budget, sum(room.values()))
    if goal_entropy is None:
        full = temperature({s: float(x) for s, x in room.items()}, 1.0)
        weights = lambda e: temperature({s: goal[s] ** e * full[s] ** (1 - e) for s in live}, 1.0)
        e = bisect(lambda x: fits(weights(x)))
    else:
        natural = temperature({s: float(tokens[s]) for s in live}, 1.0)
        weights = lambda e: temperature(natural, e)
        e = exponent_for_entropy(natural, entropy(goal) if goal_entropy == "targets" else float(goal_entropy))
        if not fits(weights(e)) and e < 1.0:
            e = 1.0 - bisect(lambda x: fits(weights(1.0 - x)), 0.0, 1.0 - e)
    w = weights(e)
    return w, budget if budget is not None and fits(w) else most(w), e


def count_tokens(documents: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, source, n_tokens)``; the whole text of each document is encoded."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
        enc = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInPandas(count, f"doc_id {kind}, source string, n_tokens bigint")


def mix(documents: DataFrame, targets: DataFrame, budget: int | str | None = None, entropy: float | str | None = None, seed: int = 7, blocks: int | None = None, ranks: str = RANKS, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """The mixture ``(source, pass, doc_id, n_tokens)`` and the report of shares.

    The report has a row for each source of either table: tokens there are, target, planned and actual share, how often it is
    repeated (1.5: once and a half), the exponent and the budget. A budget of "corpus" is all tokens of the sources that have a
    target, an entropy of "targets" that of the target shares. Unless ``blocks`` is given, a block of a source
    holds about 20,000 documents at most, since the block in which the budget ends is ordered by one task.
    """
    spark = documents.sparkSession
    counted = cut(count_tokens(documents, ranks, pattern))
    named = counted.where("source is not null and n_tokens > 0")
    per_source = named.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()  # one row per source
    tokens = {r[0]: int(r[1]) for r in per_source}
    blocks = blocks or max(256, max((r[2] for r in per_source), default=0) // 20_000)
    wanted = {r[0]: (r[1], r[2]) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).collect()}
    if budget == "corpus":
        budget = sum(n for s, n in tokens.items() if s in wanted)
    weights, total, exponent = plan(tokens, wanted, budget, entropy)
    shares = spark.createDataFrame([(s, int(w * total), w) for s, w in weights.items()], "source string, share_tokens bigint, planned double")
    block = lambda p: F.pmod(F.xxhash64(F.lit(seed), p, F.col("doc_id")), F.lit(blocks))
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("share_tokens") / F.col("all")).cast("int") - 1)).alias("pass")
    sums = named.groupBy("source").agg(F.sum("n_tokens").alias("all"))
    slots = shares.join(sums, "source").where("share_tokens > 0").select("source", "share_tokens", "all", passes)
    dealt = named.join(F.broadcast(slots), "source").withColumn("block", block(F.col("pass")))  # slots: sources x passes, both bounded by the targets
    left = F.least(F.col("share_tokens") - F.col("pass") * F.col("all"), F.col("all"))
    dealt = dealt.withColumn("room", left)
    per_block = dealt.groupBy("source", "pass", "block").agg(F.sum("n_tokens").alias("in_block"))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "block")
    before = per_block.withColumn("before", F.sum("in_block").over(order) - F.col("in_block"))  # at most ``blocks`` rows per pass
    placed = dealt.join(before, ["source", "pass", "block"])
    whole = placed.where("before + in_block <= room")
    edge = placed.where("before < room and before + in_block > room")
    inner = Window.partitionBy("source", "pass", "block").orderBy(F.xxhash64(F.lit(seed), "pass", "doc_id", F.lit(1)), "doc_id")
    cut_at = edge.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).where("upto - n_tokens / 2 <= room").drop("upto")  # one block per source: the last pass's
    taken = cut(whole.unionByName(cut_at).select("source", "pass", "doc_id", "n_tokens"))
    got = taken.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("n_docs"))
    report = (
        targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .join(sums.withColumnRenamed("all", "tokens"), "source", "full_outer")
        .join(got, "source", "left")
        .join(shares.select("source", "planned"), "source", "left")
        .withColumn("sum_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))))  # one row per source
        .select(
            "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.round(F.coalesce("planned", F.lit(0.0)), 6).alias("planned_share"), F.round(F.coalesce(F.col("mixed_tokens") / F.col("sum_tokens"), F.lit(0.0)), 6).alias("actual_share"),
            F.round(F.coalesce(F.col("mixed_tokens") / F.col("tokens"), F.lit(0.0)), 6).alias("repeats"),
            F.lit(round(exponent, 6)).alias("exponent"), F.lit(total).cast("bigint").alias("budget"),
        )
    )
    return taken, report
