"""One surviving record for each group of repeated triples, taken bundle by bundle.

Fields that depend on one another form a bundle and are taken from one row: a confidence with its
source, a justification with its chunk, a snippet with its place. Each bundle's candidates are
reduced to the best one per value of the determining attribute by plain aggregates (combined
before the shuffle, so a group that holds a third of all rows is no burden). Which candidates go
together is decided by branch and bound: the sum of their worth is maximised under functional
dependencies, which say that two bundles must agree in an attribute where both have it.

``choose`` takes each field from its own best row, as the order of its candidates says; there the
best candidates of the sources compete and no dependency ties the bundles. ``survivors`` weighs
texts by the trust in their source, and ties the snippet to the chunk of the justification.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.ledger import digest, groups_of, label_key, object_key
from lodeweave.session import cut, salted_join

#: The shortest justification, without spaces at its ends, that counts as one.
LEAST_JUSTIFICATION = 20
#: Trust of a source of rank r is so much less r, at least 1; a source without rank has 1.
TRUST = 100
CANDIDATE = "struct<k1:double,k2:bigint,k3:bigint,attr:string>"


def branch_and_bound(bundles: list[list[tuple]], same_attr: list[tuple[int, int]], weighed: bool = False) -> list[tuple | None]:
    """The best choice of one candidate per bundle (None where there is none).

    A candidate is ``(k1, k2, -row_id, attr)``, better if greater. It is worth k1 if ``weighed``, else as many as there are
    candidates from it down to the worst of its bundle; ``same_attr`` lists pairs of bundles whose attributes must be equal
    unless one is null. A bundle may stay empty, at no gain. Branches whose gain and the best still open cannot
    pass the best found are cut. Of equal choices the one with the better first bundles wins.
    """
    ranked = [sorted(set(b), key=lambda c: (c[0], c[1], c[2]), reverse=True) for b in bundles]
    worth = [[max(c[0], 0.0) if weighed else float(len(b) - k) for k, c in enumerate(b)] for b in ranked]
    tied: dict[int, list[int]] = {i: [] for i in range(len(bundles))}
    for i, j in same_attr:
        tied[max(i, j)].append(min(i, j))
    hope = [0.0] * (len(ranked) + 1)
    for i in range(len(ranked) - 1, -1, -1):
        hope[i] = hope[i + 1] + max(worth[i], default=0.0)
    best: list = [-1.0, []]

    def go(i: int, gain: float, chosen: list) -> None:
        if gain + hope[i] <= best[0]:
            return
        if i == len(ranked):
            best[:] = [gain, list(chosen)]
            return
        for w, c in zip(worth[i], ranked[i]):
            if gain + w + hope[i + 1] <= best[0]:
                break
            if all(chosen[j] is None or chosen[j][3] is None or c[3] is None or chosen[j][3] == c[3] for j in tied[i]):
                go(i + 1, gain + w, [*chosen, c])
        go(i + 1, gain, [*chosen, None])

    go(0, 0.0, [])
    return best[1]


def _best(condition: Column, k1: Column, k2: Column, row_id: Column, attr: Column) -> Column:
    one = F.struct(k1.cast("double").alias("k1"), F.coalesce(k2.cast("bigint"), F.lit(-(2**62))).alias("k2"), (-row_id).alias("k3"), attr.alias("attr"))
    return F.max(F.when(condition, one))


def group_rows(kg: DataFrame) -> DataFrame:
    """The rows of kg_inferred that are in a group of two rows or more, with the group's keep_row_id."""
    labels = [F.col(f"{x}.label").isNotNull() for x in ("subject", "predicate", "object")]
    micros = F.unix_micros(F.col("exported_at").cast("timestamp"))
    rows = cut(
        kg.where(labels[0] & labels[1] & labels[2]).select(
            "row_id", "run_id", "triple_id", "source_code", "chunk_id", "confidence", F.length(F.trim("justification")).alias("just_len"), micros.alias("at"), triple_keys_column(kg).alias("key")
        )
    )  # read by every batch and by the join
    groups, counts = groups_of(rows.select("row_id", "key"))
    return salted_join(rows, groups, ["key"], F.col("row_id"), counts).drop("key")


def triple_keys_column(kg: DataFrame) -> Column:
    return digest(F.col("doc_id").cast("string"), *[label_key(F.col(f"{x}.label")) for x in ("subject", "predicate", "object")], object_key(F.col("metadata")))


def _pick(lists: DataFrame, rules: list[tuple[int, int]], weighed: bool) -> DataFrame:
    """``(keep_row_id, field, from_row_id)`` of the best choice from each group's candidates."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ("confidence", "justification", "snippet")
        for pdf in batches:
            out = []
            for keep, *bundles in zip(pdf["keep_row_id"], pdf["conf"], pdf["just"], pdf["snip"]):
                found = [[(c["k1"], c["k2"], c["k3"], c["attr"]) for c in b] for b in bundles]
                out += [(keep, name, -c[2]) for name, c in zip(fields, branch_and_bound(found, rules, weighed)) if c is not None]
            yield pd.DataFrame(out, columns=["keep_row_id", "field", "from_row_id"])

    return lists.mapInPandas(pick, "keep_row_id bigint, field string, from_row_id bigint")


def candidates(kg: DataFrame, layer5: DataFrame, sources: DataFrame, weighed: bool) -> DataFrame:
    """``(keep_row_id, conf, just, snip)``: the candidates of each group's bundles, the best one per source or, ``weighed``, per chunk."""
    rank = sources.where("source_code is not null").groupBy("source_code").agg(F.min("trust_rank").alias("trust_rank"))
    trust = F.greatest(F.lit(1), F.lit(TRUST) - F.coalesce("trust_rank", F.lit(TRUST))).cast("double")
    rows = cut(group_rows(kg).join(rank, "source_code", "left").withColumn("trust", trust))
    is_set = F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.col("confidence") != -1)
    part = F.col("chunk_id") if weighed else F.col("source_code")
    tied = F.col("part") if weighed else F.lit(None).cast("string")
    worth = lambda n: F.col(n) * F.col("trust") if weighed else F.col(n)
    own = (
        rows.withColumn("part", part)
        .groupBy("keep_row_id", "part")
        .agg(
            _best(is_set, F.col("trust") if weighed else F.coalesce(-F.col("trust_rank"), F.lit(-1e9)), F.col("at"), F.col("row_id"), F.lit(None).cast("string")).alias("conf"),
            _best(F.col("just_len") >= LEAST_JUSTIFICATION, worth("just_len"), F.col("at"), F.col("row_id"), tied).alias("just"),
        )
    )
    longest = F.array_max(F.transform(F.filter("provenance", lambda e: F.trim(e["snippet"]) != ""), lambda e: F.length(e["snippet"])))
    made = F.unix_micros(F.col("created_at").cast("timestamp"))
    l5 = layer5.select("run_id", "triple_id", "row_id", "source_code", part.alias("part"), longest.alias("len"), made.alias("at")).where("len > 0").join(rank, "source_code", "left").withColumn("trust", trust)
    per_triple = l5.groupBy("run_id", "triple_id", "part").agg(_best(F.lit(True), worth("len"), F.col("at"), F.col("row_id"), tied).alias("snip"))
    wanted = rows.select("keep_row_id", "run_id", "triple_id").distinct()
    snips = wanted.join(per_triple, ["run_id", "triple_id"]).groupBy("keep_row_id", "part").agg(F.max("snip").alias("snip"))
    none = F.lit(None).cast(CANDIDATE)
    return (
        own.select("keep_row_id", "conf", "just", none.alias("snip"))
        .unionByName(snips.select("keep_row_id", none.alias("conf"), none.alias("just"), "snip"))
        .groupBy("keep_row_id")
        .agg(*[F.collect_list(c).alias(c) for c in ("conf", "just", "snip")])  # at most one per source, or per chunk of a document
    )


def choose(kg: DataFrame, layer5: DataFrame, sources: DataFrame) -> DataFrame:
    """``(keep_row_id, field, from_row_id)``: the row that each field of each group comes from.

    confidence: the most trusted source among rows with one that is set (not null, not -1, not NaN;
    a source without rank comes last). justification: the longest of at least 20 characters. snippet:
    the layer 5 row with the longest that is not empty. Ties: newest, then least row_id. A field
    without candidates has no row.
    """
    return _pick(candidates(kg, layer5, sources, False), [], False)


def choose_bundles(kg: DataFrame, layer5: DataFrame, sources: DataFrame) -> DataFrame:
    """``(keep_row_id, field, from_row_id)`` of whole bundles that agree in their chunk.

    A confidence is worth the trust in its source, a justification or snippet its length times the trust; the sum is
    maximised, while a snippet comes from the justification's chunk if both have one. Ties as in ``choose``.
    """
    return _pick(candidates(kg, layer5, sources, True), [(1, 2)], True)


def survivors(kg: DataFrame, layer5: DataFrame, sources: DataFrame) -> DataFrame:
    """One record per group, built from whole bundles that agree in their chunk."""
    chosen = cut(choose_bundles(kg, layer5, sources))
    of = lambda name, to: chosen.where(F.col("field") == name).select("keep_row_id", F.col("from_row_id").alias(to))
    conf = of("confidence", "row_id").join(kg.select("row_id", "confidence", "source_code"), "row_id").drop("row_id")
    just = of("justification", "row_id").join(kg.select("row_id", "justification", "chunk_id"), "row_id").drop("row_id")
    best = F.try_element_at(F.array_sort(F.filter("provenance", lambda e: F.trim(e["snippet"]) != ""), lambda a, b: F.length(b["snippet"]) - F.length(a["snippet"])), F.lit(1))
    snip = of("snippet", "row_id").join(layer5.select("row_id", best.alias("e")), "row_id").select("keep_row_id", F.col("e.snippet").alias("snippet"), F.col("e.chunk_id").alias("snippet_chunk_id"))
    keep = chosen.select("keep_row_id").distinct()
    head = keep.join(kg.select(F.col("row_id").alias("keep_row_id"), "doc_id", F.col("subject.label").alias("subject_label"), F.col("predicate.label").alias("predicate_label"), F.col("object.label").alias("object_label")), "keep_row_id")
    return head.join(conf, "keep_row_id", "left").join(just, "keep_row_id", "left").join(snip, "keep_row_id", "left")
