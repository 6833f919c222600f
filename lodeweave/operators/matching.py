"""Predictions matched with gold: one-to-one assignment, lookups and sets."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import normalizers as N
from lodeweave.functions import similarity as S
from lodeweave.session import cut


@dataclass(frozen=True)
class Profile:
    """Thresholds (0 to 100) and switches of an evaluation."""

    name: str = "general"
    entity: float = 85
    head: float = 85
    tail: float = 85
    tail_requires: float = 75
    fair_head: float = 82
    fair_tail: float = 82
    fair_tail_requires: float = 72
    low: float = 35
    same: float = 75
    min_str: float = 0.50
    max_cr: float = 0.20
    min_oc: float = 0.70
    max_cv: float = 0.30
    strict: bool = False
    reject_generic: bool = False


GENERAL = Profile()
STRICT = replace(GENERAL, name="strict", entity=92, head=94, tail=94, tail_requires=92, strict=True, reject_generic=True)
LOOSE = replace(GENERAL, name="loose", head=80, tail=80, tail_requires=70, fair_head=80, fair_tail=80, fair_tail_requires=70)
RECALL = replace(GENERAL, name="recall", entity=88, head=75, tail=72, tail_requires=60, fair_head=75, fair_tail=72, fair_tail_requires=60)
#: Labels too general to stand for anything.
GENERIC = ("alarm", "device", "failure", "part", "machine", "check")


def entity_score(pred: str, gold: str, profile: Profile = GENERAL) -> float:
    """The similarity of two normalized labels under a profile."""
    if not pred or not gold:
        return 0.0
    if pred == gold:
        return 100.0
    if profile.reject_generic and (pred in GENERIC or gold in GENERIC):
        return 0.0
    if not profile.strict:
        return S.token_set_ratio(pred, gold)
    share = lambda x, y: min(x, y) / max(x, y)
    if share(len(pred), len(gold)) < 0.75 or share(len(pred.split()), len(gold.split())) < 0.60:
        return 0.0
    return S.strict(pred, gold)


def near_keys(text: str, least: float) -> list[str]:
    """Keys of a text of which it shares one with every text whose ``ratio`` with it is ``least`` (0 to 1) or more.

    Texts of together n letters, m of them in common order, share 3m - 1 - n neighbouring letters, that is
    (1.5 least - 1) n - 1, so it is enough to meet on a prefix of these pairs in a fixed order. Where that is
    no pair at all (short texts, low thresholds), they meet on single letters.
    """
    share, n = 1.5 * least - 1, len(text)
    keys = [f"1{ch}" for ch in sorted(set(text))] if share <= 0 or n * share <= 1 else []
    if share > 0 and n > 1:
        seen: dict[str, int] = {}
        grams = []
        for i in range(n - 1):
            g = text[i : i + 2]
            seen[g] = seen.get(g, 0) + 1
            grams.append((zlib.crc32(g.encode()), g, seen[g]))
        common = max(1, math.ceil(share * (n + n * least / (2 - least)) - 1 - 1e-9))
        keys += [f"2{g}{k}" for _, g, k in sorted(grams)[: len(grams) - common + 1]]
    return keys


def _keys(least: float, in_order: bool):
    """Words and ``near_keys`` of normalized labels, in the order of their words or in the alphabet's."""

    @F.pandas_udf("array<string>")
    def over(labels: pd.Series) -> pd.Series:
        every = lambda t, w: [f"w{x}" for x in w] + near_keys(t if in_order else " ".join(w), least)
        return pd.Series([every(x or "", sorted(set((x or "").split()))) for x in labels], dtype="object")

    return over


def blocked_pairs(pred: DataFrame, gold: DataFrame, by: list[str], threshold: float, label: str = "label") -> DataFrame:
    """Pairs of rows of one group, among them all whose ``token_set_ratio`` is at least ``threshold`` (0 to 100); no cross join.

    Such labels share a word or, having none in common, are near enough for a common key of ``near_keys``.
    """
    key = _keys(threshold / 100, False)
    keys = lambda df, s: df.withColumn("_b", F.explode(key(N.evaluation(F.col(label))))).select(*by, "_b", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in by])
    return keys(pred, "pred").join(keys(gold, "gold"), [*by, "_b"]).drop("_b").distinct()


#: A group with at most so many edges and members is matched in one task; a larger one in rounds, with the same result.
SMALL_GROUP = 50_000


def _sequential(edges: list, lefts: list, rights: list) -> list[tuple]:
    """The matches ``(left_id, right_id, edge)`` of one group, edge by edge in the order of ``greedy_classes``."""
    ids: dict[tuple, list] = {}
    for side, members in ((0, lefts), (1, rights)):
        for m in sorted(members, key=lambda m: m["id"], reverse=True):
            ids.setdefault((side, m["c"]), []).append(m["id"])  # the next one is last
    levels: dict[tuple, dict] = {}
    for e, x in enumerate(edges):
        levels.setdefault(tuple(x["level"]), {}).setdefault(x["l"], []).append((x["r"], e))
    out = []
    for level in sorted(levels):
        near = levels[level]
        for i, l in sorted((i, l) for l in near for i in ids.get((0, l), ())):  # noqa: E741
            free = [(ids[1, r][-1], r, e) for r, e in near[l] if ids.get((1, r))]
            if free:
                j, r, e = min(free)
                ids[0, l].pop()
                ids[1, r].pop()
                out.append((i, j, e))
    return out


def _rounds(edges: DataFrame, lefts: DataFrame, rights: DataFrame, by: list[str]) -> DataFrame:
    """As ``_sequential`` for groups of any size: rounds until no edge is left.

    The pair of classes whose first free members are each other's best takes as many members at once as
    come before the first free member of any other class with an equal claim.
    """
    n_of = lambda k: Window.partitionBy(*by, "c").orderBy(k)
    sides = {}
    for s, df in (("l", lefts), ("r", rights)):
        ranked = cut(df.withColumn("k", F.row_number().over(n_of("id"))).withColumnsRenamed({"c": s, "id": f"{s}_id", "k": f"{s}_k"}))
        sides[s] = (ranked, cut(ranked.groupBy(*by, s).agg(F.lit(0).cast("long").alias(f"{s}_used"), F.count("*").alias(f"{s}_n"), F.min(f"{s}_id").alias(f"{s}_head"))))
    runs, left = None, cut(edges)
    while left.limit(1).count():
        e = left.join(sides["l"][1], [*by, "l"]).join(sides["r"][1], [*by, "r"])
        for s, other in (("l", "r"), ("r", "l")):
            w = Window.partitionBy(*by, s).orderBy("level", f"{other}_head", other)
            rival = F.lead(F.struct("level", F.col(f"{other}_head").alias("h"))).over(w)
            e = e.withColumn(f"{s}_first", F.row_number().over(w)).withColumn(f"{other}_bound", F.when(rival["level"] == F.col("level"), rival["h"]))
        now = cut(e.where("l_first = 1 and r_first = 1"))
        many = now
        for s in ("l", "r"):
            before = now.where(f"{s}_bound is not null").select(*by, s, f"{s}_used", f"{s}_bound").join(sides[s][0], [*by, s]).where(f"{s}_k > {s}_used and {s}_id < {s}_bound")
            many = many.join(before.groupBy(*by, s).agg(F.count("*").alias(f"{s}_many")), [*by, s], "left")
        rest = [F.coalesce(F.col(f"{s}_many"), F.col(f"{s}_n") - F.col(f"{s}_used")) for s in ("l", "r")]
        taken = cut(many.withColumn("len", F.greatest(F.least(*rest), F.lit(1))).select(*by, "l", "r", "edge", "l_used", "r_used", "len"))
        runs = taken if runs is None else runs.unionByName(taken)
        for s in ("l", "r"):
            ranked, state = sides[s]
            moved = state.join(taken.select(*by, s, "len"), [*by, s]).withColumn(f"{s}_used", F.col(f"{s}_used") + F.col("len")).drop("len", f"{s}_head")
            moved = moved.join(ranked.select(*by, s, (F.col(f"{s}_k") - 1).alias(f"{s}_used"), F.col(f"{s}_id").alias(f"{s}_head")), [*by, s, f"{s}_used"])  # used-up classes end here
            sides[s] = (ranked, cut(state.join(taken.select(*by, s), [*by, s], "left_anti").unionByName(moved)))
        for s in ("l", "r"):
            left = left.join(sides[s][1].select(*by, s), [*by, s], "left_semi")
        left = cut(left)
    if runs is None:
        runs = edges.select(*by, "l", "r", "edge", F.lit(0).cast("long").alias("l_used"), F.lit(0).cast("long").alias("r_used"), F.lit(0).cast("long").alias("len")).limit(0)
    each = runs.where("len > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("i")).withColumn("l_k", F.col("l_used") + F.col("i")).withColumn("r_k", F.col("r_used") + F.col("i"))
    return each.join(sides["l"][0], [*by, "l", "l_k"]).join(sides["r"][0], [*by, "r", "r_k"]).select(*by, "l_id", "r_id", "edge")


def greedy_classes(edges: DataFrame, lefts: DataFrame, rights: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One-to-one matching of members of classes that takes the best edge first: ``(by, l_id, r_id, the edge's other columns)``.

    ``edges(by, l, r, ..)`` are between classes of members that score alike, ``lefts(by, c, id)`` and
    ``rights(by, c, id)`` are the members, so n copies on both sides are one edge and not n * n. The result
    is that of going through all edges of members sorted by ``order``, left id, right id. ``order`` must be numeric.
    """
    rest = [c for c in edges.columns if c not in (*by, "l", "r")]
    e = cut(edges.select(*by, "l", "r", F.array(*[o.cast("double") for o in order]).alias("level"), F.struct(*rest).alias("edge")))
    ends = {"l": cut(lefts.join(e.select(*by, F.col("l").alias("c")).distinct(), [*by, "c"], "left_semi")), "r": cut(rights.join(e.select(*by, F.col("r").alias("c")).distinct(), [*by, "c"], "left_semi"))}
    size = e.select(*by).unionByName(ends["l"].select(*by)).unionByName(ends["r"].select(*by)).groupBy(*by).agg(F.count("*").alias("n"))
    large = cut(size.where(F.col("n") > SMALL_GROUP).select(*by))
    some = bool(large.limit(1).count())
    part = lambda df, how: df.join(large, by, how) if some else df
    lists = lambda df, name, *c: part(df, "left_anti").groupBy(*by).agg(F.collect_list(F.struct(*c)).alias(name))
    groups = lists(e, "es", "level", "l", "r", "edge").join(lists(ends["l"], "ls", "c", "id"), by).join(lists(ends["r"], "rs", "c", "id"), by)
    kind = lambda s: ends[s].schema["id"].dataType.simpleString()
    solve = F.udf(_sequential, f"array<struct<l_id:{kind('l')},r_id:{kind('r')},e:int>>")
    bare = F.transform("es", lambda x: F.struct(x["level"].alias("level"), x["l"].alias("l"), x["r"].alias("r")))
    found = groups.select(*by, "es", F.explode(solve(bare, "ls", "rs")).alias("m")).select(*by, "m.l_id", "m.r_id", F.col("es")[F.col("m.e")]["edge"].alias("edge"))
    if some:
        found = found.unionByName(_rounds(part(e, "left_semi"), part(ends["l"], "left_semi"), part(ends["r"], "left_semi"), by))
    return found.select(*by, "l_id", "r_id", "edge.*")


def greedy(edges: DataFrame, left: str, right: str, by: list[str], order: list[Column]) -> DataFrame:
    """One-to-one matching that takes the best edge first; ties go to the first left, then right end.

    The result is that of going through the edges sorted by ``order``; no edge is left at the end.
    """
    rest = [c for c in edges.columns if c not in (*by, left, right)]
    e = edges.withColumnsRenamed({left: "l", right: "r"})
    ends = [e.select(*by, F.col(s).alias("c"), F.col(s).alias("id")).distinct() for s in ("l", "r")]
    return greedy_classes(e, *ends, by, order).select(*by, F.col("r_id").alias(right), F.col("l_id").alias(left), *rest)


def greedy_entities(pred: DataFrame, gold: DataFrame, profile: Profile = GENERAL, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(by, pred_label, gold_label, score)``: matched entities of each group; each label once, blank ones never."""
    by = list(by)
    labels = lambda df: df.select(*by, F.trim("label").alias("label")).where("label <> ''").distinct()
    pairs = blocked_pairs(labels(pred), labels(gold), by, profile.entity)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([entity_score(x, y, profile) for x, y in zip(a, b)], dtype="float64")

    scored = pairs.withColumn("score", score(N.evaluation(F.col("pred_label")), N.evaluation(F.col("gold_label")))).where(F.col("score") >= profile.entity)
    return greedy(scored, "pred_label", "gold_label", by, [-F.col("score")])


def triple_pairs(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Triples of one group and relation, with the similarity of both ends."""
    named = lambda df, s: df.select(*by, F.upper(N.evaluation(F.col("relation"))).alias("rel"), F.col("id").alias(f"{s}_id"), N.evaluation(F.col("head")).alias(f"{s}_head"), N.evaluation(F.col("tail")).alias(f"{s}_tail"))
    p = named(pred, "pred").join(named(gold, "gold"), [*by, "rel"])
    return p.withColumn("head_score", S.token_set_udf("pred_head", "gold_head")).withColumn("tail_score", S.token_set_udf("pred_tail", "gold_tail"))


def greedy_triples(pred: DataFrame, gold: DataFrame, profile: Profile = GENERAL, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Matched triples ``(id, head, relation, tail)`` of each group: equal relation, both ends similar enough.

    Copies are one class each, so only different triples of a relation are compared.
    """
    by = [*by, "rel"]
    text = lambda c: F.coalesce(N.evaluation(F.col(c)), F.lit(""))
    named = lambda df: df.select(*by[:-1], F.upper(N.evaluation(F.col("relation"))).alias("rel"), "id", text("head").alias("head"), text("tail").alias("tail")).withColumn("c", F.concat_ws("\n", "head", "tail"))
    p, g = named(pred), named(gold)
    classes = lambda df, c, s: df.select(*by, F.col("c").alias(c), F.col("head").alias(f"{s}_head"), F.col("tail").alias(f"{s}_tail")).distinct()
    pairs = classes(p, "l", "pred").join(classes(g, "r", "gold"), by)
    scored = pairs.withColumn("head_score", S.token_set_udf("pred_head", "gold_head")).withColumn("tail_score", S.token_set_udf("pred_tail", "gold_tail"))
    tail = F.when(F.col("rel") == "REQUIRES", profile.tail_requires).otherwise(profile.tail)
    good = scored.where((F.col("head_score") >= profile.head) & (F.col("tail_score") >= tail)).withColumn("score", 0.5 * F.col("head_score") + 0.5 * F.col("tail_score"))
    found = greedy_classes(good, p.select(*by, "c", "id"), g.select(*by, "c", "id"), by, [-F.col("score"), -F.col("head_score"), -F.col("tail_score")])
    return found.withColumnsRenamed({"l_id": "pred_id", "r_id": "gold_id"})


def swapped(df: DataFrame) -> DataFrame:
    """Triples and the same ones turned round, for matching that does not mind the direction."""
    return df.withColumn("swapped", F.lit(False)).unionByName(df.select(*[F.col({"head": "tail", "tail": "head"}.get(c, c)).alias(c) for c in df.columns], F.lit(True).alias("swapped")))


def exact_counts(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``(pred_n, gold_n, tp)`` of exact one-to-one matching: of each key as many as both sides have."""
    p, g = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((pred, "p"), (gold, "g")))
    both = p.join(g, keys, "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.agg(F.coalesce(F.sum(z("p")), F.lit(0)).alias("pred_n"), F.coalesce(F.sum(z("g")), F.lit(0)).alias("gold_n"), F.coalesce(F.sum(F.least(z("p"), z("g"))), F.lit(0)).alias("tp"))


def first_fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Predictions in their order take the first gold row still free; ``pairs(by, pred_ord, gold_ord)``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for p, part in pdf.sort_values(["pred_ord", "gold_ord"]).groupby("pred_ord", sort=True):
            g = next((x for x in part["gold_ord"] if x not in used), None)
            if g is not None:
                used.add(g)
                out.append((*[part[c].iloc[0] for c in by], p, g))
        return pd.DataFrame(out, columns=[*by, "pred_ord", "gold_ord"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in [*by, "pred_ord", "gold_ord"])
    return pairs.select(*by, "pred_ord", "gold_ord").groupBy(*by).applyInPandas(fit, kinds)  # one document per group


def best_match(left: DataFrame, right: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(label, match, score)``: the entry nearest to each label, exact ones first; ties go to the first entry.

    ``right(label, ord)``. Exact labels are joined by equality; the rest meet on a shared word or a key of ``near_keys``.
    """
    l = left.select("label", N.evaluation(F.col("label")).alias("n")).distinct()  # noqa: E741
    r = right.select(F.col("label").alias("match"), "ord", N.evaluation(F.col("label")).alias("rn"))
    exact = l.join(r, F.col("n") == F.col("rn")).groupBy("label").agg(F.min_by("match", "ord").alias("match")).withColumn("score", F.lit(1.0))
    rest = l.join(exact, "label", "left_anti")
    keys = _keys(threshold, True)
    key = lambda c: F.explode(keys(F.col(c)))
    pairs = rest.withColumn("b", key("n")).join(r.withColumn("b", key("rn")), "b").select("label", "n", "match", "rn", "ord").distinct()
    scored = pairs.withColumn("score", F.greatest(S.matcher_udf("n", "rn"), S.jaccard(F.col("n"), F.col("rn")))).where(F.col("score") >= threshold)
    near = scored.groupBy("label").agg(F.max_by("match", F.struct("score", -F.col("ord"))).alias("match"), F.max("score").alias("score"))
    return exact.unionByName(near)


def by_alias_table(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Labels replaced by their canonical ones where an alias table ``(alias, canonical, ord)`` has them; the first of an alias counts."""
    first = aliases.groupBy(N.spacing(F.col("alias")).alias("_a")).agg(F.min_by("canonical", "ord").alias("_c"))
    return df.withColumn("_a", N.spacing(F.col(column))).join(first, "_a", "left").withColumn(column, F.coalesce("_c", column)).drop("_a", "_c")


def infer_relation(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule of which a keyword occurs in the text."""
    t, out = N.domain(text), F.lit(None).cast("string")
    for relation, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, relation).otherwise(out)
    return out


def infer_roles(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """All roles of which a keyword occurs in the text."""
    t = N.domain(text)
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)), role) for role, words in rules]))


def anchored(raw: DataFrame, lookup: DataFrame, threshold: float = 52.0, k: int | None = None) -> DataFrame:
    """Raw triples turned into gold-shaped ones: those of their anchor and relation whose tail is similar enough.

    ``raw(id, anchor, relation, tail)``, ``lookup(anchor, relation, tail)``; with ``k`` the best k per triple.
    """
    pairs = raw.join(lookup.select("anchor", "relation", F.col("tail").alias("gold_tail")).distinct(), ["anchor", "relation"])
    scored = pairs.withColumn("score", S.token_set_udf(N.domain(F.col("tail")), N.domain(F.col("gold_tail")))).where(F.col("score") >= threshold)
    if k is not None:
        w = Window.partitionBy("id").orderBy(F.col("score").desc(), "gold_tail")
        scored = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return scored.select("id", "anchor", "relation", F.col("gold_tail").alias("tail"), "score")
