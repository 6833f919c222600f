"""Variant spellings of person and organisation names, linked.

1. Each distinct name becomes a vector of character trigrams (and initials) weighted by rarity.
2. A sparse cosine join finds all pairs over a threshold. Two names meet on a trigram only if what
   their vectors hold from it on can still reach the threshold (prefix and positional filter), so no
   pair over it is missed and nothing is capped; frequent trigrams make few pairs, and one that is
   frequent nonetheless is split over tasks. There is no top-n cut unless ``top_n`` is given.
3. An exact check drops pairs whose parts contradict each other: other given names, other fields of
   business, other legal forms.
4. Average linkage over the cosines, a pair below the threshold or dropped counting as 0, in rounds:
   all pairs of clusters that are each other's nearest are merged at once, which gives the same
   clusters as one merge at a time, as average linkage is reducible. Every step is a join or an
   aggregate over the edges, whatever the size of a group. Names with a part missing ("Mr. X",
   "X & Co") join the one cluster they fit by their mean cosine and stay alone if they fit several.

Null and blank labels are no names. Equal labels count once. Labels of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.session import cut

TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "ing", "dipl", "mme", "mlle", "herr", "frau", "sir"}
BEFORE_FIRMS = {"the", "firma", "fa", "firm", "messrs", "ste", "societe"}
#: Legal forms; forms with one meaning share a value.
LEGAL = {
    "ag": "ag", "bv": "bv", "co": "co", "company": "co", "corp": "corp", "corporation": "corp", "gmbh": "gmbh", "inc": "inc", "kg": "kg",
    "limited": "ltd", "llc": "llc", "ltd": "ltd", "plc": "plc", "sa": "sa", "sarl": "sarl", "sas": "sas", "spa": "spa", "srl": "srl",
}
#: Short forms of given names in common use in English, German and French, by the names they stand for.
#: ``cluster_names`` takes another table of the same form.
NICKNAMES = """
abby: abigail; alex: alexander alexandra; andy: andrew andreas; annie: anne anna; antje: anna; babs: barbara; bastian: sebastian; bastien: sebastien; becky: rebecca; ben: benjamin benedikt;
bene: benedikt; bernie: bernard bernhard; bert: albert robert herbert; berti: albert hubert; betty: elisabeth elizabeth; bill: william; billy: william; bob: robert; bobby: robert;
celi: celine; cesca: francesca; charlie: charles charlotte; chris: christopher christophe christian christine; claus: nikolaus nicolas; dagi: dagmar; dan: daniel; dave: david; dick: richard; dora: theodora dorothea;
ed: edward eduard; eddie: edward eduard; ella: elisabeth gabriella; elli: elisabeth; elsa: elisabeth; elsie: elizabeth elisabeth; ferdi: ferdinand; fifi: josephine; fran: francesca frances; franzi: franziska francesca;
fred: frederick alfred friedrich frederic; fritz: friedrich; gabi: gabriela gabriele; gaby: gabriela gabrielle; gerd: gerhard; greta: margarete margareta; grete: margarete; gretel: margarete; gus: august gustav; hannes: johannes;
hanni: johanna hannelore; hans: johannes; hardy: leonhard gerhard; harry: harold henry; heinz: heinrich; henny: henriette; ina: katharina martina; jack: john; jake: jacob; jeff: jeffrey geoffrey;
jim: james; jimmy: james; jo: joelle josephine johanna joanna; joe: joseph; josi: josephine; josie: josephine; jupp: josef; kate: katherine catherine; kathi: katharina katarina;
kathy: katherine kathleen; kati: katharina katarina; katja: katharina katarina; ken: kenneth; kit: christopher christophe katherine; klaus: nikolaus; lena: magdalena helena; leni: helene magdalena; leo: leonhard leonard leopold; liese: elisabeth;
liesl: elisabeth; lilli: elisabeth; lisa: elisabeth elizabeth; liz: elizabeth elisabeth; lotte: charlotte; luda: ludmila; lutz: ludwig; maggie: margaret; mandy: amanda; manni: manfred;
manu: manuel manuela emmanuel; matt: matthew; matze: matthias; max: maximilian maxime; maxi: maximilian; meg: margaret; michi: michael michaela; mike: michael; mila: ludmila; mimi: marie;
molly: mary; nando: ferdinand; nat: nathaniel nathalie; ned: edward; netti: antoinette annette; nettie: antoinette annette; nick: nicholas nikolaus nicolas; niko: nikolaus nikolas; pat: patrick patricia; peggy: margaret;
pete: peter; phil: philip philippe; polly: mary; rick: richard frederick; rike: ulrike friederike; rob: robert; robbie: robert; rolf: rudolf; ron: ronald; rosi: rosemarie roswitha;
rudi: rudolf; sally: sarah; sam: samuel samantha; sandy: alexander alexandra sandra; sascha: alexander alexandra; sasha: alexander alexandra; seb: sebastien sebastian; sepp: josef; sigi: siegfried sigrid; steffi: stefanie stephanie;
steve: stephen steven; sue: susan susanne; susi: susanne; ted: theodore edward; tess: therese theresa; thea: theodora dorothea; theo: theodor theodore; tim: timothy; tina: christina martina bettina; tom: thomas;
tommy: thomas; toni: antoinette anton antonia; tony: anthony antoine; ulli: ulrich ulrike; uli: ulrich ulrike; ute: uta; val: valerie valentin; vicky: victoria; viv: vivian vivienne; walt: walter;
wes: wesley; will: william; willi: wilhelm william; willy: wilhelm william; wolf: wolfgang; yvi: yvonne; zac: zachary; zoe: zoey
"""


def nickname_table(text: str = NICKNAMES) -> dict[str, tuple[str, ...]]:
    """A table written as ``short: long long; short: long`` as a dictionary."""
    return {k.strip(): tuple(v.split()) for k, v in (x.split(":") for x in text.split(";"))}


SHORT = nickname_table()
#: Cosine from which a pair is an edge, mean cosine from which clusters are merged, and the same for names of one part among themselves.
THRESHOLD, LEAST, LEAST_PARTIAL = 0.35, 0.2, 0.5
#: Rows of one trigram that one task joins; more are split.
HOT = 4000
#: Cosines are summed as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def parse(kind: str, label: str) -> dict:
    """The parts of a name: ``parts`` (written out, marked if clipped), ``initials``, ``legal``."""
    text = re.sub(r"GmbH", " GMBH", unicodedata.normalize("NFKC", label))
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])", " ", text)
    text = re.sub(r"\b((?:[A-Za-z]\.){2,}[A-Za-z]?)(?=\W|$)", lambda m: m[1].replace(".", ""), text) if kind == "organisation" else text
    found = [(fold(m[1]), m[2] == ".") for m in re.finditer(r"([^\W\d_]+|\d+)(\.?)", text)]
    legal, parts, initials = "", [], []
    if kind == "organisation":
        mention = bool(re.search(r"&\s*co\b", label, re.I))
        for w, dot in found:
            if w in LEGAL and (len(found) > 1):
                legal = legal or ("" if mention and LEGAL[w] == "co" else LEGAL[w])
            elif w in BEFORE_FIRMS and len(found) > 1 or len(w) == 1:
                continue
            else:
                parts.append((w, dot))
    else:
        for w, dot in found:
            if w in TITLES and len(found) > 1:
                continue
            if len(w) == 1:
                initials.append(w)
            else:
                parts.append((w, False))
    return {"kind": kind, "parts": parts, "initials": initials, "legal": legal, "comma": "," in label}


def one_slip(a: str, b: str) -> bool:
    """Equal up to one dropped, doubled, changed or added letter or two swapped ones."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :]


def clipped(short: str, whole: str) -> bool:
    """``short`` is made of letters of ``whole`` in their order and begins with its first two."""
    if len(short) >= len(whole) or short[:2] != whole[:2]:
        return False
    it = iter(whole)
    return all(c in it for c in short)


def same_part(a: tuple[str, bool], b: tuple[str, bool], short: dict[str, tuple[str, ...]] = SHORT) -> float:
    (x, dx), (y, dy) = a, b
    if x == y or (x in short or y in short) and set(short.get(x, (x,))) & set(short.get(y, (y,))):
        return 1.0
    if dx and clipped(x, y) or dy and clipped(y, x) or dx and dy and x[:3] == y[:3]:
        return 0.9
    if any(min(len(p), len(q)) >= 3 and max(len(p), len(q)) >= 4 and one_slip(p, q) for p in (x, *short.get(x, ())) for q in (y, *short.get(y, ()))):
        return 0.85
    return 0.0


def alike(a: dict, b: dict, short: dict[str, tuple[str, ...]] = SHORT) -> float:
    """0 if two names cannot be the same, else how well their parts agree."""
    if a["kind"] != b["kind"] or not a["parts"] or not b["parts"]:
        return 0.0
    if a["legal"] and b["legal"] and a["legal"] != b["legal"]:
        return 0.0
    p, q = a["parts"], b["parts"]
    if len(p) > len(q):
        a, b, p, q = b, a, q, p
    if len(p) >= 2:
        used, score, rough = set(), 1.0, 0
        for x in p:
            best = max(((same_part(x, y, short), -j) for j, y in enumerate(q) if j not in used), default=(0.0, 0))
            if best[0] <= 0:
                return 0.0
            used.add(-best[1])
            score *= best[0]
            rough += best[0] == 0.85
        if len(q) != len(p) or rough > 1:
            return 0.0
        return score
    if len(q) == 1:
        if a["initials"] and b["initials"] and not set(a["initials"]) & set(b["initials"]):
            return 0.0
        return same_part(p[0], q[0], short) * (1.0 if bool(a["initials"]) == bool(b["initials"]) else 0.7)
    best = 0.0
    for j, y in enumerate(q):
        s = same_part(p[0], y, short)
        others = [w for k, (w, _) in enumerate(q) if k != j]
        if a["kind"] == "person":
            if a["initials"]:
                if not any(x[:1] in a["initials"] for w in others for x in (w, *short.get(w, ()))):
                    continue
            elif p[0][0] in short or any(p[0][0] in x for x in short.values()):
                continue
        elif y[1]:
            continue
        best = max(best, s * (0.9 if a["initials"] or a["legal"] and a["legal"] == b["legal"] else 0.8))
    return best


def trigrams(parsed: dict, short: dict[str, tuple[str, ...]] = SHORT) -> list[str]:
    """Trigrams of the parts and of what nicknames stand for, initials, and each part's sorted letters as one more, since swaps spoil trigrams."""
    out = set()
    for w, _ in parsed["parts"]:
        for x in short.get(w, (w,)):
            t = f"#{x}#"
            out |= {t[i : i + 3] for i in range(len(t) - 2)}
        if len(w) > 4:
            out.add("".join(sorted(w)))
        out |= {f"^{x[0]}" for x in (w, *short.get(w, ()))}
    return sorted(out | {f"^{c}" for c in parsed["initials"]})


def vectors(names: DataFrame, threshold: float = THRESHOLD, short: dict[str, tuple[str, ...]] = SHORT) -> DataFrame:
    """``names(node, kind, label)`` to ``(node, kind, label, full, grams, w, rest)``: the trigrams, rarest first, with their
    weights in the unit vector and the length of the vector from each trigram on.

    A trigram of one name only joins nothing; it is left out, so that a slip of the keyboard, which makes
    several of them, does not push a short name below the threshold."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse(k, x) for k, x in zip(pdf["kind"], pdf["label"])]
            yield pdf[["node", "kind", "label"]].assign(full=[len(x["parts"]) >= 2 for x in parsed], grams=[trigrams(x, short) for x in parsed])

    parsed = cut(names.select("node", "kind", "label").mapInPandas(parts, "node bigint, kind string, label string, full boolean, grams array<string>"))
    total = F.broadcast(parsed.groupBy("kind").agg(F.count("*").alias("n")))  # one row per kind of name
    single = parsed.select("node", "kind", F.explode("grams").alias("gram"))
    df = single.groupBy("kind", "gram").agg(F.count("*").alias("df")).where("df > 1").join(total, "kind")
    raw = df.select("kind", "gram", "df", F.pow(F.log(1 + F.col("n") / F.col("df")), F.lit(1.5)).alias("raw"))
    listed = single.join(raw, ["kind", "gram"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "raw"))).alias("v"))  # as long as the name

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w, rest = [], []
            for v in pdf["raw"]:
                x = np.asarray(v, float)
                x = x / np.sqrt((x * x).sum())
                w.append(x.tolist())
                rest.append(np.sqrt(np.cumsum((x * x)[::-1])[::-1]).tolist())
            yield pdf[["node", "kind", "label", "full", "grams"]].assign(w=w, rest=rest)

    rows = parsed.drop("grams").join(listed, "node").select("node", "kind", "label", "full", F.col("v.gram").alias("grams"), F.col("v.raw").alias("raw"))
    return rows.mapInPandas(weigh, "node bigint, kind string, label string, full boolean, grams array<string>, w array<double>, rest array<double>")


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD, top_n: int | None = None, short: dict[str, tuple[str, ...]] = SHORT, hot: int = HOT) -> DataFrame:
    """``(a, b, cosine, full_a, full_b)``, a before b, of names ``(node, kind, label)`` whose vectors have at least this cosine and whose parts agree.

    Of the first trigram that two names share, the Cauchy-Schwarz bound says that the lengths of what follows multiply to the cosine at
    least; pairs meet where that product reaches the threshold. A trigram with more than ``hot`` rows is split into blocks.
    """
    vec = cut(vectors(names, threshold, short))
    at = F.explode(F.expr(f"filter(transform(grams, (g, i) -> struct(g AS gram, rest[i] AS rest)), x -> x.rest >= {threshold - 1e-9})")).alias("p")
    rows = vec.select("node", "kind", "label", "full", F.map_from_arrays("grams", "w").alias("v"), at).select("node", "kind", "label", "full", "v", "p.gram", "p.rest")
    split = rows.groupBy("kind", "gram").agg(F.count("*").alias("n")).where("n > 1").select("kind", "gram", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    placed = rows.join(split, ["kind", "gram"])
    side = lambda s, block: placed.select("kind", "gram", block.alias("block"), F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("label", "full", "v", "rest")])
    left, right = side("a", F.pmod("node", "blocks")), side("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = left.join(right.withColumn("block", F.col("block").cast("bigint")), ["kind", "gram", "block"]).where((F.col("a") < F.col("b")) & (F.col("rest_a") * F.col("rest_b") >= threshold - 1e-9))
    dot = F.aggregate(F.map_entries("v_a"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("v_b", e["key"]), F.lit(0.0)))
    near = met.withColumn("cosine", dot).where(F.col("cosine") >= threshold - 1e-9).groupBy("kind", "a", "b").agg(*[F.first(c).alias(c) for c in ("label_a", "label_b", "full_a", "full_b", "cosine")])
    if top_n is not None:
        by = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
        near = near.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= top_n).drop("_r")

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [alike(parse(k, x), parse(k, y), short) > 0 for k, x, y in zip(pdf["kind"], pdf["label_a"], pdf["label_b"])]
            yield pdf.loc[keep, ["a", "b", "cosine", "full_a", "full_b"]]

    return near.select("kind", "a", "b", "label_a", "label_b", "full_a", "full_b", "cosine").mapInPandas(agree, "a bigint, b bigint, cosine double, full_a boolean, full_b boolean")


def average_linkage(edges: DataFrame, least: float) -> DataFrame:
    """``edges(a, b, cosine)``, one row per pair, to ``(node, cluster)`` of the nodes that were merged; a cluster is named by one of its nodes.

    A round merges every pair of clusters that are each other's nearest by mean cosine, and adds up the edges of merged clusters.
    Equal means are ordered by a hash of the pair, so that a group of equal names is halved in each round. It ends when no mean reaches ``least``.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.col("cosine") * UNIT).cast("bigint").alias("s"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")), loop=True)
    home = None
    while True:
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        open_ = now.where(mean >= least * UNIT).select(mean.alias("mean"), F.xxhash64("a", "b").alias("h"), "a", "b", (F.col("na") + F.col("nb")).alias("size"))
        best = open_.select(F.explode(F.array("a", "b")).alias("node"), F.struct("mean", "h", "a", "b", "size").alias("k")).groupBy("node").agg(F.max("k").alias("k"))
        both = best.groupBy("k").agg(F.count("*").alias("n")).where("n = 2")
        moved = cut(both.select(F.explode(F.array("k.a", "k.b")).alias("node"), F.col("k.a").alias("to"), F.col("k.size").alias("size")), loop=True)
        if not moved.limit(1).count():
            break
        fresh = moved.select("node", F.col("to").alias("cluster"))
        if home is None:
            home = fresh
        else:
            later = home.join(fresh.select(F.col("node").alias("cluster"), F.col("cluster").alias("next")), "cluster", "left")
            home = cut(later.select("node", F.coalesce("next", "cluster").alias("cluster")).unionByName(fresh.join(home.select("node"), "node", "left_anti")), loop=True)
        to = lambda s: moved.select(F.col("node").alias(s), F.col("to").alias(f"to_{s}"), F.col("size").alias(f"size_{s}"))
        next_edges = now.join(to("a"), "a", "left").join(to("b"), "b", "left").select(
            F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "s", F.coalesce("size_a", "na").alias("nx"), F.coalesce("size_b", "nb").alias("ny")
        )
        turned = F.col("x") > F.col("y")
        ordered = next_edges.where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "s", F.when(turned, F.col("ny")).otherwise(F.col("nx")).alias("na"), F.when(turned, F.col("nx")).otherwise(F.col("ny")).alias("nb")
        )
        now = cut(ordered.groupBy("a", "b").agg(F.sum("s").alias("s"), F.first("na").alias("na"), F.first("nb").alias("nb")), loop=True)
    return edges.sparkSession.createDataFrame([], "node bigint, cluster bigint") if home is None else home


def cluster_names(names: DataFrame, threshold: float = THRESHOLD, least: float = LEAST, least_partial: float = LEAST_PARTIAL, short: dict[str, tuple[str, ...]] = SHORT) -> DataFrame:
    """``names(kind, label)`` to ``(label, cluster)``; names that are alone are left out.

    ``short`` is a table of nicknames with the names they may stand for.
    """
    ids = cut(names.select("kind", "label").where("kind is not null and trim(label) <> ''").distinct().withColumn("node", F.monotonically_increasing_id()))
    edges = cut(similar_pairs(ids, threshold, short=short))
    strong = average_linkage(edges.where("full_a and full_b"), least)
    sizes = strong.groupBy("cluster").agg(F.count("*").alias("size"))
    whole = strong.join(sizes, "cluster").select(F.col("node").alias("whole"), "cluster", "size")
    touching = edges.where("full_a != full_b").select(F.when(F.col("full_a"), F.col("b")).otherwise(F.col("a")).alias("node"), F.when(F.col("full_a"), F.col("a")).otherwise(F.col("b")).alias("whole"), "cosine")
    home = touching.join(whole, "whole", "left").select("node", F.coalesce("cluster", "whole").alias("cluster"), F.coalesce("size", F.lit(1)).alias("size"), "cosine")
    fit = home.groupBy("node", "cluster").agg((F.sum("cosine") / F.first("size")).alias("mean")).where(F.col("mean") >= least)
    chosen = cut(fit.groupBy("node").agg(F.count("*").alias("n"), F.min("cluster").alias("cluster")))
    attached = chosen.where("n = 1").select("node", "cluster")
    free = edges.where("not full_a and not full_b").join(chosen.select(F.col("node").alias("a")), "a", "left_anti").join(chosen.select(F.col("node").alias("b")), "b", "left_anti")
    alone = average_linkage(free.select("a", "b", "cosine"), least_partial)
    heads = attached.select(F.col("cluster").alias("node"), "cluster")
    member = strong.unionByName(attached).unionByName(heads).unionByName(alone).distinct()
    return member.join(ids.select("node", "label"), "node").select("label", "cluster")


def same_entity_pairs(names: DataFrame, short: dict[str, tuple[str, ...]] = SHORT) -> DataFrame:
    """``(label_a, label_b)``, label_a before label_b by code point, of names in one cluster."""
    member = cut(cluster_names(names, short=short))
    a, b = member.withColumnRenamed("label", "label_a"), member.withColumnRenamed("label", "label_b")
    return a.join(b, "cluster").where("label_a < label_b").select("label_a", "label_b").distinct()
