import random

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import similarity
from lodeweave.operators import matching


def sequential(edges):
    """Brute force over ``(p, g, score)``."""
    used_p, used_g, out = set(), set(), set()
    for p, g, _ in sorted(edges, key=lambda x: (-x[2], x[0], x[1])):
        if p not in used_p and g not in used_g:
            used_p.add(p)
            used_g.add(g)
            out.add((p, g))
    return out


@pytest.mark.parametrize("small", [matching.SMALL_GROUP, 0])
def test_greedy_takes_every_edge(spark, monkeypatch, small):
    """More than fifty ties in one block, in one task and in rounds."""
    monkeypatch.setattr(matching, "SMALL_GROUP", small)
    t = spark.range(60).select(F.lit(1).alias("doc_id"), "id", F.lit("pump").alias("head"), F.lit("drives").alias("relation"), F.lit("belt").alias("tail"))
    got = matching.greedy_triples(t, t.withColumn("id", F.col("id") + 1000)).collect()
    assert sorted((r["pred_id"], r["gold_id"]) for r in got) == [(i, i + 1000) for i in range(60)]


@pytest.mark.parametrize("small", [matching.SMALL_GROUP, 0])
def test_classes_equal_sequential(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "SMALL_GROUP", small)
    rnd = random.Random(8)
    pc, gc = {i: rnd.randrange(3) for i in range(9)}, {i: rnd.randrange(3) for i in range(8)}
    score = {(a, b): float(rnd.randrange(3)) for a in range(3) for b in range(3) if rnd.random() < 0.7}
    want = sequential([(p, g, score[pc[p], gc[g]]) for p in pc for g in gc if (pc[p], gc[g]) in score])
    e = spark.createDataFrame([(0, a, b, s) for (a, b), s in score.items()], "doc int, l int, r int, s double")
    sides = [spark.createDataFrame([(0, c, i) for i, c in m.items()], "doc int, c int, id int") for m in (pc, gc)]
    got = matching.greedy_classes(e, *sides, ["doc"], [-F.col("s")])
    assert {(r["l_id"], r["r_id"]) for r in got.collect()} == want


def test_slip_in_the_first_letters(spark, collect):
    p = spark.createDataFrame([(1, "conpressor"), (2, "conpressor")], "doc_id int, label string")
    g = spark.createDataFrame([(1, "compressor"), (1, "valve")], "doc_id int, label string")
    assert [(r["pred_label"], r["gold_label"], r["score"]) for r in matching.greedy_entities(p, g).collect()] == [("conpressor", "compressor", 90.0)]
    entries = spark.createDataFrame([("compressor", 0), ("valve", 1)], "label string, ord int")
    assert [(r["label"], r["match"]) for r in matching.best_match(p.select("label"), entries).collect()] == [("conpressor", "compressor")]


def test_near_keys_lose_no_pair():
    rnd = random.Random(3)
    for least in (0.6, 0.7, 0.75, 0.8, 0.85, 0.92):
        for _ in range(8000):
            a = "".join(rnd.choice("abc d") for _ in range(rnd.randrange(1, 14)))
            b = list(a)
            for _ in range(rnd.randrange(4)):
                b[rnd.randrange(len(b))] = rnd.choice(["", "x", "a", "yb"])
            b = "".join(b)
            if b and similarity.ratio(a, b) >= 100 * least:
                assert set(matching.near_keys(a, least)) & set(matching.near_keys(b, least)), (a, b, least)
