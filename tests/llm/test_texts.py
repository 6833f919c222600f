import random

import numpy as np
from pyspark.sql import functions as F

from lodeweave.llm import leakage as LE
from lodeweave.llm import mixing as MI
from lodeweave.llm import subject_areas as SA
from lodeweave.llm.truncation import find_truncated, tokens

WORDS = [f"{a}{b}" for a in ("pump", "valve", "motor", "filter", "sensor", "belt", "guard", "drive") for b in ("ing", "er", "ed", "s", "", "age", "or", "ist")]


def test_lcs():
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        p = LE.lcs_pairs(a, b)
        assert len(p) == d[-1][-1] and all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))


def test_leaks(spark, collect):
    rnd = random.Random(1)
    passage = lambda: [rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(80)]
    items = [passage() for _ in range(6)]
    noise = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    p = items[0]
    changed = [("zz" if i % 12 == 5 else w) for i, w in enumerate(p)]
    heavy = [("zz" if i % 5 == 2 else w) for i, w in enumerate(p)]
    broken = " ".join(noise(30) + p[:40]) + " " + p[40][:3] + "-\n" + p[40][3:] + " " + " ".join(p[41:])
    docs = [
        (1, " ".join(noise(50) + p + noise(50))), (2, " ".join(noise(20) + p[10:52] + noise(20)).upper()), (3, "> " + ", ".join(changed) + "."), (4, broken), (5, " ".join(heavy)), (6, " ".join(p[:30] + noise(300))), (7, None), (8, ""), (9, "...."),
        (10, " ".join(noise(30_000) + items[1] + items[2][:45])), (11, " ".join(noise(30_000))), (12, " ".join(p[:20] + noise(60) + p[20:40] + noise(60) + p[40:60])), (1, " ".join(p)),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "two words")], "item_id bigint, passage string")
    want = [(1, 0), (1, 0), (2, 0), (3, 0), (4, 0), (10, 1), (10, 2)]
    assert collect(LE.find_leaks(d, e)) == sorted(want, key=str)
    assert LE.find_leaks(d.limit(0), e).count() == 0 and LE.find_leaks(d, e.limit(0)).count() == 0
    assert collect(LE.find_leaks(d, e, block_words=200)) == sorted(want, key=str)


def test_short_passages_and_halves(spark):
    """Passages of 6 words and more, and halves of them, planted in noise; one in ten changed where ten are there."""
    rnd = random.Random(7)
    fresh = iter(rnd.sample([f"{a}{b}{c}" for a in WORDS for b in "bcdfg" for c in "aeiou"], 1500))
    docs, items, want = [], [], set()
    for n in (5, 6, 8, 10, 14, 18, 20, 24, 30, 38, 43, 60, 142):
        for k in range(4):
            p = [next(fresh) if rnd.random() < 0.3 else rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n)]
            item = len(items)
            items.append((item, " ".join(p)))
            half = max(3, -(-n // 2))
            at = rnd.randrange(n - half + 1)
            parts = [p, p[at : at + half]]
            if half >= 10:
                parts.append([("zq" if i % 10 == 5 and i // 10 < half // 10 else w) for i, w in enumerate(p[at : at + half])])
            for part in parts:
                noise = [rnd.choice(WORDS) for _ in range(200)]
                cut = rnd.randrange(200)
                want.add((len(docs), item))
                docs.append((len(docs), " ".join(noise[:cut] + part + noise[cut:])))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    got = {tuple(r) for r in LE.find_leaks(d, e).collect()}
    assert want <= got and len(got - want) <= 2
    assert {tuple(r) for r in LE.find_leaks(d, e, block_words=300).collect()} >= want


def test_long_passage(spark):
    rnd = random.Random(9)
    p = [f"{rnd.choice(WORDS)}{rnd.randrange(99)}" for _ in range(6000)]
    d = spark.createDataFrame([(1, " ".join(["zz"] * 50 + p[1500:4600])), (2, " ".join(p[1500:4150])), (3, " ".join(WORDS * 50))], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, " ".join(p))], "item_id bigint, passage string")
    assert [tuple(r) for r in LE.find_leaks(d, e).collect()] == [(1, 7)]


def test_the_corpus_is_read_once(spark):
    e = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(300)], "item_id bigint, passage string")
    d = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(40)], "doc_id bigint, text string")
    out = LE.find_leaks(d, e, block_words=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Union" not in plan and out.count() == 40


def test_svd_spans_the_rows(spark):
    ix = LE.Index([(i, [f"w{i}x{j % (7 + i)}" for j in range(60)]) for i in range(5)])
    rows = spark.createDataFrame(ix.rows(), "w int, terms array<int>, weights array<float>")
    v = LE.randomised_svd(rows, len(ix.windows), len(ix.terms), rank=60)
    a = np.zeros((len(ix.windows), len(ix.terms)))
    for w, t, x in ix.rows():
        a[w, t] = x
    assert np.linalg.norm(a - a @ v @ v.T) < 1e-3 * np.linalg.norm(a) and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)


def test_truncation(spark):
    ends = ["the filter was clogged", "the cable had chafed", "the belt had stretched", "a fuse had been removed"]
    full = [f"Table row {i} links pump {i} to motor {i}. In the same row it is written that {ends[i % 4]}." for i in range(60)]
    texts = [("k", i, -1, "s", t) for i, t in enumerate(full)]
    cut_off = ["Table row 5 links pump 5 to motor 5. In the same row it is wri", "Table row 5 links pump 5 to motor 5. In the same row it is written that the filter was", "Table row 7 links pump 7 to mo�", "Table row 9 links pump 9 to motor 9. In the sa [...", "Table row 9 links pump 9 to motor 9. In the same…"]
    fine = ["Table row 5 links pump 5 to motor 5. In the same row it is written that the cable had chafed", "TODO", "-", "n/a", "", " ", None, "Row 12 of the list", "Row 13 of the list", "Row 14 of the list", "x" * 20_000 + "."]
    texts += [("k", 100 + i, -1, "s", t) for i, t in enumerate(cut_off)] + [("k", 200 + i, 0, None, t) for i, t in enumerate(fine)]
    df = spark.createDataFrame(texts, "tbl string, row_id bigint, ev_pos int, source_code string, text string").withColumn("word", F.lit("clash"))
    assert {r["row_id"] for r in find_truncated(df).collect()} == set(range(100, 100 + len(cut_off)))
    assert find_truncated(df.limit(0)).count() == 0
    assert tokens("A no. 5, b.") == ["a", "no", ".", "#", ",", "b", "."]


def test_truncation_by_length(spark):
    base = [("k", i, -1, "s", f"Alpha beta {'gamma ' * 12}delta ended here.") for i in range(40)]
    limit = [("k", 100 + i, -1, "s", f"Alpha beta {'gamma ' * 12}delta ended here"[:90].ljust(90, "x")) for i in range(20)]
    got = {r["row_id"] for r in find_truncated(spark.createDataFrame(base + limit, "tbl string, row_id bigint, ev_pos int, source_code string, text string")).collect()}
    assert got == set(range(100, 120))
    none = [(a, b, c, None, t) for a, b, c, _, t in base + limit]  # rows without a source have a limit too
    assert {r["row_id"] for r in find_truncated(spark.createDataFrame(none, "tbl string, row_id bigint, ev_pos int, source_code string, text string")).collect()} == set(range(100, 120))


def test_notes_and_forms_without_full_stop_are_whole(spark):
    full = [f"Table row {i} links pump {i} to motor {i}. In the same row it is written that the filter was clogged." for i in range(40)]
    notes = ["n/a"] * 30 + [f"Label pair {a} and {b}" for a in ("worn seal", "shaft seal", "pump") for b in ("worn seal", "shaft seal", "motor", "pump 7")]
    rows = [("k", i, -1, "s", t) for i, t in enumerate(full + notes)] + [("k", 900, -1, "s", "Table row 5 links pump 5 to motor 5. In the same row it is writ")]
    assert {r["row_id"] for r in find_truncated(spark.createDataFrame(rows, "tbl string, row_id bigint, ev_pos int, source_code string, text string")).collect()} == {900}


AREAS = {"law": ["court", "judge", "claim", "statute", "appeal"], "sport": ["match", "goal", "team", "coach", "league"], "medicine": ["patient", "fever", "ward", "dose", "nurse"]}


def _sentence(rnd, area):
    w = AREAS[area]
    return f"The {rnd.choice(w)} of the {rnd.choice(w)} was seen near the {rnd.choice(w)} on day {rnd.randrange(99)}."


def test_areas(spark):
    rnd = random.Random(3)
    docs, truth, labels = [], {}, []
    for i in range(300):
        parts = rnd.choice([("law",), ("sport",), ("medicine",), ("law", "sport")])
        ss = [_sentence(rnd, parts[k % len(parts)]) for k in range(6)]
        docs.append((i, "Page 3 / 9\n" + " ".join(ss), f"src_{parts[0]}"))
        truth[i] = set(parts)
        if i < 120:
            labels.append((i, rnd.choice(list(AREAS)) if i % 12 == 0 else parts[0].upper() if i % 5 == 0 else parts[0]))
    docs += [(900, None, None), (901, "", "x"), (902, "....", None), (903, "0000 1111", "src_law"), (904, " ".join(_sentence(rnd, "law") for _ in range(3000)), None), (905, "<div>" + _sentence(rnd, "sport") + "<br/>" + _sentence(rnd, "sport") + "</div>", None)]
    truth |= {904: {"law"}, 905: {"sport"}}
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("pattern", F.lit(1))
    lab = spark.createDataFrame([*labels, (5, None), (None, "law"), (7, "nonsense")], "doc_id bigint, area_code string")
    ar = spark.createDataFrame([(a, a.title(), ", ".join(w[:2])) for a, w in AREAS.items()], "area_code string, area_name string, description string")
    got = {}
    for r in SA.assign(d, lab, ar).collect():
        got.setdefault(r["doc_id"], set()).add(r["area_code"])
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.98 * len(truth) and not set(got) & {900, 901, 902, 903}
    assert SA.assign(d.limit(0), lab, ar).count() == 0
    assert SA.assign(d, lab.limit(0), ar).count() > 0


def test_accuracies_are_learned():
    rnd = np.random.default_rng(0)
    y = rnd.integers(1, 4, 4000)
    vote = lambda acc: np.where(rnd.random(4000) < acc, y, rnd.integers(1, 4, 4000))
    pats = np.stack([vote(0.9), vote(0.8), np.zeros(4000, int), vote(0.7), vote(0.3)], axis=1)
    u, inv, n = np.unique(pats, axis=0, return_inverse=True, return_counts=True)
    post = SA.learn_accuracies(u, n.astype(float), 3)
    assert (post.argmax(axis=1)[inv.ravel()] == y).mean() > 0.93


def test_functions_look_at_different_things():
    ids = {w: i for i, w in enumerate(sum(AREAS.values(), []))}
    weight = np.zeros((15, 3))
    weight[np.arange(15), np.arange(15) // 5] = 4.0
    voter = SA.Voter(ids, weight, {"law": ["statutes"], "sport": ["games"], "medicine": []}, list(AREAS), {"press": 3}, {"fifa.com": 2})
    text = "Goal of the team\nIt was seen on day 4 that all were late again.\n\nNotes\nSee https://www.fifa.com/x or statutes for the court in June."
    assert list(voter.votes([text, None], ["press", "zz"])) == [[(0, 0, 0, 2, 3), (1, 1, 2, 0, 3)], []]
    assert SA.mostly([("a", 1)] * 5 + [("b", 2)] * 4 + [("c", 1), ("c", 2), ("c", 3)] * 2) == {"a": 1}


def test_repair():
    assert SA.repaired("<div>dÃ©faut</div>de-\nbut").split() == ["défaut", "debut"]
    assert len(SA.sentences("Page 3 / 9\nThe pump of the line failed again. The valve of the line was shut, too. - 9 -")) == 2


def test_plan():
    tokens = {"a": 1000, "b": 100, "c": 10}
    w, budget, e = MI.plan(tokens, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 8), "gone": (0.1, 2)})
    assert e == 1.0 and budget == 400 and abs(w["a"] - 0.5) < 1e-9 and abs(sum(w.values()) - 1) < 1e-9
    w2, b2, e2 = MI.plan(tokens, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 8)}, 800)
    assert 0 < e2 < 1 and b2 == 800 and all(w2[s] * 800 <= tokens[s] * r * 1.0001 for s, r in (("a", 1), ("b", 4), ("c", 8)))
    assert MI.plan({}, {"a": (1.0, 1)}) == ({}, 0, 1.0)
    s = {"a": 0.9, "b": 0.1}
    x = MI.exponent_for_entropy(s, 0.6)
    assert abs(MI.entropy(MI.temperature(s, x)) - 0.6) < 1e-3


def test_plan_against_closed_forms():
    tokens, targets = {"a": 6400, "b": 1600, "c": 400}, {"a": (0.2, 1), "b": (0.3, 4), "c": (0.5, 8)}
    # all sources may give 6400 + 6400 + 3200 tokens; at the exponent 0 the shares are those, 0.4, 0.4, 0.2
    w, budget, e = MI.plan(tokens, targets, 16_000)
    assert abs(e) < 1e-6 and budget == 16_000 and all(abs(w[s] - x) < 1e-6 for s, x in (("a", 0.4), ("b", 0.4), ("c", 0.2)))
    # the source c binds: 0.5^e 0.2^(1-e) / sum = 3200 / budget; at e = 1/2 that is sqrt(.1) / (sqrt(.08) + sqrt(.12) + sqrt(.1))
    share = 0.1**0.5 / (0.08**0.5 + 0.12**0.5 + 0.1**0.5)
    w, budget, e = MI.plan(tokens, targets, int(3200 / share))
    assert abs(e - 0.5) < 1e-3 and abs(w["c"] - share) < 1e-3
    # entropy: natural shares of two sources are 0.8 and 0.2; to the power 1/2 they are 2/3 and 1/3
    two = {"a": 8000, "b": 2000}
    want = -(2 / 3 * np.log(2 / 3) + 1 / 3 * np.log(1 / 3))
    w, budget, e = MI.plan(two, {"a": (0.5, 1), "b": (0.5, 2)}, goal_entropy=want)
    assert abs(e - 0.5) < 1e-6 and abs(w["a"] - 2 / 3) < 1e-6 and budget == int(min(8000 / w["a"], 4000 / w["b"]))
    w, _, e = MI.plan(two, {"a": (2 / 3, 1), "b": (1 / 3, 2)}, goal_entropy="targets")
    assert abs(e - 0.5) < 1e-6
    w, _, e = MI.plan(two, {"a": (16 / 17, 1), "b": (1 / 17, 2)}, goal_entropy="targets")
    assert abs(e - 2.0) < 1e-6 and abs(w["a"] - 16 / 17) < 1e-6  # a lower entropy than the natural one: exponent over 1
    w, budget, e = MI.plan(two, {"a": (0.5, 1), "b": (0.5, 1)}, 10_000, goal_entropy=0.69)
    assert abs(e - 1.0) < 1e-6 and budget == 10_000  # only the natural shares fit that budget


def test_mix(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 40), "a" if i < 300 else "b" if i < 340 else None) for i in range(360)] + [(900, None, "a"), (901, "", "a"), (902, "lone", "c")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("block", F.lit(1))
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    taken, report = MI.mix(d, t, blocks=8)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["a"]["actual_share"] - 0.4) < 0.03 and abs(r["b"]["actual_share"] - 0.6) < 0.03 and r["b"]["repeats"] <= 3.01 and r["none"]["mixed_tokens"] == 0 and r["c"]["mixed_tokens"] == 0
    assert taken.groupBy("source", "pass", "doc_id").count().where("count > 1").count() == 0
    assert MI.mix(d.limit(0), t)[0].count() == 0
    big = MI.mix(d, t, budget="corpus", blocks=8)[1].where("source in ('a', 'b')").collect()
    assert all(x["exponent"] < 1 and x["repeats"] <= x["max_repeats"] + 0.01 and abs(x["planned_share"] - x["actual_share"]) < 0.03 for x in big)
    even = MI.mix(d, t, entropy=np.log(2), blocks=8)[1].where("source in ('a', 'b')").collect()
    assert all(abs(x["exponent"]) < 1e-3 and abs(x["actual_share"] - 0.5) < 0.05 for x in even)
