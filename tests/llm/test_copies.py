import json
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeweave.llm.ledger import Ledger, build_ledger, copies, digest, label_key, object_key, triple_keys
from lodeweave.llm.survivor import branch_and_bound, choose, survivors
from lodeweave.session import scratch

NODE = "struct<id:string,label:string,type:string>"
KG = f"row_id bigint, doc_id bigint, run_id string, source_code string, triple_id string, subject {NODE}, predicate struct<id:string,label:string>, object {NODE}, chunk_id string, justification string, confidence double, metadata string, exported_at timestamp, bucket int, key string, copies int"


def kg(i, s, p, o, meta=None, doc=1, run="r", src="a", conf=0.5, just=None, at=0, triple="t"):
    node = lambda x: ("id", x, "component")
    return (i, doc, run, src, triple, node(s), ("id", p), node(o), "c", just, conf, meta, datetime(2024, 1, 1) + timedelta(days=at), 7, "clash", 9)


def test_keys(spark):
    df = spark.createDataFrame([("Return-Filter 7/6", "RETURN filter 7.6 "), ("a 76", "a 7/6"), ("é", "e"), ("7 6", "7-_-6"), ("", "--"), ("a1b", "a 1 b")], "x string, y string")
    assert [r[0] for r in df.select(label_key(F.col("x")) == label_key(F.col("y"))).collect()] == [True, False, False, True, True, True]
    m = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"b":"x" ,"a":1}'), ('{"a": 1}', '{"a": "1"}'), ("{}", None), ("bad {", "bad {"), ('{"a": null}', "{}"), (None, None)], "x string, y string")
    assert [r[0] for r in m.select(object_key(F.col("x")).eqNullSafe(object_key(F.col("y")))).collect()] == [True, False, False, True, False, True]
    d = spark.createDataFrame([("ab", "c", "a", "bc"), (None, "", "", None)], "a string, b string, c string, d string")
    assert [r[0] for r in d.select(digest(F.col("a"), F.col("b")) == digest(F.col("c"), F.col("d"))).collect()] == [False, False]


def brute(rows):
    def norm(x):
        x = re.sub(r"(?<=\d)[^\w]+(?=\d)", "\u0001", x.lower().replace("_", " "))
        return re.sub(r"[^\w\u0001]", "", x)

    groups = {}
    for r in rows:
        labels = (r[5][1], r[6][1], r[7][1])
        if None not in labels:
            meta = None if r[11] is None else json.dumps(json.loads(r[11]), sort_keys=True)
            groups.setdefault((r[1], *map(norm, labels), meta), []).append(r[0])
    return sorted(((min(g), x) for g in groups.values() for x in g if x != min(g)), key=str)


def test_copies_equal_brute_force(spark, collect):
    rnd = random.Random(1)
    rows = []
    for i in range(240):
        hot = i % 3 == 0
        s = "Valve 7/6" if hot else rnd.choice(["valve 7.6", "VALVE-7-6", "valve 76", "pump", None])
        meta = '{"page": 1, "no": "2"}' if hot else rnd.choice([None, '{"no":"2" ,"page":1}', '{"page": 2}'])
        rows.append(kg(i, s, rnd.choice(["drives", "Drives "]), "x" * 2000 if i % 7 == 0 else "motor", meta, doc=1 if hot else rnd.randrange(2)))
    df = spark.createDataFrame(rows, KG)
    assert collect(copies(df)) == brute(rows)
    assert copies(df.limit(0)).count() == 0
    ledger = build_ledger(triple_keys(df), batches=3)
    n = sum(r[5][1] is not None for r in rows)
    assert ledger.read().agg(F.sum("copies")).first()[0] == n and ledger.read().select("key").distinct().count() == ledger.read().count()


def test_ledger_batches(spark, collect):
    path = scratch(spark, "t")
    a = spark.createDataFrame([(b"k1", 5), (b"k1", 3), (b"k2", 9)], "key binary, row_id bigint")
    ledger = Ledger(spark, path, buckets=4)
    ledger.merge(a)
    ledger.merge(a.limit(0))
    ledger.merge(spark.createDataFrame([(b"k1", 1), (b"k3", 2)], "key binary, row_id bigint"))
    assert {(bytes(r["key"]), r["copies"], r["keep_row_id"]) for r in Ledger(spark, path, 4).read().collect()} == {(b"k1", 3, 1), (b"k2", 1, 9), (b"k3", 1, 2)}


def test_ledger_survives_deaths(spark, monkeypatch):
    """A run that dies before its manifest is in place changes nothing; a batch that comes again counts once."""
    path = scratch(spark, "d")
    a = spark.createDataFrame([(b"k%d" % (i % 30), i) for i in range(90)], "key binary, row_id bigint")
    b = spark.createDataFrame([(b"k1", 1000), (b"new", 1001)], "key binary, row_id bigint")
    state = lambda: sorted((bytes(r["key"]), r["copies"], r["keep_row_id"]) for r in Ledger(spark, path).read().collect())
    assert Ledger(spark, path, 4).merge(a, "a") and not Ledger(spark, path).merge(a, "a")
    before = state()
    assert len(before) == 30 and before[0] == (b"k0", 3, 0)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_publish", lambda *_: (_ for _ in ()).throw(OSError("died")))
        for _ in range(2):
            try:
                Ledger(spark, path).merge(b, "b")
                raise AssertionError
            except OSError:
                pass
        assert state() == before
    with monkeypatch.context() as m:  # dies after the manifest, before old files are removed
        m.setattr(Ledger, "_tidy", lambda *_: (_ for _ in ()).throw(OSError("died")))
        try:
            Ledger(spark, path).merge(b, "b")
        except OSError:
            pass
    assert not Ledger(spark, path).merge(b, "b") and len(state()) == 31 and (b"k1", 4, 1) in state()
    ledger = Ledger(spark, path)
    assert ledger.buckets == 4 and ledger.manifest()["delta"] is not None  # two keys are no tenth of thirty
    base = ledger.manifest()["base"]
    assert ledger.merge(spark.createDataFrame([(b"n%d" % i, 2000 + i) for i in range(9)], "key binary, row_id bigint"), "c")
    assert ledger.manifest()["delta"] is None and ledger.manifest()["base"] != base and len(state()) == 40
    plan = ledger._joined(ledger._level(ledger.manifest()["base"]), b.groupBy("key").agg(F.count("*").alias("copies"), F.min("row_id").alias("keep_row_id")))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    ledger.drop()


def test_branch_and_bound_equals_brute_force():
    rnd = random.Random(2)
    for n in range(300):
        weighed = n % 2 == 0
        bundles = [[(float(rnd.randrange(4)), rnd.randrange(3), -i, rnd.choice([None, "x", "y"])) for i in range(rnd.randrange(4))] for _ in range(3)]
        rules = [(1, 2)] if rnd.random() < 0.7 else []
        ranked = [sorted(b, reverse=True, key=lambda c: c[:3]) for b in bundles]

        def worth(pick):
            if any(pick[i] and pick[j] and pick[i][3] and pick[j][3] and pick[i][3] != pick[j][3] for i, j in rules):
                return -1.0
            return sum(c[0] if weighed else len(ranked[i]) - ranked[i].index(c) for i, c in enumerate(pick) if c)

        picks = [(a, b, c) for a in [*ranked[0], None] for b in [*ranked[1], None] for c in [*ranked[2], None]]
        best = max(map(worth, picks))
        assert tuple(branch_and_bound(bundles, rules, weighed)) == next(p for p in picks if worth(p) == best)


def test_choose(spark, collect):
    long, mid = "j" * 40, "j" * 25
    rows = [
        kg(1, "a", "b", "c", conf=0.9, src="low", just=mid, at=1, run="r1"), kg(2, "A", "b", "c", conf=0.1, src="top", just=f"  {long}  ", at=0, run="r2"), kg(3, "a", "B", "c", conf=-1.0, src="top", just="short", at=9),
        kg(4, "a", "b", "c", conf=0.2, src="top", just=long, at=0), kg(5, "x", "b", "c", just=long), kg(6, "n", "b", "c", conf=None, src=None, just=None), kg(7, "n", "b", "c", conf=-1.0, src="zz", just="", run="none"),
    ]
    df = spark.createDataFrame(rows, KG)
    src = spark.createDataFrame([("top", 1), ("low", 5), (None, 0)], "source_code string, trust_rank int")
    l5 = spark.createDataFrame([(10, "r1", "t", "c", ["", "ab"], 0), (11, "r2", "t", "c", ["abc", None], 1), (12, "r2", "t", "c", ["abd"], 2), (13, "q", "t", "c", ["longest of all"], 0), (14, "none", "t", "c", None, 0)], "row_id bigint, run_id string, triple_id string, chunk_id string, s array<string>, d int")
    l5 = l5.select("row_id", "run_id", "triple_id", "chunk_id", F.transform("s", lambda x: F.struct(x.alias("snippet"), F.lit("c").alias("chunk_id"))).alias("provenance"), F.lit("top").alias("source_code"), F.expr("timestampadd(DAY, d, timestamp'2024-01-01')").alias("created_at"))
    assert collect(choose(df, l5, src)) == sorted([(1, "confidence", 2), (1, "justification", 2), (1, "snippet", 12)], key=str)
    assert choose(df.limit(0), l5, src).count() == 0 and choose(df, l5.limit(0), src).where("field = 'snippet'").count() == 0
    got = {r["keep_row_id"]: r for r in survivors(df, l5, src).collect()}
    assert got[1]["confidence"] == 0.1 and got[1]["snippet"] == "abd" and set(got) == {1}
