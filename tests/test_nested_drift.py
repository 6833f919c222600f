import json

from lodeweave.operators.drift import changes, correspondences, flood, one_table, record_fields
from lodeweave.operators.nested import LAYER10, LAYER11, flatten_json, flatten_typed, layer10_tables


def test_layer10_shapes(spark, collect):
    full = {"validation_report": {"issues": [None, {"issue_id": "i1"}, {"message": "no id"}]}, "reasoning_report": {"inferred_triples": {"triple_id": "t", "provenance": [None, {"chunk_id": "c"}]}, "inferred_general_axioms": [], "notes": ["x"]}}
    data = [
        (1, json.dumps(full)), (2, json.dumps(json.dumps(full))), (3, None), (4, ""), (5, "[1, 2]"), (6, "{broken"), (7, json.dumps({"validation_report": json.dumps(full["validation_report"]), "reasoning_report": None})),
        (8, json.dumps({"validation_report": {"issues": "none"}, "reasoning_report": {"inferred_triples": []}})), (9, json.dumps({"validation_report": {"issues": [{"issue_id": "x" * 50_000}]}})),
    ]
    df = spark.createDataFrame(data, "rec_id bigint, payload string").selectExpr("*", "'clash' AS path", "1 AS pos", "'y' AS _top")
    got = collect(flatten_json(df, "rec_id", "payload", LAYER10))
    one = [("validation_report.issues", -1, 1, "i1"), ("validation_report.issues", -1, 2, ""), ("reasoning_report.inferred_triples", -1, 0, "t"), ("reasoning_report.inferred_triples.provenance", 0, 1, "c")]
    want = [(r, *x) for r in (1, 2) for x in one] + [(7, *one[0]), (7, *one[1]), (9, "validation_report.issues", -1, 0, "x" * 50_000)]
    assert got == sorted(want, key=str)
    assert layer10_tables(df)["triples"].count() == 2
    assert flatten_json(df.limit(0), "rec_id", "payload", LAYER10).count() == 0


def test_layer11_shapes(spark, collect):
    ev = "array<struct<chunk_id:string,snippet:string>>"
    schema = f"rec_id bigint, completed_triple struct<triple_id:string,provenance:{ev}>, completed_axiom struct<axiom_id:string,evidence:{ev}>, evidence {ev}"
    data = [(1, ("t", [("c", "s"), None, (None, "s")]), None, []), (2, None, ("a", None), [None, ("d", None)]), (3, None, None, None)]
    got = collect(flatten_typed(spark.createDataFrame(data, schema), "rec_id", LAYER11))
    assert got == sorted(
        [(1, "completed_triple", -1, 0, "t"), (1, "completed_triple.provenance", 0, 0, "c"), (1, "completed_triple.provenance", 0, 2, ""), (2, "completed_axiom", -1, 0, "a"), (2, "evidence", -1, 1, "d")], key=str
    )


def test_record_fields():
    got = dict((p, (k, t)) for p, k, t in record_fields('{"a": 1.50, "b": null, "c": [{"d": "x"}, {"d": "y"}, 3], "e": {"f": true}, "g": []}'))
    assert got["a"] == ("number", "1.50") and "b" not in got and got["c"][0] == "array" and got["c.d"] == ("string", "x\u0001y") and got["e"][0] == "object" and got["e.f"] == ("boolean", "true") and got["g"][0] == "array"
    assert record_fields(None) == record_fields("nonsense") == record_fields("[1]") == []


def _lines(files):
    out, n = [], 0
    for at, (feed, name, recs) in enumerate(files):
        for i, (key, rec) in enumerate(recs):
            out.append((n, feed, "kg_inferred", name, f"2024-01-{at + 1:02d} 00:00:00", i, key, rec if rec is None or isinstance(rec, str) else json.dumps(rec)))
            n += 1
    return out


LINES = "line_id bigint, feed string, export_kind string, file_name string, written_at string, line_no int, rec_key string, payload string"


def test_changes(spark, collect):
    files = [
        ("f", "one", [("k1", {"chunk_id": "c1", "conf": 0.5, "x": 1}), ("k2", {"chunk_id": "c2", "conf": 0.6, "x": 2}), ("k3", {"chunk_id": "c3", "conf": 0.7, "x": 3})]),
        ("f", "two", [("k1", {"Chunk ID": "c1", "conf": "0.5"}), ("k2", {"Chunk ID": "c2", "conf": "0.6", "n": {"m": 1}}), ("k2", {"Chunk ID": "c2", "conf": "0.6", "n": {"m": 1}})]),
        ("f", "three", [("k1", {"Chunk ID": ["c1"], "confidence": "0.5"}), ("k2", {"Chunk ID": ["c2"], "confidence": "0.9"}), ("k9", {"Chunk ID": ["c2"], "confidence": "0.9"}), (None, None), ("k8", "{bad")]),
        ("g", "lone", [("k1", {"a": 1})]),
    ]
    df = spark.createDataFrame(_lines(files), LINES)
    want = [
        ("f", "two", "renamed", "chunk_id", "Chunk ID"), ("f", "two", "retyped", "conf", ""), ("f", "two", "removed", "x", ""), ("f", "two", "added", "n", ""), ("f", "two", "added", "n.m", ""),
        ("f", "three", "retyped", "Chunk ID", ""), ("f", "three", "removed", "n", ""), ("f", "three", "removed", "n.m", ""), ("f", "three", "removed", "conf", ""), ("f", "three", "added", "confidence", ""),
    ]
    assert collect(changes(df)) == sorted(want, key=str)  # half of the values is not more than half
    assert changes(df.limit(0)).count() == 0
    table = {r["line_id"]: r for r in one_table(df).collect()}
    chunk, conf = ([c for c in table[0]["record"].asDict() if c.lower().startswith(x)] for x in ("chunk", "conf"))
    assert len(chunk) == len(conf) == 1  # one name each
    assert [table[i]["record"][chunk[0]] for i in (0, 3, 6)] == ["c1", "c1", "c1"] and table[0]["record"][conf[0]] == 0.5 == table[6]["record"][conf[0]] and len(table) == df.count()
    bad = {r["line_id"]: r for r in one_table(df).collect() if r["record"] is None}
    assert sorted(bad) == [9, 10] and bad[10]["unfitted"] == {"": "{bad"} and one_table(df.limit(0)).count() == 0


def test_one_table_drops_nothing(spark):
    """Fields that move between levels, files without common records, values that do not fit: every value is still there."""
    files = [
        ("f", "one", [("k1", {"chunk_id": "c1", "snippet": "text one", "ev": [{"pos": 1}, {"pos": 2}], "x": 1}), ("k2", {"chunk_id": "c2", "snippet": "text two", "ev": {"pos": "3"}, "x": "many"})]),
        ("f", "two", [("k1", {"source": {"chunk_id": "c1"}, "snippet": "text one", "ev": [], "x": [5]}), ("k2", {"source": {"chunk_id": "c2"}, "snippet": "text two", "ev": ["loose"]})]),
        ("g", "three", [("k7", {"chunkId": "c7", "snippet": "text seven"})]),
        ("g", "four", [("k8", {"chunk_id": "c8", "snippet_text": "text eight", "X": 2})]),
    ]
    rows = {r["rec_key"] + r["file_name"]: r for r in one_table(spark.createDataFrame(_lines(files), LINES)).collect()}
    whole = " ".join(str(r["record"]) + str(r["unfitted"]) for r in rows.values())
    for v in ("text one", "text two", "text seven", "text eight", "c1", "c2", "c7", "c8", "many", "loose"):
        assert v in whole
    one, two, seven, eight = (rows[k]["record"] for k in ("k1one", "k1two", "k7three", "k8four"))
    assert [x["pos"] for x in one["ev"]] == [1.0, 2.0] and [x["pos"] for x in rows["k2one"]["record"]["ev"]] == [3.0]
    assert rows["k2one"]["unfitted"] == {"x": "many"} and two["x"] == 5.0 and rows["k2two"]["unfitted"] == {"ev": '["loose"]'}
    chunk = lambda r: r["chunk_id"] if "chunk_id" in r.asDict() and r["chunk_id"] else r["source"]["chunk_id"]
    assert chunk(one) == chunk(two) == "c1"  # the field moved to another level and is one column
    assert seven["snippet"] == "text seven" and eight["snippet"] == "text eight" and seven["chunk_id"] == "c7" and eight["chunk_id"] == "c8"  # no record in common
    plain = one.asDict()
    assert len([c for c in plain if "snippet" in c.lower()]) == 1


def test_flooding_uses_types_and_nesting():
    old = {"a": "object", "a.n": "number", "a.t": "string", "z": "array"}
    new = {"b": "object", "b.p": "number", "b.q": "string", "z": "array"}
    s = flood(old, new, {})
    assert s["a.n", "b.p"] > s["a.n", "b.q"] and s["a.t", "b.q"] > s["a.t", "b.p"] and s["a", "b"] > s["a", "b.p"] and max(s.values()) == 1.0


def test_flooding_prefers_neighbours():
    old = {"a": "object", "a.id": "string", "b": "object", "b.id": "string"}
    new = {"a": "object", "a.key": "string", "b": "object", "b.id": "string"}
    assert ("a.id", "a.key") in [(x, y) for x, y, _ in correspondences(old, new, {})]
    s = flood(old, new, {})
    assert s["a.id", "a.key"] > s.get(("b.id", "a.key"), 0.0)
