from pyspark.sql import functions as F

from lodeweave.hooks import Hooks
from lodeweave.operators import graph, metrics, retrieval, structure
from lodeweave.plans import pipeline

HTML = """<table><tr><th>Alarm no.</th><td>1013</td></tr><tr><th>Text</th><td>SIDE GUARDS OPEN</td></tr>
<tr><th>Cause</th><td>guard switch open</td></tr><tr><th>Effect</th><td>stop at end of cycle</td></tr>
<tr><th>Intervention</th><td>close the guard</td></tr><tr><th>Responsible</th><td>operator/maintenance</td></tr></table>"""


def test_tables(spark):
    df = spark.createDataFrame([("c", HTML), ("d", None), ("e", "<td colspan=2>a</td><td>b")], "chunk_id string, html string")
    cells = structure.parse_tables(df)
    rows = {r["field"]: r["values"] for r in structure.field_values(cells.where("chunk_id = 'c'")).collect()}
    assert len(rows) == 6 and rows["Alarm no."] == ["1013"] and rows["Responsible"] == ["operator/maintenance"]
    assert [r["col"] for r in cells.where("chunk_id = 'e'").orderBy("col").collect()] == [0, 2]
    from lodeweave.operators.extraction import records_from_fields, split_responsible

    rec = records_from_fields(structure.field_values(cells), {}).where("chunk_id = 'c'").first()
    assert rec["cause_items"] == ["guard switch open"] and rec["label"] == "SIDE GUARDS OPEN"
    assert spark.createDataFrame([("operator/maintenance et x",)], "t string").select(split_responsible(F.col("t"))).first()[0] == ["operator", "maintenance", "x"]
    assert df.where("chunk_id = 'c'").select(F.size(structure.cell_texts(F.col("html")))).first()[0] == 12


def test_pages(spark, collect):
    pages = spark.createDataFrame([(1, p, f"HEAD {p}\nbody {chr(96 + p)}\nfoot") for p in range(1, 6)] + [(2, 1, "a\n\nb"), (2, 2, None)], "doc_id int, page int, text string")
    lines = structure.page_lines(pages.where("text is not null"), edge=1)
    rep = structure.repeated_lines(lines)
    assert collect(rep) == [(1, "foot", 5), (1, "head #", 5)]
    assert structure.drop_repeated(lines, rep).where("doc_id = 1").count() == 5
    words = spark.createDataFrame([(1, 1, 10.0, 1.0, "A"), (1, 1, 13.0, 9.0, "B"), (1, 1, 15.0, 0.0, "C"), (1, 1, 30.0, 0.0, "D")], "doc_id int, page int, top double, x0 double, word string")
    assert [r["line"] for r in structure.reconstruct_lines(words).orderBy("line_no").collect()] == ["A B", "C", "D"]
    ch = structure.carry_chapter(spark.createDataFrame([(1, 1, None), (1, 2, "I"), (1, 3, None)], "doc_id int, page int, chapter string"))
    assert [r["chapter"] for r in ch.orderBy("page").collect()] == [None, "I", "I"]


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "The filter and the pump. Filter again with the relief valve."), (2, ""), (3, None), (4, "nothing here")], "doc_id int, text string")
    lex = spark.createDataFrame([("filter", "part"), ("pump", "part"), ("Relief Valve", "part"), (None, "x")], "term string, label string")
    t = pipeline.from_documents(docs, lex)["triples"].orderBy("triple_id").collect()
    assert [(r["subject_label"], r["object_label"], r["triple_id"]) for r in t] == [("filter", "pump", "triple_00000"), ("pump", "relief valve", "triple_00001")]


def test_ontology_of(spark):
    c = spark.createDataFrame([(1, "e0", "Guard", "entity", 0, 0.9, None, ["PLC Alarm"]), (1, "e1", "guard", "entity", 1, 0.5, None, ["PLC Alarm"]), (1, "e2", "x", "entity", 2, 0.5, None, ["promote_to_ontology:false"])], "doc_id int, candidate_id string, canonical_label string, candidate_type string, ord int, confidence double, definition string, hints array<string>")
    r = spark.createDataFrame([(1, "r0", "causes", "relation", 0, None, None, ["domain:PLC Alarm", "range:Effect"])], c.schema)
    t = spark.createDataFrame([(1, "t0", "e0", "Guard", "entity", "r0", "causes", "e1", "guard", "entity", "c")], "doc_id int, triple_id string, subject_id string, subject_label string, subject_type string, predicate_id string, predicate_label string, object_id string, object_label string, object_type string, chunk_id string")
    out = pipeline.ontology_of(c, r, t)
    assert [x["source_candidate_ids"] for x in out["concepts"].collect()] == [["e0", "e1"]]
    assert {x["schema_type"] for x in out["schemata"].collect()} == {"relation_domain", "relation_range", "subclass", "subproperty"}
    assert out["axioms"].count() == 6 and out["completions"].count() == 0
    assert [x["issue_type"] for x in out["issues"].collect()] == ["range_mismatch"]


def test_hooks(spark):
    df = spark.createDataFrame([("p",), (None,)], "t string")

    def boom(x):
        raise RuntimeError("down")

    got = [r[0] for r in df.select(Hooks(judge=boom).column("judge", F.col("t"), retries=0)).collect()]
    assert all("down" in g for g in got)
    assert [r[0] for r in df.select(Hooks().column("relation", F.col("t"))).collect()][1] is None


def test_spaces(spark, collect):
    reg = retrieval.Registry()
    reg.register("web", retrieval.offline_source(spark.createDataFrame([("Pump", "moves oil", "wiki")], "term string, text string, source string")))
    assert collect(reg.ground(spark.createDataFrame([("pump",), ("x",)], "query string"))) == [("pump", "- moves oil")]
    s = spark.createDataFrame([(1, 0, 10, "long"), (1, 5, 7, "in"), (1, 10, 12, "next")], "doc_id int, start int, end int, label string")
    assert [r["label"] for r in retrieval.drop_overlaps(s).orderBy("start").collect()] == ["long", "next"]
    a = retrieval.alias_enrichment(spark.createDataFrame([(1, "feed pump", ["b"]), (2, None, None)], "id int, label string, aliases array<string>"), spark.createDataFrame([("Pump", ["a", "b"])], "key string, aliases array<string>"))
    assert [r["aliases"] for r in a.orderBy("id").collect()] == [["a", "b"], []]


def test_grounding(spark):
    ch = spark.createDataFrame([(1, "c", "Alarm 5: guard open causes a stop of the machine")], "doc_id int, chunk_id string, chunk string")
    t = spark.createDataFrame([(1, 1, "guard open", "CAUSES", "stop", "c", True), (1, 2, "pump", "CAUSES", "stop", "c", True), (1, 3, "guard open", "CAUSES", "stop", "zz", None)], "doc_id int, id int, head string, relation string, tail string, chunk_id string, has_provenance boolean")
    out = {r["id"]: (r["score"], r["grounded"]) for r in metrics.source_grounding(t, ch, {"CAUSES": ["causes"]}).collect()}
    assert out == {1: (1.0, True), 2: (0.55, False), 3: (0.0, False)}
    n = graph.node_table(spark.createDataFrame([("a", "Pump", "part", 0)], "case string, label string, type string, ord int"), spark.createDataFrame([("a", "pump", "x", "valve", "y", 0)], "case string, subject_label string, subject_type string, object_label string, object_type string, ord int"))
    assert {(r["label"], r["origin"]) for r in n.collect()} == {("Pump", "candidate"), ("valve", "triple")}
