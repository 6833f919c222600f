import random

from pyspark.sql import functions as F

from lodeweave.operators import consolidation, extraction, graph, matching, metrics, ontology, rules, triples, validation
from lodeweave.operators.components import connected_components
from lodeweave.operators.keys import append_new, dedup_evidence, dense_id, keep_first
from lodeweave.session import salted_join
from lodeweave.sources import readers, writers


def test_components(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("n1", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == set(parent)
    for x in parent:
        for y in parent:
            assert (find(x) == find(y)) == (got[x] == got[y])
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_keys(spark, collect):
    df = spark.createDataFrame([(1, None, 3), (1, None, 2), (2, "a", 5), (2, "a", 5)], "doc_id int, k string, o int")
    assert collect(keep_first(df, ["doc_id", "k"], ["o"])) == [(1, None, 2), (2, "a", 5)]
    assert [r["id"] for r in dense_id(df, "id", "t_", ["o"]).orderBy("doc_id", "o").collect()] == ["t_00000", "t_00001", "t_00000", "t_00001"]
    assert append_new(df, df.where("k is null"), ["k"]).count() == 2
    hot = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1)], "k int, i int")
    counts = hot.groupBy("k").agg(F.count("*").alias("n"))
    for least in (10, 10_000):
        assert salted_join(hot, spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string"), ["k"], F.col("i"), counts, least=least).count() == 300
        assert salted_join(hot, spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string"), ["k"], F.col("i"), counts, how="left", least=least).count() == 301
    ev = spark.sql("SELECT array(named_struct('chunk_id', 'c', 'chunk_start_char', 1, 'chunk_end_char', 2, 'snippet', 's'), named_struct('chunk_id', 'c', 'chunk_start_char', 1, 'chunk_end_char', 2, 'snippet', 's'), null) AS e")
    assert ev.select(F.size(dedup_evidence(F.col("e")))).first()[0] == 1


def test_closure_with_cycle(spark, collect):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "a")], "child string, parent string")
    assert ("d", "c", 3) in collect(graph.closure(e)) and ("a", "a", 3) in collect(graph.closure(e))
    assert [r[0] for r in collect(graph.on_cycles(e))] == ["a", "b", "c"]
    assert dict(collect(graph.levels(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string"), "a"))) == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)], "child string, parent string")
    assert dict(collect(graph.depths(chain)))["n0"] == 25 and ("n0", "n25", 25) in collect(graph.closure(chain)) and graph.closure(chain.limit(0)).count() == 0
    cut_short = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), (None, "c"), ("a", "b")], "child string, parent string")
    assert dict(collect(graph.depths(cut_short))) == {"a": 2, "b": 1, "c": 0, "d": 3, "x": 0, "y": 0, "z": 1}  # the longest way; links within a cycle do not count


def test_turtle_round_trip(spark, collect):
    from lodeweave.sources.readers import parse_turtle

    rows = [("http://x/a", graph.RDF + "type", "http://x/C", False), ("http://x/a", graph.RDFS + "label", 'say "hi"\n\\ there', True), ("http://x/b", "http://x/p", "http://x/a", False), ("http://x/b", "http://x/p", "http://x/a", False), ("http://x/c", "http://x/p", None, True)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_is_literal boolean")
    text = "\n".join(r[0] for r in graph.turtle(df).collect())
    assert "<http://x/a> a <http://x/C> ;" in text and sorted({tuple(r)[:3] for r in parse_turtle(text)}) == sorted({r[:3] for r in rows if r[2]})


def test_rdf_without_loss(spark, collect):
    from lodeweave.sources.readers import parse_rdfxml, parse_turtle, read_ntriples

    first, rest, nil = (graph.RDF + x for x in ("first", "rest", "nil"))
    ttl = """@base <http://e/x/> . # a comment
PREFIX : <http://e/>
:a :list ( :b "c" 4.5 ) ; :none () ; .
<y> :p <#z> , _:k , true , "a\\\\n\\tb"^^:t , 'x' .
[ :q [ :r 1 ] ] .
[] :s :a.b, -2e3 ."""
    got = parse_turtle(ttl.replace("'x'", '"""x "y" z"""@en'))
    assert [x for x in got if x[1] in (first, rest)] == [("_:b0", first, "http://e/b", False), ("_:b0", rest, "_:b1", False), ("_:b1", first, "c", True), ("_:b1", rest, "_:b2", False), ("_:b2", first, "4.5", True), ("_:b2", rest, nil, False)]
    assert ("http://e/a", "http://e/none", nil, False) in got and ("http://e/x/y", "http://e/p", "http://e/x/#z", False) in got and ("http://e/x/y", "http://e/p", "_:k", False) in got
    assert ("http://e/x/y", "http://e/p", "a\\n\tb", True) in got and ("http://e/x/y", "http://e/p", 'x "y" z', True) in got and ("http://e/x/y", "http://e/p", "true", True) in got
    assert ("_:b3", "http://e/q", "_:b4", False) in got and ("_:b4", "http://e/r", "1", True) in got and ("_:b5", "http://e/s", "http://e/a.b", False) in got and ("_:b5", "http://e/s", "-2e3", True) in got and len(got) == 17
    xml = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><rdf:Description rdf:about="http://e/a"><e:p><rdf:Description><e:q>x</e:q></rdf:Description></e:p>
    <e:r rdf:nodeID="n"/><e:l rdf:parseType="Collection"><e:C rdf:about="http://e/c"/></e:l></rdf:Description><rdf:Description rdf:nodeID="n" e:s="y"/></rdf:RDF>"""
    rows = parse_rdfxml(xml)
    assert ("_:x0", "http://e/q", "x", True) in rows and ("http://e/a", "http://e/p", "_:x0", False) in rows and ("http://e/a", "http://e/r", "_:n", False) in rows and ("_:n", "http://e/s", "y", True) in rows and ("_:x1", rest, nil, False) in rows
    lines = spark.createDataFrame([("_:b1 <http://e/p> _:b2 .",), ('<http://e/a> <http://e/p> "x\\\\n" . # c',), ("# nothing",), ("",), (None,), ("_:b2 <http://e/p> <http://e/z>.",)], "value string")
    assert collect(read_ntriples(lines)) == sorted([("_:b1", "http://e/p", "_:b2", False), ("http://e/a", "http://e/p", "x\\n", True), ("_:b2", "http://e/p", "http://e/z", False)], key=str)


def test_streams(spark, tmp_path):
    from lodeweave.streaming import stream

    path = str(tmp_path / "in")
    spark.createDataFrame([("p", "a", "b"), ("p", "a", "b"), ("p", "c", "d")], "predicate string, head string, tail string").write.parquet(path)
    got = {}
    s = stream.incremental_clusters(stream.documents(spark, path, "predicate string, head string, tail string"))
    q = s.writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({tuple(r)[:3]: r["support"] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got == {("p", "a", "b"): 2, ("p", "c", "d"): 1}


def test_greedy_equals_sequential(spark):
    rnd = random.Random(5)
    edges = [(0, f"p{rnd.randrange(8)}", f"g{rnd.randrange(8)}", float(rnd.randrange(5))) for _ in range(40)]
    edges = sorted({(d, p, g): (d, p, g, s) for d, p, g, s in edges}.values())
    used_p, used_g, want = set(), set(), set()
    for _, p, g, s in sorted(edges, key=lambda x: (-x[3], x[1], x[2])):
        if p not in used_p and g not in used_g:
            used_p.add(p)
            used_g.add(g)
            want.add((p, g))
    df = spark.createDataFrame(edges, "doc int, p string, g string, s double")
    got = matching.greedy(df, "p", "g", ["doc"], [-F.col("s")])
    assert {(r["p"], r["g"]) for r in got.collect()} == want


def test_entity_match(spark, collect):
    p = spark.createDataFrame([(1, "side guard open"), (1, ""), (1, None), (2, "x")], "doc_id int, label string")
    g = spark.createDataFrame([(1, "Side Guard Open"), (2, "yyy")], "doc_id int, label string")
    assert [(r["pred_label"], r["gold_label"], r["score"]) for r in matching.greedy_entities(p, g).collect()] == [("side guard open", "Side Guard Open", 100.0)]


SCENARIO = [
    ("t-1", "ent-1", "BearingFailure", "event", "rel-1", "causes", "ent-2", "Overheating", "event", "chunk-1", 0.91), ("t-2", "ent-4", "VibrationAnalysis", "process", "rel-2", "detects", "ent-5", "Misalignment", "symptom", "chunk-2", 0.87),
    ("t-3", "ent-6", "ShaftSeal", "component", "rel-3", "partOf", "ent-3", "MotorAssembly", "component", "chunk-1", 0.85), ("t-4", "ent-7", "TemperatureSensor", "component", "rel-2", "detects", "ent-2", "Overheating", "event", "chunk-3", 0.78),
    ("t-5", "ent-1", "BearingFailure", "event", "rel-1", "causes", "ent-5", "Misalignment", "symptom", "chunk-2", 0.65),
]
TRIPLE = "triple_id string, subject_id string, subject_label string, subject_type string, predicate_id string, predicate_label string, object_id string, object_label string, object_type string, chunk_id string, confidence double"


def test_scenario(spark):
    """The hand-built scenario's published figures: relations 0.6 / 0.75 / 0.667, predicates 1 / 0.75 / 0.857, one contradiction."""
    t = spark.createDataFrame(SCENARIO, TRIPLE).withColumn("doc_id", F.lit(1)).withColumn("ord", F.monotonically_increasing_id())
    gold = spark.createDataFrame([("BearingFailure", "causes", "Overheating"), ("VibrationAnalysis", "detects", "Misalignment"), ("ShaftSeal", "partOf", "MotorAssembly"), ("TemperatureSensor", "monitors", "MotorAssembly")], "head string, relation string, tail string")
    pred = t.select(F.col("subject_label").alias("head"), F.col("predicate_label").alias("relation"), F.col("object_label").alias("tail"))
    r = metrics.strict_sets(pred, gold, ["head", "relation", "tail"]).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.6, 0.75, 0.666667)
    r = metrics.predicate_only(pred, gold).first()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, 0.75, 0.857143)
    assert metrics.contradiction_pairs(t, ["doc_id"], "triple_id").count() == 1
    assert round(t.agg(F.avg("confidence")).first()[0], 3) == 0.812
    greedy = matching.greedy_triples(t.select("doc_id", F.col("triple_id").alias("id"), F.col("subject_label").alias("head"), F.col("predicate_label").alias("relation"), F.col("object_label").alias("tail")), gold.withColumn("id", F.col("head")).withColumn("doc_id", F.lit(1)))
    assert greedy.count() == 3
    ents = ["BearingFailure", "Overheating", "MotorAssembly", "VibrationAnalysis", "Misalignment", "ShaftSeal", "TemperatureSensor"]
    p = spark.createDataFrame([(1, x) for x in [*ents, "CoolingSystem"]], "doc_id int, label string")
    g = spark.createDataFrame([(1, x) for x in [*ents, "LubricationPump"]], "doc_id int, label string")
    assert matching.greedy_entities(p, g).count() == 7  # 0.875 of 8 and 8
    concepts = spark.createDataFrame([("FailureEvent",), ("MechanicalComponent",), ("Symptom",), ("DiagnosticProcess",), ("BearingDefect",)], "label string")
    links = spark.createDataFrame([("BearingDefect", "FailureEvent", 0), ("Symptom", "FailureEvent", 1)], "child string, parent string, ord int")
    h = metrics.hierarchy_scores(links, concepts).first()
    assert (h["avg_depth"], h["orphan_ratio"]) == (0.4, 0.6)


def test_layers(spark, collect):
    rec = spark.createDataFrame([(1, "c1", "7", "Guard open", ["switch open", "switch open"], ["stop"], [], ["operator"], None), (1, "c2", "8", "", ["x"], [], [], [], []), (2, "c3", None, "Lone", None, None, None, None, None)], "doc_id int, chunk_id string, record_no string, label string, cause_items array<string>, effect_items array<string>, intervention_items array<string>, responsible_items array<string>, reference_items array<string>")
    out = triples.records_to_triples(rec).orderBy("triple_id").collect()
    assert [(r["subject_label"], r["predicate_label"], r["object_label"], r["triple_id"]) for r in out] == [("switch open", "TRIGGERS", "Guard open", "triple_00000"), ("Guard open", "CAUSES", "stop", "triple_00001"), ("Guard open", "HANDLED_BY", "operator", "triple_00002")]
    items = extraction.record_items(rec.select("doc_id", "chunk_id", "label", *[f"{f}_items" for f in extraction.FIELDS]))
    assert items.where("chunk_id = 'c1'").count() == 5
    m = spark.createDataFrame([(1, "entity", "Valve", 0.5, 0, "e0"), (1, "entity", "valve!", None, 1, "e1"), (1, "entity", "  ", 1.0, 2, "e2"), (1, "relation", "drives", 1.0, 3, "e3")], "doc_id int, candidate_type string, label string, confidence double, ord int, expr_id string")
    got = {r["candidate_id"]: (r["canonical_label"], r["confidence"], r["expr_ids"]) for r in extraction.resolve_candidates(m).collect()}
    assert got == {"cand_e_00000": ("Valve", 0.5, ["e0", "e1"]), "cand_r_00000": ("drives", 1.0, ["e3"])}
    hints = spark.sql("SELECT array('semantic_role:alarm', 'a:1', 'a:2', 'http://x/y', 'PLC Alarm', 'Last', 'promote_to_ontology:false') AS h").select(ontology.parse_hints(F.col("h")).alias("m")).first()[0]
    assert hints == {"semantic_role": "alarm", "a": "2", "promote_to_ontology": "false", "class_uri": "http://x/y", "class_label": "Last"}
    sub = ontology.token_subset_hierarchy(spark.createDataFrame([("red valve",), ("valve",), ("pump",)], "label string"))
    assert collect(sub) == [("red valve", "valve")]


def test_record_assertions(spark):
    roles = spark.createDataFrame([(1, "c", "alarm", "e0", 0), (1, "c", "cause", "e1", 1), (1, "c", "effect", "e2", 2), (1, "d", "cause", "e1", 1)], "doc_id int, chunk_id string, role string, candidate_id string, ord int")
    cand = spark.createDataFrame([(1, "e0", "Alarm 5", "entity"), (1, "e1", "leak", "event"), (1, "e2", "stop", "event")], "doc_id int, candidate_id string, canonical_label string, candidate_type string")
    rel = spark.createDataFrame([("TRIGGERS", "r0"), ("CAUSES", "r1")], "relation_label string, relation_candidate_id string")
    out = {(r["source_candidate_label"], r["relation_label"], r["target_candidate_label"], r["assertion_id"]) for r in triples.record_assertions(roles, cand, rel).collect()}
    assert out == {("leak", "TRIGGERS", "Alarm 5", "rel_assert_00000"), ("Alarm 5", "CAUSES", "stop", "rel_assert_00001")}


def test_validation(spark):
    t = spark.createDataFrame([*SCENARIO, SCENARIO[0][:0] + ("t-6", *SCENARIO[0][1:]), ("t-7", "", "x", "event", "rel-1", "causes", "ent-2", "y", "event", "chunk-1", 0.1)], TRIPLE).withColumn("doc_id", F.lit(1))
    links = spark.createDataFrame([(1, "h0", "c1", "c1")], "doc_id int, link_id string, child_id string, parent_id string")
    ax = spark.createDataFrame([(1, "a0", "description", "", None), (1, "a1", "subclass", None, " ")], "doc_id int, axiom_id string, axiom_type string, literal_value string, object_label string")
    sch = spark.createDataFrame([(1, "s0", "relation_domain", "causes", "Component"), (1, "s1", "relation_range", "causes", "Symptom Event")], "doc_id int, schema_id string, schema_type string, subject_label string, object_label string")
    con = spark.createDataFrame([], "doc_id int, concept_id string, label string, normalized_label string, concept_kind string, parent_hint string, source_candidate_ids array<string>")
    got = [(r["issue_type"], r["related_id"], r["issue_id"]) for r in validation.issues(t, links, links.limit(0), ax, sch, con).orderBy("issue_id").collect()]
    kinds = [g[0] for g in got]
    assert ("duplicate_triple", "t-6") in [g[:2] for g in got] and ("missing_triple_component", "t-7") in [g[:2] for g in got] and "self_subclass" in kinds and "empty_description_axiom" in kinds and "empty_structural_axiom_target" in kinds and kinds.count("domain_mismatch") == 4
    assert [g[2] for g in got] == [f"issue_{i:05d}" for i in range(len(got))]
    assert validation.validity(validation.issues(t, links, links.limit(0), ax, sch, con), t).first()["is_valid"] is False


def test_consolidation(spark):
    r = spark.createDataFrame([(0, "Open guard", "cause", "stop", 0.5, 0), (1, "open guard", "CAUSES", "stop", None, 1), (1, "open guards", "causes", "stop", 0.9, 2), (2, "pump", "causes", "noise", 0.9, 3)], "stop int, head string, predicate string, tail string, confidence double, ord int")
    c = {x["ord"]: x for x in consolidation.exact_clusters(r).collect()}
    assert c[0]["support"] == 2 and c[0]["head"] in ("Open guard", "open guard") and len(c) == 3
    f = {x["ord"]: x["cluster"] for x in consolidation.fuzzy_clusters(r).collect()}
    assert f == {0: 0, 1: 0, 2: 0, 3: 3}


def test_rdf_round_trip(spark, tmp_path, collect):
    t = spark.createDataFrame([("t1", "n 1", 'a "q"\nb', "x", "p", "drives", "n2", "é", None, "c", 0.5, "j")], "triple_id string, subject_id string, subject_label string, subject_type string, predicate_id string, predicate_label string, object_id string, object_label string, object_type string, chunk_id string, confidence double, justification string")
    rdf = graph.kg_rdf(t)
    lines = graph.ntriples(rdf)
    assert collect(readers.read_ntriples(lines)) == collect(rdf)
    ttl = '@prefix ex: <http://e/> .\nex:a a ex:C ; ex:label "x \\"y\\"" , "z"@fr .\nex:b ex:p [ ex:q ex:r ] .\nex:b ex:n 5 .'
    assert readers.parse_turtle(ttl) == [("http://e/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/C", False), ("http://e/a", "http://e/label", 'x "y"', True), ("http://e/a", "http://e/label", "z", True), ("_:b0", "http://e/q", "http://e/r", False), ("http://e/b", "http://e/p", "_:b0", False), ("http://e/b", "http://e/n", "5", True)]
    run = writers.Run(spark, f"file://{tmp_path}/run")
    assert run.status() == "empty"
    did = run.run({"triples": lambda r: {"kg": t}, "serialization": lambda r: {"rdf": rdf}})
    assert did == ["triples", "serialization"] and run.status() == "completed" and run.run({"triples": lambda r: {"kg": t}}) == [] and run.load("triples", "kg").count() == 1
    assert writers.kg_json(t, False).first()[0].startswith('{"triple_id":"t1"')


def test_rules(spark, collect):
    df = spark.createDataFrame([(1, '("entity"<|>PUMP<|>part<|>d)##("relationship"<|>PUMP<|>VALVE<|>drives)##junk')], "doc_id int, text string")
    assert [(r["kind"], r["fields"]) for r in rules.parse_tuples(df).orderBy("pos").collect()] == [("entity", ["PUMP", "part", "d"]), ("relationship", ["PUMP", "VALVE", "drives"])]
    near = spark.createDataFrame([("the pump is hot and near the valve", ["pump"])], "t string, a array<string>").select(rules.near(F.col("t"), F.col("a"), ["hot"], 10), rules.near(F.col("t"), F.col("a"), ["valve"], 10)).first()
    assert tuple(near) == (True, False)
    rec = metrics.recover_json(spark.createDataFrame([('text ```json\n{"a": {"b": "}"}}\n``` more {',), (None,), ("none",)], "t string"), "t")
    assert [r["json"] for r in rec.collect()] == ['{"a": {"b": "}"}}', None, None]
    tree = readers.fault_tree(spark.createDataFrame([("{'top': [('a', 'b'), 'OR'], 'a': [(), 'BE']}",), ("bad",)], "text string"))
    assert collect(tree) == sorted([("top", "OR", "a", 0), ("top", "OR", "b", 1), ("a", "BE", None, None)], key=str)
    x = rules.apply_rules(spark.createDataFrame([("a",), ("b",), (None,)], "relation string"), [(F.col("relation") == "a", "A", "renamed"), (F.col("relation") == "b", None, "rejected")])
    assert collect(x.select("mapped", "reason")) == sorted([("A", "renamed"), (None, "rejected"), (None, "kept")], key=str)
