from lodeweave.operators import extraction, retrieval


def test_labels_of_any_length(spark, collect):
    docs = spark.createDataFrame([(1, "The valve operates at temperature; it shares power supply with M4."), (2, "An o-ring, and the operator's panel: it operates at night.")], "doc_id int, text string")
    tax = spark.createDataFrame([("operates at temperature",), ("Shares power supply with",), ("o-ring",), ("operator's panel",), ("valve",)], "label string")
    want = [(1, "Shares power supply with"), (1, "operates at temperature"), (1, "valve"), (2, "o-ring"), (2, "operator's panel")]
    assert sorted(collect(retrieval.taxonomy_hits(docs, tax))) == want
    chunks = docs.selectExpr("doc_id", "'c' AS chunk_id", "text AS chunk", "0 AS start_char")
    got = extraction.lexicon_expressions(chunks, tax.selectExpr("label AS term", "'x' AS label"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((d, t.lower()) for d, t in want)
    assert min(r["doc_start_char"] for r in got.collect()) > 0


def test_query_within_words(spark, collect):
    items = spark.createDataFrame([("concept", "blown Fuses", 1), ("relation", "gearbox drives", 2), ("triple", "a b", 3)], "kind string, text string, ord int")
    q = spark.createDataFrame([("fuse",), ("box DRIVE",), ("ox",), ("b",), ("nothing",)], "query string")
    got = sorted((r["query"], r["ord"]) for r in retrieval.artifact_space(q, items).collect())
    assert got == [("b", 1), ("b", 2), ("b", 3), ("box DRIVE", 2), ("fuse", 1), ("ox", 2)]
