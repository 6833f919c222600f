import __spark_entry__ as e


def test_contract():
    q, o = e.queries(), e.oracle_sql()
    assert q and set(o) <= set(q) and all(callable(f) for f in q.values())


def test_entry_plans(spark):
    assert e.entry(spark).columns == ["doc_id", "triple_id", "subject_label", "predicate_label", "object_label", "chunk_id"]
