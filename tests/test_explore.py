from threadloom.operators import explore as X


def test_windows_of_time(spark):
    t = spark.createDataFrame([("a", "b", 5, 9), ("a", "c", 1, 2), ("b", "c", None, None)], "a string, b string, first int, last int")
    pairs = lambda *w: sorted((r.a, r.b) for r in X.within(t, *w).collect())
    assert pairs(3, 6) == [("a", "b"), ("b", "c")] and pairs(None, 2) == [("a", "c"), ("b", "c")] and len(pairs(None, None)) == 3


def test_paths_chunks_and_mentions(spark):
    p = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"])], "path_no int, nodes array<string>")
    assert {r.name: r.path_no for r in X.highlighted(p).collect()} == {"a": 0, "b": 0, "c": 1}
    c = spark.createDataFrame([(7, 0), (7, 2)], "topic_id long, chunk_no int")
    assert [r.source_id for r in X.chunk_names(c).orderBy("chunk_no").collect()] == ["topic-7", "topic-7-p2"]
    m = spark.createDataFrame([("k", "x, y,x"), ("l", None), ("m", "")], "key string, v string")
    assert sorted(map(tuple, X.first_mentions(m, "key", "v", ",").collect())) == [("k", "x", 0), ("k", "y", 1)]


def test_contexts_and_tables(spark):
    n = spark.createDataFrame([("cat", "tag", "d"), ("dog", "tag", None), ("cats", "user", None), ("alone", "tag", "x" * 300)], "name string, entity_type string, description string")
    e = spark.createDataFrame([("cat", "dog", 2.0, "one, two"), ("cat", "cats", 1.0, "")], "a string, b string, weight double, keywords string")
    assert {(r.name, r.role) for r in X.search_context(n, e, "CAT", ("tag",)).collect()} == {("cat", "match"), ("dog", "context")}
    assert [(r.name, r.phrase) for r in X.connections(n, e, "cat").collect()] == [("dog", "one"), ("cats", "")]
    rows = X.node_table(n, e).collect()
    assert [r.name for r in rows] == ["cat", "cats", "dog", "alone"] and len(rows[-1].description) == 243
    assert X.node_table(n.where("false"), e).count() == 0
