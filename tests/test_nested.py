import datetime
import json

from pyspark.sql import functions as F

from threadloom.operators import nested
from threadloom.plans import training

SCHEMA = "record_id long, file_path string, fetched_at timestamp_ntz, body string"
DAY = [datetime.datetime(2026, 1, d) for d in range(1, 9)]


def found(spark, rows, schema=SCHEMA):
    df = nested.element_paths(nested.record_triples(spark.createDataFrame(rows, schema)))
    return {(r.topic_id, r.parent_path, r.child_path) for r in df.collect()}


def test_paths_with_odd_shapes(spark):
    body = {
        "id": 7,
        "tags": json.dumps(["a", None, {"slug": "b"}]),
        "post_stream": {"posts": [None, {"id": 1, "link_counts": {"url": "u"}, "polls": [{"options": [None, {"id": "x"}]}, None]}], "stream_size": 2},
    }
    got = found(spark, [(1, "topics/7.json", DAY[0], json.dumps({"topic": body}))])
    assert got == {
        (7, "topic", "tags/0"), (7, "topic", "tags/1"), (7, "topic", "tags/2"), (7, "topic", "posts/1"), (7, "posts/1", "posts/1/link_counts/0"),
        (7, "posts/1", "posts/1/polls/0"), (7, "posts/1/polls/0", "posts/1/polls/0/options/1"),
    }


def test_latest_object_counts(spark):
    one, two = json.dumps({"tags": ["x"]}), json.dumps({"tags": ["x", "y"]})
    rows = [(1, "topics/1.json", DAY[1], two), (2, "topics/1.json", DAY[2], two[:-3]), (3, "topics/1.json", DAY[3], "[1]"), (4, "topics/1.json", DAY[0], one), (5, "topics/1.json", DAY[4], None), (6, None, DAY[0], one), (7, "x.json", DAY[0], one), (8, "topics/2.json", None, one), (9, "topics/2.json", DAY[0], '{"tags": NaN}')]
    assert found(spark, rows) == {(1, "topic", "tags/0"), (1, "topic", "tags/1"), (2, "topic", "tags/0")}


def test_lone_post_and_text(spark):
    rows = [(1, "topics/1.json", DAY[0], json.dumps({"posts": {"id": 1}, "tags": "not json"})), (2, "topics/2.json", DAY[0], json.dumps({"posts": json.dumps({"id": 1}), "tags": ""}))]
    assert found(spark, rows) == {(1, "topic", "posts/0"), (2, "topic", "posts/0")}


def test_empty_and_clashing(spark):
    assert found(spark, []) == set()
    rows = [(1, "topics/1.json", DAY[0], json.dumps({"tags": [1]}), "x", "y")]
    assert found(spark, rows, SCHEMA + ", Body string, topic_id string") == {(1, "topic", "tags/0")}


def test_tables_keep_fields(spark):
    body = json.dumps({"id": 3, "title": "T", "odd": {"a": [1.50]}, "posts": [{"id": 5, "plain_text": None, "reads": "7"}]})
    df = spark.createDataFrame([(1, "topics/3.json", DAY[0], body)], SCHEMA)
    topic = nested.flat_table(df, "topic").first()
    assert (topic.id, topic.title, topic.rest) == (3, "T", {"odd": '{"a": [1.5]}'})
    post = nested.flat_table(df, "posts").first()
    assert (post.parent_path, post.ordinal, post.id, post.reads, post.plain_text) == ("topic", 0, 5, 7, None)


def test_very_long_and_deep(spark):
    many = json.dumps({"tags": ["t"] * 30_000})
    deep = '{"tags": ' + "[" * 5000 + "]" * 5000 + "}"
    assert len(found(spark, [(1, "1.json", DAY[0], many), (2, "2.json", DAY[0], deep)])) >= 30_000


def test_groups_come_from_the_data(spark):
    body = {"id": 1, "tags": "plain-tag", "posts": [{"id": 5, "reactions": [None, {"user": "a"}, 3], "meta": {"n": 2, "seen": [{"by": "b"}]}, "marks": [1, 2]}], "grid": [[1, {"z": 2}], 7]}
    df = spark.createDataFrame([(1, "1.json", DAY[0], json.dumps(body))], SCHEMA)
    every = nested.record_triples(df)
    assert nested.groups(every) == ["grid", "grid/[]", "posts/meta/seen", "posts/reactions"]
    got = {(r.kind, r.parent_path, r.path, r.ordinal): r.rest for r in nested.others(every).collect()}
    assert got == {
        ("posts/reactions", "posts/0", "posts/0/reactions/1", 1): {"user": "a"}, ("posts/reactions", "posts/0", "posts/0/reactions/2", 2): {"value": "3"},
        ("posts/meta/seen", "posts/0", "posts/0/meta/seen/0", 0): {"by": "b"},
        ("grid", "topic", "grid/0", 0): {}, ("grid", "topic", "grid/1", 1): {"value": "7"}, ("grid/[]", "grid/0", "grid/0/0", 0): {"value": "1"}, ("grid/[]", "grid/0", "grid/0/1", 1): {"z": "2"},
    }
    assert nested.flat_table(df, "posts").first().rest == {"meta": '{"n": 2}', "marks": "[1, 2]"}
    assert nested.flat_table(df, "topic").first().rest == {"tags": "plain-tag"}
    assert found(spark, [(1, "1.json", DAY[0], json.dumps(body))]) == {(1, "topic", "posts/0")}


def test_lone_object_of_a_group_that_others_show(spark):
    rows = [(1, "1.json", DAY[0], json.dumps({"posts": [{"reactions": [{"u": 1}]}]})), (2, "2.json", DAY[0], json.dumps({"posts": [{"reactions": {"u": 2}}]}))]
    df = nested.flat_table(spark.createDataFrame(rows, SCHEMA), "posts/reactions")
    assert {(r.topic_id, r.path, r.rest["u"]) for r in df.collect()} == {(1, "posts/0/reactions/0", "1"), (2, "posts/0/reactions/0", "2")}


def test_reader_takes_what_json_is():
    for text in ('{"a": 1,}', '{"a" 1}', "{'a': 1}", '{"a": 01}', '{"a": NaN}', '{"a": "\n"}', '{"a": [1 2]}', '{"a": 1} x', "", "[]", '"{}"', '{"a": tru}', "{"):
        assert nested.triples(text) is None, text
    for text in ("{}", ' {"a" : [ ] , "b":{ } }\n', '{"a": "\\u00e9\\"", "b": -0.5e3, "c": [[], [null]]}'):
        fields = {t[4]: t[5] for t in nested.triples(text) if t[4]}
        want = json.loads(text)
        assert fields == {k: v if isinstance(v, str) else json.dumps(v) for k, v in want.items()}


def test_names_twice_and_wrapped():
    last = [t for t in nested.triples('{"posts": [{"id": 1}, {"id": 2}], "posts": [{"id": 3}], "a": 1, "a": 2}') if t[2] != "topic" or t[4]]
    assert [t[2:] for t in last] == [("posts/0", 0, None, None), ("posts/0", 0, "id", "3"), ("topic", 0, "a", "2")]
    first = nested.triples('{"topic": {"id": null, "tags": null}, "id": 4, "tags": ["x"], "post_stream": {"tags": ["y", "z"], "id": 9}}')
    assert [t[2:] for t in first if t[5] is not None] == [("topic", 0, "id", "4"), ("tags/0", 0, "value", "x")]


def test_deep_nesting_of_objects():
    """Valid JSON nested beyond any stack is a record like others."""
    deep = '{"a": ' * 20_000 + "1" + "}" * 20_000
    assert [t[4] for t in nested.triples('{"id": 7, "odd": ' + deep + "}")] == [None, "id", "odd"]
    assert nested.triples('{"tags": ' + "[" * 3000 + '{"slug": 1}' + "]" * 3000 + "}")[-1][4:] == ("slug", "1")


def written(monkeypatch):
    """What the reader writes, as it is written."""
    kept, write = [], nested.materialize
    monkeypatch.setattr(nested, "materialize", lambda df, tag: kept.append(write(df, tag)) or kept[-1])
    return kept


def test_links_come_from_triples_with_values(spark, monkeypatch, tmp_path):
    """p4_found's own triples hold values, a row each, and its rows are those of the pivoted tables."""
    body = {"id": 7, "tags": ["a", None], "posts": [{"id": 5, "link_counts": [{"url": "u"}], "polls": {"name": "p", "options": [{"label": "x"}]}}]}
    spark.createDataFrame([(1, "7.json", DAY[0], json.dumps(body))], SCHEMA).write.parquet(f"{tmp_path}/topic_files.parquet")
    kept = written(monkeypatch)
    links = training.QUERIES["p4_found"](spark, str(tmp_path)).collect()
    assert {(r.path, r.ordinal, r.field, r.value) for r in kept[0].where("field IS NOT NULL").collect()} == {
        ("topic", 0, "id", "7"), ("tags/0", 0, "value", "a"), ("posts/0", 0, "id", "5"), ("posts/0/link_counts/0", 0, "url", "u"), ("posts/0/polls/0", 0, "name", "p"), ("posts/0/polls/0/options/0", 0, "label", "x"),
    }
    tables = [training.QUERIES[f"p4_{t}"](spark, str(tmp_path)).select("topic_id", "parent_path", "path").collect() for t in ("posts", "tags", "links", "polls", "options")]
    assert sorted(map(tuple, links)) == sorted(tuple(r) for t in tables for r in t)


def test_reader_hands_on_while_it_reads():
    """Of a long record no more than some HELD triples are held; those of a name that comes again, handed on or not, are void."""
    text = '{"posts": [' + ", ".join('{"id": %d, "id": %d, "polls": [{"name": "p"}]}' % (i, -i) for i in range(5000)) + '], "a": {"b": [{"c": 1}, {"c": 2}]}, "tags": ["x"], "a": 3}'
    for held in (1, 7, 1000, nested.HELD):
        reading, rows, longest = nested.stream(text, held=held), {}, 0
        while True:
            try:
                start, some = next(reading)
            except StopIteration as e:
                voids = e.value
                break
            longest = max(longest, len(some))
            rows |= {start + i: t for i, t in enumerate(some) if t is not None}
        assert longest <= held + 4
        assert [t for i, t in sorted(rows.items()) if not any(a <= i < b for a, b in voids)] == nested.triples(text)
        assert voids or held > 7
    assert [t[2:] for t in nested.triples(text)[-3:]] == [("tags/0", 0, None, None), ("tags/0", 0, "value", "x"), ("topic", 0, "a", "3")]


def test_triples_handed_on_of_void_records(spark, monkeypatch):
    """A record cut off after triples were handed on counts for nothing, a name that comes again for its last value."""
    many = json.dumps(["t"] * nested.HELD)
    rows = [(1, "1.json", DAY[0], '{"tags": ["x"]}'), (2, "1.json", DAY[1], f'{{"tags": {many}'), (3, "2.json", DAY[0], f'{{"tags": {many}, "posts": [{{"id": 1}}], "tags": ["z"], "title": "half \\ud83d"}}')]
    kept = written(monkeypatch)
    every = nested.record_triples(spark.createDataFrame(rows, SCHEMA))
    assert {r.record_id: (r.n > nested.HELD, r.voids) for r in kept[0].groupBy("record_id").agg(F.count("kind").alias("n"), F.count("voids").alias("voids")).collect()} == {1: (False, 0), 2: (True, 0), 3: (True, 1)}
    assert {(r.topic_id, r.value) for r in nested.pivot(every, "tags", nested.TABLES["tags"]).collect()} == {(1, "x"), (2, "z")}
    assert sorted(r.child_path for r in nested.element_paths(every).collect()) == ["posts/0", "tags/0", "tags/0"]
    assert nested.pivot(every, "topic", {"title": "string"}).where("topic_id = 2").first().title == "half \ufffd"


def test_group_in_one_record_is_one_in_all(spark):
    """Lone objects, scalars and arrays in arrays of a group that only another record shows."""
    bodies = [{"posts": [{"marks": [{"u": 1}], "grid": [[{"z": 1}]]}]}, {"posts": [{"marks": {"u": 2}, "grid": [[5], 6]}]}, {"posts": [{"marks": ["m"]}]}]
    every = nested.record_triples(spark.createDataFrame([(i, f"{i}.json", DAY[0], json.dumps(b)) for i, b in enumerate(bodies, 1)], SCHEMA))
    assert {(r.topic_id, r.path): r.rest for r in nested.others(every).collect()} == {
        (1, "posts/0/marks/0"): {"u": "1"}, (1, "posts/0/grid/0"): {}, (1, "posts/0/grid/0/0"): {"z": "1"},
        (2, "posts/0/marks/0"): {"u": "2"}, (2, "posts/0/grid/0"): {}, (2, "posts/0/grid/0/0"): {"value": "5"}, (2, "posts/0/grid/1"): {"value": "6"},
        (3, "posts/0/marks/0"): {"value": "m"},
    }
    assert [r.rest for r in nested.pivot(every, "posts", {}).collect()] == [{}, {}, {}]
