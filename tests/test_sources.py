import json

import pytest

from threadloom import cli
from threadloom.sources import corpus, sinks

GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="edge" attr.name="weight" attr.type="double"/><key id="d1" for="node" attr.name="entity_type" attr.type="string"/><key id="d2" for="edge" attr.name="keywords" attr.type="string"/>
<graph edgedefault="undirected"><node id="B"><data key="d1">tag</data></node><node id="A"/><edge source="B" target="A"><data key="d0">0.8</data><data key="d2">x, y</data></edge><edge source="A" target="C"/></graph></graphml>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "topics").mkdir()
    one = {"id": 1, "title": "One", "tags": ["a", {"id": 5, "name": "B", "slug": "b"}, None], "posts": [{"id": 10, "post_number": 1, "username": "u", "cooked": "<p>x &amp; y</p>"}, None], "closed": None, "extra": 1}
    (tmp_path / "topics" / "1.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "topics" / "2.json").write_text('{"id": 2, "title": "cut')
    (tmp_path / "topics" / "3.json").write_text(json.dumps({"id": 3, "tags": None, "posts": None}))
    return tmp_path


def test_documents(spark, folder):
    docs = corpus.documents(spark, str(folder)).cache()
    assert sorted(r.id for r in docs.collect()) == [1, 3]
    tags = docs.where("id = 1").first().tags
    assert tags[0] == "a" and json.loads(tags[1])["slug"] == "b" and tags[2] is None
    assert [(r.topic_id, r.id, r.plain_text) for r in corpus.posts(docs).collect()] == [(1, 10, "x & y")]
    assert corpus.index(docs).count() == 2 and "posts" not in corpus.topics(docs).columns
    corpus.write_topics(docs, str(folder / "out"))
    assert spark.read.parquet(str(folder / "out")).count() == 2


def test_missing(spark, tmp_path, folder):
    assert corpus.categories(spark, str(folder)).count() == 0
    (folder / "categories.json").write_text(json.dumps({"categories": [{"id": 1, "name": "n", "subcategory_ids": [2]}]}))
    assert corpus.categories(spark, str(folder)).first().subcategory_ids == [2]
    with pytest.raises(corpus.NoCorpus):
        corpus.documents(spark, str(folder / "topics"))


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = corpus.graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted((r.name, r.entity_type) for r in nodes.collect()) == [("A", "UNKNOWN"), ("B", "tag")]
    assert sorted((r.a, r.b, r.weight, r.keywords) for r in edges.collect()) == [("A", "B", 0.8, "x, y"), ("A", "C", 1.0, None)]


def test_key_values(spark, tmp_path):
    (tmp_path / "chunks.json").write_text(json.dumps({"c1": {"full_doc_id": "topic-7"}, "c2": {"full_doc_id": "doc-x"}, "c3": {"full_doc_id": "doc-y"}}))
    (tmp_path / "docs.json").write_text(json.dumps({"doc-x": {"file_path": "topic-9.json"}}))
    got = corpus.chunk_topics(corpus.key_values(spark, str(tmp_path / "chunks.json"), "full_doc_id: string"), corpus.key_values(spark, str(tmp_path / "docs.json"), "file_path: string"))
    assert {r.chunk_id: r.topic_id for r in got.collect()} == {"c1": 7, "c2": 9, "c3": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 70), (2, None)], "n int, text string").orderBy("n")
    table = sinks.text_table(df)
    assert table.endswith("(2 rows)") and "x" * 57 + "..." in table and "x" * 58 not in table
    assert sinks.text_table(df.where("false")) == "(no results)"
    assert json.loads(sinks.json_rows(df))[1] == {"n": 2, "text": None}
    path = str(tmp_path / "f")
    assert [sinks.write_if_changed(path, t) for t in ("a", "a", "b")] == [True, False, True]
    nodes, edges = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a", "b")], "a string, b string")
    assert json.loads(sinks.graph_payload(nodes, edges))["nodes"] == [{"name": "a"}]
    with pytest.raises(ValueError):
        sinks.graph_payload(nodes, edges, 0)


def test_command_line(spark, data, capsys):
    assert cli.main(["--data", data, "stats", "tags", "--limit", "3"]) == 0
    assert "(3 rows)" in capsys.readouterr().out
    assert cli.main(["--data", data, "sql", "SELECT count(*) AS n FROM topics", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["n"] > 0
    assert cli.main(["--data", data, "sql", "SELECT nothing FROM nowhere"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["bogus"])
    assert e.value.code == 2
