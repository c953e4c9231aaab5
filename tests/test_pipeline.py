"""Configuration, sinks, command line and the index from end to end."""

import json

import pytest

from threadloom import cli, config
from threadloom.functions.register import register
from threadloom.operators import panels as P
from threadloom.operators import pipeline, synth
from threadloom.operators.views import Corpus
from threadloom.sources import sinks


def test_layers(tmp_path):
    root, data = tmp_path / "root", tmp_path / "data"
    root.mkdir(), data.mkdir()
    (root / ".env").write_text(f"# x\nexport LIMIT=5\nQUERY_MODE='local'\nDATA_DIR={data}\nno sign\n")
    (data / ".env").write_text('LIMIT="7"\n')
    found = config.layered(str(root), None, {"QUERY_MODE": None, "BUCKETS": 3})
    assert (found["LIMIT"], found["QUERY_MODE"], found["BUCKETS"], found["DATA_DIR"]) == ("7", "local", "3", str(data))
    assert config.layered()["LIMIT"] == "30"


def test_reports_caches_and_locks(tmp_path):
    p = tmp_path / "r.md"
    assert sinks.write_report(str(p), "one") == p
    assert sinks.write_report(str(p), "two", "alongside", "t1").name == "r-t1.md" and p.read_text() == "one"
    sinks.write_report(str(p), "three", "backup", "t2")
    assert p.read_text() == "three" and (tmp_path / "r-t2.bak.md").read_text() == "one"
    with pytest.raises(FileExistsError):
        sinks.write_report(str(p), "four", "fail")
    calls = []
    get = lambda sig: sinks.cached(str(tmp_path / "c.json"), sig, lambda: calls.append(sig) or {"x": sig})
    assert get("a") == get("a") == {"x": "a"} and get("b") == {"x": "b"} and calls == ["a", "b"]
    (tmp_path / "c.json").write_text("broken")
    assert get("b") == {"x": "b"} and len(calls) == 3
    with sinks.exclusive(str(tmp_path)), pytest.raises(sinks.Busy), sinks.exclusive(str(tmp_path)):
        pass
    with sinks.exclusive(str(tmp_path)):
        pass
    assert "- rows: 3" in sinks.log_run(str(tmp_path / "logs"), "INDEX", {"rows": 3}, "t").read_text()


def test_retries_gate_progress():
    waits, tries = [], []
    with pytest.raises(KeyError):
        pipeline.retried(lambda: tries.append(1) or {}["x"], sleep=waits.append)
    assert waits == [1.0, 2.0] and len(tries) == 3
    gate = pipeline.FlushGate(3)
    assert [gate() for _ in range(6)] == [False, False, True] * 2
    gate.suppressed = True
    assert not any(gate() for _ in range(6))
    assert pipeline.progress(2, 4, 0.0, 10.0) == "2/4 50% 10s left"


def test_index_modes_and_verification(spark, data, tmp_path):
    c, state, said = Corpus(spark, data), f"file://{tmp_path}/state", []
    rows = {r.entity_type: r for r in pipeline.index(c, state, limit=9, say=said.append).collect()}
    assert rows["topic"].in_graph == rows["topic"].in_source and len(said) == 4
    every = {r.entity_type: r for r in pipeline.index(c, state, clear=True, say=said.append).collect()}
    assert every["topic"].in_source > rows["topic"].in_source and every["topic"].missing == 0
    again = {r.entity_type: r for r in pipeline.index(c, state, enrich_only=True, say=said.append).collect()}
    assert again == every


def test_sql_shows_all_rows_and_functions(spark, data, capsys):
    Corpus(spark, data).register()
    assert "html_text" in register(spark) and spark.sql("SELECT truncated('abcdef', 3), tag_folded('a.b'), html_text('<p>x</p>')").first()[:] == ("abc...", "a-b", "x")
    assert cli.main(["--data", data, "sql", "SELECT explode(sequence(1, 31)) AS n"]) == 0
    assert "(31 rows)" in capsys.readouterr().out


def test_command_line(spark, data, tmp_path, capsys):
    out = tmp_path / "g.json"
    assert cli.main(["--data", data, "viz", "--out", str(out), "--min-degree", "3"]) == 0 and json.loads(out.read_text())["nodes"]
    assert cli.main(["--data", data, "visualize", "--out", str(out), "--min-degree", "3"]) == 0 and "unchanged" in capsys.readouterr().out
    assert cli.main(["--data", data, "discover-types", "--sample-size", "20", "--out", str(tmp_path / "v.json")]) == 0
    assert cli.main(["--data", data, "query"]) == 2
    capsys.readouterr()
    assert cli.main(["--data", data, "query", "why does the signal box jam", "--mode", "hybrid", "--limit", "5", "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 5


def test_templates_samples_and_extension(spark):
    with pytest.raises(ValueError):
        P.filled("{nope}", {})
    with pytest.raises(ValueError):
        P.filled("{a}" * 17, {"a": None})
    df = spark.range(100)
    one, two = ([r.id for r in P.sampled(df, "id", 10).collect()] for _ in range(2))
    assert one == two and len(set(one)) == 10 and P.sampled(df, "id", 1000).count() == 100
    t, p = synth.extension(spark, "small", new=12)
    old = synth.topics(spark, "small")
    assert t.count() == 12 and t.join(old, "topic_id").isEmpty() and t.agg({"created_at": "min"}).first()[0] > old.agg({"created_at": "max"}).first()[0].replace(hour=0)
    assert p.count() == 24 and p.groupBy("topic_id", "post_number").count().where("count > 1").isEmpty()
