import json

import numpy as np
import pytest

from threadloom.operators import cluster
from threadloom.operators import graph as G
from threadloom.operators.views import Corpus
from threadloom.sources import guide


def test_balance_keeps_the_number_of_buckets(spark):
    rng = np.random.default_rng(0)
    centres = np.concatenate([rng.normal(0, 0.2, (9, 4)), rng.normal(4, 0.1, (1, 4)), rng.normal(-4, 0.1, (1, 4))])
    votes = spark.createDataFrame([(f"a{i}", f"b{i}", int(i % 9), 1) for i in range(300)] + [("x", "y", 9, 1), ("x", "z", 10, 2)], "a string, b string, centroid int, votes long")
    before = np.array([0] * 9 + [1, 2])
    after = cluster.balanced(votes, before, centres)
    assert len(np.unique(after)) == 3
    old, new = cluster.bucket_sizes(votes, before), cluster.bucket_sizes(votes, after)
    assert old.sum() == new.sum() == 302 and new.max() < old.max()
    assert list(cluster.balanced(votes.where("false"), before, centres)) == list(before)


def test_ties_go_to_the_first_bucket(spark):
    votes = spark.createDataFrame([("a", "b", 0, 1), ("a", "b", 1, 1), ("c", "d", 1, 2), ("c", "d", 0, 1)], "a string, b string, centroid int, votes long")
    assert list(cluster.bucket_sizes(votes, np.array([0, 1]))) == [1, 1]


def test_every_keyword_has_a_bucket(spark):
    e = spark.createDataFrame([("a", f"n{i}", 1.0, f"word{i % 7} thing, posted") for i in range(40)], "a string, b string, weight double, keywords string")
    counts = G.keyword_counts(e)
    got = {r.keyword: r.bucket for r in cluster.keyword_buckets(e, counts, 3, 5).collect()}
    assert set(got) == {f"word{i} thing" for i in range(7)} and len(set(got.values())) <= 3


def test_vocabulary(tmp_path):
    path = str(tmp_path / "types.json")
    assert guide.write_vocabulary(path, ["Bug", "bug", " ", "Topic", "Guide"]) and not guide.write_vocabulary(path, ["Bug", "Guide"])
    found = guide.load_vocabulary(path)
    assert guide.content_types(found) == ["Bug", "Guide"] and sum(found.values()) == 4
    (tmp_path / "bad.json").write_text(json.dumps({"types": [{"name": "Topic", "structural": False}]}))
    for name in ("bad.json", "none.json"):
        with pytest.raises(guide.BadVocabulary):
            guide.load_vocabulary(str(tmp_path / name))


def test_guide(spark, data):
    verbs = spark.createDataFrame([("pin", "a|b", 3)], "kind string, phrase string, n long")
    text = guide.corpus_guide(Corpus(spark, data), verbs)
    assert "| pin | a\\|b | 3 |" in text and "## Topics by category" in text
