"""Graph operators against brute force on small graphs."""

import random

import pytest

from threadloom.operators import graph, kg, retrieve
from threadloom.operators.views import newest


def edges_of(spark, pairs):
    rows = sorted({(min(a, b), max(a, b)) for a, b in pairs if a != b})
    return spark.createDataFrame([(a, b, 1.0, "k") for a, b in rows], "a string, b string, weight double, keywords string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n, "tag") for n in names], "name string, entity_type string")


def component_sets(pairs, gone=None):
    links = {}
    for a, b in pairs:
        if gone not in (a, b):
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    seen, out = set(), []
    for x in links:
        if x not in seen:
            todo, got = [x], set()
            while todo:
                y = todo.pop()
                if y not in got:
                    got.add(y)
                    todo += links[y]
            seen |= got
            out.append(got)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_and_articulation(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(22)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(24)}
    e = edges_of(spark, pairs)
    got = {r.name: r.component for r in graph.components(e, nodes_of(spark, names)).collect()}
    want = {x: min(c) for c in component_sets(pairs) for x in c}
    assert got == {n: want.get(n, n) for n in names}
    cut = set()
    for n in want:
        before = next(c for c in component_sets(pairs) if n in c) - {n}
        after = [c for c in component_sets(pairs, n) if c & before]
        if len(after) + len(before - set().union(*after, set())) > 1:
            cut.add(n)
    assert {r.name for r in graph.articulation_points(e).collect()} == cut


def test_cut_nodes_of_a_long_chain(spark):
    """Rounds grow with the logarithm: a chain of 300 nodes and a ring at its end."""
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(300)] + [("c300", "r1"), ("r1", "r2"), ("r2", "c300")]
    got = {r.name for r in graph.articulation_points(edges_of(spark, chain)).collect()}
    assert got == {f"c{i:03d}" for i in range(1, 301)}


def test_levels_paths_and_rank(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("d", "f")]
    e = edges_of(spark, pairs)
    assert {r.name: r.hops for r in graph.levels(e, "a", 2).collect()} == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 2}
    assert graph.shortest_paths(e, "a", "d") == [["a", "e", "d"], ["a", "b", "c", "d"]]
    assert graph.shortest_paths(e, "a", "zz") == [] and graph.levels(e, "zz", 2).count() == 0
    chain = edges_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(9)])
    assert graph.shortest_paths(chain, "n0", "n9") == [[f"n{i}" for i in range(10)]]  # however far
    assert {r.name: r.hops for r in graph.levels(chain, "n0").collect()}["n9"] == 9
    score = {r.name: r.score for r in graph.pagerank(e, "a", 6).collect()}
    links = {}
    for a, b in pairs:
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)
    p = {"a": 1.0}
    for _ in range(6):
        new = {"a": 0.15}
        for x, v in p.items():
            for y in links[x]:
                new[y] = new.get(y, 0) + 0.85 * v / len(links[x])
        p = new
    assert score == pytest.approx(p, abs=1e-7)


def test_communities(spark):
    two = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(4) for j in range(i)] + [("a0", "b0")]
    e = edges_of(spark, two)
    got = graph.communities(nodes_of(spark, ["alone"]).unionByName(nodes_of(spark, [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(4)])), e)
    by = {r.name: r.community for r in got.collect()}
    assert by["a1"] == by["a4"] == 1 and by["b1"] == by["b3"] == 2 and by["alone"] == 3
    assert graph.modularity(got.where("name <> 'alone'"), e) > 0.3


def test_empty_graph(spark):
    e, n = edges_of(spark, []), nodes_of(spark, [])
    assert graph.components(e).count() == graph.articulation_points(e).count() == graph.communities(n, e).count() == graph.degrees(n, e).count() == 0
    assert graph.weight_bounds(e).first().most == 1.0


def test_token_buckets_and_votes(spark):
    counts = spark.createDataFrame([("issue report", 5), ("reporting", 2), ("bridge check", 4), ("posted", 9), ("zzz", 1)], "keyword string, n long")
    got = {r.keyword: r.bucket_name for r in graph.token_buckets(counts, 2).collect()}
    assert got == {"issue report": "Issue", "reporting": "Report"}
    e = spark.createDataFrame([("a", "b", 1.0, "posted, tagged, tag"), ("a", "c", 1.0, "nothing"), ("b", "c", 1.0, "")], "a string, b string, weight double, keywords string")
    none = spark.createDataFrame([], "keyword string, bucket int, bucket_name string, n long")
    assert {(r.a, r.b): r.bucket for r in graph.classified_edges(e, none).collect()} == {("a", "b"): 1, ("a", "c"): -1, ("b", "c"): -1}


def test_canonical_names(spark):
    nodes = spark.createDataFrame([("2025-06", "tag"), ("2025․06", "tag"), ("Bug Yard", "category"), ("bug yard", "other"), ("help", "tag"), ("Help", "category"), ("ACME9", "other"), ("acme9", "other"), ("jdoe", "user"), ("User Jdoe", "other"), ("J Doe Person", "other"), ("UserStory", "other"), ("foo.bar", "other"), ("foo-bar", "other")], "name string, entity_type string")
    seeds = nodes.where("entity_type in ('tag', 'category', 'user')")
    assert {(r.old, r.canonical) for r in kg.case_map(nodes, seeds).collect()} == {("2025․06", "2025-06"), ("bug yard", "Bug Yard"), ("ACME9", "acme9")}
    assert {(r.old, r.canonical) for r in kg.user_map(nodes).collect()} == {("User Jdoe", "jdoe"), ("J Doe Person", "jdoe")}


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.row_id) for r in retrieve.top_k(df.where("vec_id % 50 = 0"), df, "vec_id", "embedding", 5, -1.0).collect() if r.query_id < 900}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        best = set(np.argsort(-(u @ u[q]))[:5].tolist())
        assert len(best & {b for a, b in got if a == q}) >= 5
    assert retrieve.top_k(df.where("false"), df, "vec_id", "embedding").count() == 0


def test_ward_and_newest(spark):
    import numpy as np

    g = retrieve.ward_merged(np.array([[0.0], [0.1], [5.0], [5.2], [9.0]]), np.ones(5), 3)
    assert g[0] == g[1] and g[2] == g[3] and len(set(g.tolist())) == 3
    df = spark.createDataFrame([(1, 2, "b"), (1, None, "a"), (None, 1, "c"), (1, 2, "b")], "id long, n long, x string")
    assert sorted(map(tuple, newest(df, "id", ("n",)).collect()), key=str) == [(1, 2, "b"), (None, 1, "c")]
