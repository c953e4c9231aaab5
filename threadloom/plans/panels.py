"""Queries of the explorer's panels and what they are in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import LABELS
from ..operators import graph as G
from ..operators import kg as K
from ..operators import panels as P
from ..operators import reports as R
from ..session import ship
from ..sources.tables import table
from .forum import over
from .graph import _SUPER, SEED, Graph, on

TEMPLATE = "[{category}] {title} ({views} views)"
PREFERRED = ("No such category", "Shaders", "Bridges", "Bug Yard")
BOX = (-0.5, -0.5, 0.5, 0.5)
TYPES = (*K.STRUCTURAL, "place")


def _of(f: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Graph(spark, sf_dir).fixed())


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(ship(spark), sf_dir, name))


def _budget(g: Graph) -> DataFrame:
    rows = g.c.topics.where("posts_count IS NOT NULL").select("category", "id", "posts_count", "views")
    return P.within_budget(rows, "category", "posts_count", 60, F.desc_nulls_last("views"), F.asc("id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "category_hubs": _of(lambda g: P.inner_hubs(P.grouped(g.nodes), g.edges)),
    "category_bridges": _of(lambda g: P.outer_hubs(P.grouped(g.nodes), g.edges)),
    "cluster_composition": _of(lambda g: P.composition(g.nodes, P.homes(g.entities, g.topics), G.articulation_points(g.edges))),
    "cluster_ranks": _of(lambda g: P.size_ranks(P.homes(g.entities, g.topics))),
    "cluster_relations": _of(lambda g: P.relation_types(P.homes(g.entities, g.topics), g.edges)),
    "glance": _of(lambda g: P.glance(g.nodes, g.edges, G.keyword_counts(g.edges))),
    "edge_panel": _of(lambda g: P.edge_panel(g.edges, g.relations, "Bug Yard", "Kipiroleba line: crew roster flickers")),
    "community_lock": _of(lambda g: P.locked(P.homes(g.entities, g.topics), g.edges, "Bug Yard")),
    "drill_category": _of(lambda g: P.drilled(g.nodes, g.edges, "Structure")),
    "viewport": _on("embeddings", lambda t: P.in_view(t, F.col("embedding")[0], F.col("embedding")[1], BOX).select("vec_id")),
    "label_cap": _of(lambda g: P.labelled(g.nodes, g.edges)),
    "node_styles": _of(lambda g: P.node_styles(g.nodes, g.edges, TYPES)),
    "edge_styles": _of(lambda g: P.edge_styles(g.edges)),
    "node_tooltips": _of(lambda g: P.tooltips(g.nodes, g.edges)),
    "summary_lines": _of(lambda g: P.summary_lines(g.nodes, g.edges)),
    "edge_names": _of(lambda g: P.edge_names(g.edges)),
    "neighbours": _of(lambda g: P.neighbours_of(g.edges, SEED)),
    "quoted_titles": _of(lambda g: g.c.topics.where("title IS NOT NULL").select("id", P.quoted(F.col("title")).alias("q")).select("id", "q.*")),
    "filled_templates": _of(lambda g: g.c.topics.select("id", P.filled(TEMPLATE, {c: F.col(c) for c in ("category", "title", "views")}).alias("text"))),
    "first_topic_files": _of(lambda g: P.first_files(g.c.topics, 25)),
    "topic_sample": _of(lambda g: P.sampled(g.c.topics.select("id", "title"), "id", 30)),
    "label_frequency": _of(lambda g: P.label_frequency(P.sampled(g.c.topics.where("title IS NOT NULL").select("id", "title"), "id", 200), "title", LABELS)),
    "shared_names": _of(lambda g: P.shared_names(g.nodes.where("entity_type = 'tag'").select("name"), table(g.c.spark, g.c.sf_dir, "tag_registry").select(F.col("label").alias("name")))),
    "missing_batches": _of(lambda g: P.batched(R.missing_posts(g.c), "topic_id", "post_number", 3)),
    "token_budget": _of(_budget),
    "question_mode": _on("benchmark", lambda t: t.select("item_id", P.advised(F.col("question")).alias("mode"))),
    "question_keywords": _on("benchmark", lambda t: t.select("item_id", P.question_keywords(F.col("question")).alias("k")).select("item_id", "k.*")),
    "preferred_category": _of(lambda g: P.preferred(g.c.topics.select("category").distinct(), "category", PREFERRED)),
}

_MEMBER = f"mb AS (SELECT name, {_SUPER('entity_type')} AS community FROM nd), sdd AS (SELECT a, b, x.community AS ca, y.community AS cb FROM ed JOIN mb x ON x.name = a JOIN mb y ON y.name = b)"
_HOMES = "mb AS (SELECT entity_name AS name, min(category) AS community FROM ent JOIN tn ON tid = source_id GROUP BY 1), sdd AS (SELECT a, b, x.community AS ca, y.community AS cb FROM ed JOIN mb x ON x.name = a JOIN mb y ON y.name = b)"
_ROUND = "floor(({0}) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"
_PLACES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_SEEN = lambda words: "(" + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + ")"
_SAMPLE = "SELECT id, title FROM vt {0} ORDER BY md5('42:' || id), id LIMIT {1}"
_TOKENS = f"list_filter(regexp_extract_all(lower(question), '[a-z][a-z0-9]+'), lambda t: NOT list_contains({list(G.X.STOP_WORDS)!r}, t))"
_ONCE = lambda x: f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"

SQL: dict[str, str] = {
    "category_hubs": on("SELECT community, name, degree, rank FROM (SELECT community, name, COALESCE(d, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY COALESCE(d, 0) DESC, name) AS rank FROM mb LEFT JOIN (SELECT name, count(*) AS d FROM (SELECT a AS name FROM sdd WHERE ca = cb UNION ALL SELECT b FROM sdd WHERE ca = cb) GROUP BY 1) USING (name)) WHERE rank <= 10", _MEMBER),
    "category_bridges": on("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community, other ORDER BY bridges DESC, name) AS rank FROM (SELECT community, other, name, count(*) AS bridges FROM (SELECT ca AS community, cb AS other, b AS name FROM sdd WHERE ca <> cb UNION ALL SELECT cb, ca, a FROM sdd WHERE ca <> cb) GROUP BY 1, 2, 3)) WHERE rank <= 5", _MEMBER),
    "cluster_composition": on(
        "SELECT community, entity_type, count(*) AS n, count(cut.name) AS cut_nodes FROM nd JOIN mb USING (name) LEFT JOIN cut USING (name) GROUP BY 1, 2",
        _HOMES + ", cut AS (SELECT DISTINCT m.v AS name FROM many m JOIN adj ON adj.x = m.v WHERE (m.v, adj.y) NOT IN (SELECT v, y FROM past))",
        recursive="many AS (SELECT x AS v, min(y) AS s FROM adj WHERE x <> y GROUP BY 1 HAVING count(*) > 1), past(v, y) AS (SELECT v, s FROM many UNION SELECT p.v, a.y FROM past p JOIN adj a ON a.x = p.y AND a.y <> p.v)",
    ),
    "cluster_ranks": on("SELECT community, size, rank, CASE WHEN s <= 1 THEN 'top 1%' WHEN s <= 5 THEN 'top 5%' WHEN s <= 10 THEN 'top 10%' ELSE '' END AS band FROM (SELECT *, rank * 100.0::DOUBLE / count(*) OVER () AS s FROM (SELECT community, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, community) AS rank FROM mb GROUP BY 1))", _HOMES),
    "cluster_relations": on("SELECT * FROM (SELECT community, keyword, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, keyword) AS rank FROM (SELECT ca AS community, keyword FROM kw JOIN sdd USING (a, b) WHERE ca = cb) GROUP BY 1, 2) WHERE rank <= 8", _HOMES),
    "glance": on(f"SELECT * FROM (SELECT 'nodes' AS section, name AS item, degree AS n FROM dg ORDER BY n DESC, item LIMIT 5) UNION ALL SELECT * FROM (SELECT 'categories', {_SUPER('entity_type')} AS item, count(*) AS n FROM nd GROUP BY 2 ORDER BY n DESC, item LIMIT 5) UNION ALL SELECT * FROM (SELECT 'relations', keyword AS item, n FROM kc ORDER BY n DESC, item LIMIT 5)"),
    "edge_panel": on("SELECT source_id, count(*) AS n, any_value(w) AS weight, any_value(ph) AS phrases FROM rel JOIN (SELECT a, b, weight AS w, array_to_string(list_filter(list_transform(string_split(replace(keywords, '<SEP>', ','), ','), lambda x: trim(x)), lambda x: x <> '')[:3], ', ') AS ph FROM ed WHERE a = 'Bug Yard' AND b = 'Kipiroleba line: crew roster flickers') ON least(src, tgt) = a AND greatest(src, tgt) = b GROUP BY 1 ORDER BY n DESC, source_id LIMIT 10"),
    "community_lock": on("SELECT a, b, weight FROM ed JOIN sdd USING (a, b) WHERE ca = 'Bug Yard' AND cb = 'Bug Yard'", _HOMES),
    "drill_category": on(f"SELECT entity_type, count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS ends FROM dg WHERE {_SUPER('entity_type')} = 'Structure' GROUP BY 1"),
    "viewport": f"SELECT vec_id FROM embeddings WHERE embedding[1] >= {BOX[0]} AND embedding[2] >= {BOX[1]} AND embedding[1] <= {BOX[2]} AND embedding[2] <= {BOX[3]}",
    "label_cap": on("SELECT name, CASE WHEN length(name) > 30 THEN left(name, 30) || '…' ELSE name END AS label FROM dg ORDER BY degree DESC, name LIMIT 50"),
    "node_styles": on(f"SELECT name, {_ROUND.format('8 + 35 * ln(1e0::DOUBLE + degree) / ln(1e0::DOUBLE + (SELECT greatest(max(degree), 1) FROM dg))')} AS size, CASE WHEN list_contains({_PLACES}, entity_type) THEN CAST((list_position({_PLACES}, entity_type) - 1) % 16 AS BIGINT) END AS colour FROM dg"),
    "edge_styles": on(f"SELECT a, b, {_ROUND.format('0.5 + 4 * weight / (SELECT COALESCE(max(weight), 1.0) FROM ed)')} AS width FROM ed"),
    "node_tooltips": on(f"SELECT name, name || chr(10) || {_SUPER('dg.entity_type')} || ' · ' || dg.entity_type || ' · deg ' || degree || chr(10) || chr(10) || CASE WHEN length(COALESCE(description, '')) > 240 THEN left(description, 240) || '…' ELSE COALESCE(description, '') END AS tooltip FROM dg JOIN nd USING (name)"),
    "summary_lines": on(r"SELECT name, '- **' || replace(replace(replace(name, '|', '\|'), chr(13), ''), chr(10), ' ') || '** (' || entity_type || ', ' || degree || ' connections)' AS line FROM dg ORDER BY degree DESC, name LIMIT 20"),
    "edge_names": on("SELECT a, b, a || ' ↔ ' || b AS label FROM ed"),
    "neighbours": on(f"SELECT CASE WHEN a = '{SEED}' THEN b ELSE a END AS name, weight FROM ed WHERE a = '{SEED}' OR b = '{SEED}'"),
    "quoted_titles": over("""SELECT id, '''' || replace(title, '''', '''''') || '''' AS sql, '''' || replace(title, '''', '''\\''''') || '''' AS shell, '"' || replace(replace(replace(replace(title, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '"' AS attribute FROM vt WHERE title IS NOT NULL"""),
    "filled_templates": over("SELECT id, '[' || COALESCE(category, '') || '] ' || COALESCE(title, '') || ' (' || COALESCE(CAST(views AS VARCHAR), '') || ' views)' AS text FROM vt"),
    "first_topic_files": over("SELECT id, 'topic-' || id || '.json' AS file_name FROM vt ORDER BY 2 LIMIT 25"),
    "topic_sample": over(_SAMPLE.format("", 30)),
    "label_frequency": over("SELECT label, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"CASE WHEN {_SEEN(w)} THEN '{k}' END" for k, w in LABELS.items()) + f"]) AS label FROM ({_SAMPLE.format('WHERE title IS NOT NULL', 200)})) WHERE label IS NOT NULL GROUP BY 1"),
    "shared_names": on("SELECT lower(name) AS name FROM nd WHERE entity_type = 'tag' INTERSECT SELECT lower(label) FROM tag_registry"),
    "missing_batches": over("SELECT topic_id, post_number, CAST((row_number() OVER (PARTITION BY topic_id ORDER BY post_number) - 1) // 3 AS BIGINT) AS batch FROM (SELECT id AS topic_id, unnest(range(1, posts_count + 1)) AS post_number FROM vt WHERE posts_count >= 1) a WHERE NOT EXISTS (SELECT 1 FROM vp WHERE vp.topic_id = a.topic_id AND vp.post_number = a.post_number)"),
    "token_budget": over("SELECT * FROM (SELECT category, id, posts_count, views, CAST(sum(posts_count) OVER (PARTITION BY category ORDER BY views DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM vt WHERE posts_count IS NOT NULL) WHERE spent <= 60"),
    "question_mode": rf"SELECT item_id, CASE WHEN regexp_matches(lower(question), '{P.COUNTING}') THEN 'sql' WHEN regexp_matches(question, '[a-z,] [A-Z][a-z]{{3,}}') THEN 'local' ELSE 'mix' END AS mode FROM benchmark",
    "question_keywords": rf"SELECT item_id, array_to_string({_ONCE('n')}, ', ') AS low, array_to_string({_ONCE('t0')}, ', ') AS high FROM (SELECT item_id, n, list_filter({_TOKENS}, lambda t: NOT list_contains(list_transform(n, lambda x: lower(x)), t)) AS t0 FROM (SELECT item_id, question, regexp_extract_all(question, '\b[A-Z][a-z]{{3,}}\b') AS n FROM benchmark))",
    "preferred_category": over("SELECT category FROM (SELECT DISTINCT category FROM vt) WHERE list_contains([" + ", ".join(f"'{p}'" for p in PREFERRED) + "], category) ORDER BY list_position([" + ", ".join(f"'{p}'" for p in PREFERRED) + "], category) LIMIT 1"),
}
