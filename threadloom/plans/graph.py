"""Queries over the knowledge graph and what they are in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explore as X
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import kg as K
from ..operators import synth as S
from ..operators.views import Corpus
from ..session import materialize, ship, shared_path
from .forum import over

SEED, GOAL, KINDS = "noisy-shader-cache", "Bug Yard", ("tag", "user", "place")
#: A moment before which the ledger of the incremental queries was written.
EARLIER = "2023-06-01"

_WRITTEN: dict[tuple, tuple[DataFrame, DataFrame]] = {}


class Graph:
    """The knowledge graph of one data folder; nodes and edges are written once, for the queries that iterate."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.c = Corpus(ship(spark), sf_dir)

    @cached_property
    def entities(self) -> DataFrame:
        return K.entities(self.c)

    @cached_property
    def relations(self) -> DataFrame:
        return K.relations(self.c)

    @cached_property
    def topics(self) -> DataFrame:
        return K.topic_nodes(self.c)

    @cached_property
    def nodes(self) -> DataFrame:
        return K.merged_nodes(self.entities)

    @cached_property
    def edges(self) -> DataFrame:
        return K.merged_edges(self.relations)

    @cached_property
    def earlier(self) -> Graph:
        """The graph as of EARLIER."""
        g = Graph(self.c.spark, self.c.sf_dir)
        g.c = self.c.as_of(EARLIER)
        return g

    def fixed(self) -> Graph:
        """With nodes and edges written, once a session for one state of the tables."""
        spark = self.c.spark
        path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.c.sf_dir}/{name}.parquet")
        times = tuple(path(n).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(n)).getModificationTime() for n in ("topics", "posts"))
        key = (spark.sparkContext.applicationId, self.c.sf_dir, *times)
        if key not in _WRITTEN:
            _WRITTEN[key] = materialize(self.nodes, "nodes"), materialize(self.edges, "edges")
        self.nodes, self.edges = _WRITTEN[key]
        return self

    def buckets(self) -> DataFrame:
        return G.token_buckets(materialize(G.keyword_counts(self.edges), "keywords"))

    def variants(self) -> DataFrame:
        """Nodes and, of every third, a spelling as a language model might give it, to be made canonical."""
        third = self.nodes.where(F.length("name") % 3 == 0)
        upper = third.select(F.upper("name").alias("name"), "entity_type")
        person = third.where("entity_type = 'user'").select(F.concat(F.lit("User "), "name").alias("name"), F.lit("other").alias("entity_type"))
        return self.nodes.select("name", "entity_type").unionByName(upper.where("name <> lower(name)")).unionByName(person).distinct()


def _of(f: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


def _paths(g: Graph) -> DataFrame:
    found = G.shortest_paths(g.fixed().edges, SEED, GOAL)
    return g.c.spark.createDataFrame([(i, len(p) - 1, p) for i, p in enumerate(found)], "path_no int, hops int, nodes array<string>")


def _synced(g: Graph) -> DataFrame:
    """A sync of the corpus onto the state that one of EARLIER left."""
    state = shared_path(g.c.spark, "state")
    I.sync(g.earlier.c, state)
    return I.sync(g.c, state)


def _rewritten(g: Graph) -> DataFrame:
    """The nodes of EARLIER after a buffer: what the graph has since are upserts, what it had and lost are deletes."""
    was, now = g.earlier.nodes.select("name", "entity_type", "sources"), g.nodes.select("name", "entity_type", "sources")
    gone = was.join(now.select("name"), "name", "left_anti")
    operations = now.select("*", F.lit(1).alias("n"), F.lit(False).alias("deleted")).unionByName(gone.select("*", F.lit(2).alias("n"), F.lit(True).alias("deleted")))
    return K.buffered(was, operations, "name", "n")


def _claimed(g: Graph) -> DataFrame:
    """Nodes as an extractor may leave them: those that it saw as places are places, whatever the topics say."""
    said = K.places(g.topics)[0].select(F.col("entity_name").alias("name")).distinct().withColumn("place", F.lit("place"))
    return g.nodes.join(said, "name", "left").withColumn("entity_type", F.coalesce("place", "entity_type")).drop("place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kg_entities": _of(lambda g: g.entities),
    "kg_edges": _of(lambda g: g.relations),
    "merged_nodes": _of(lambda g: g.nodes),
    "merged_edges": _of(lambda g: g.edges),
    "topic_document": _of(lambda g: K.topic_documents(g.c)),
    "chunk_split": _of(lambda g: K.token_chunks(K.topic_documents(g.c), "topic_id", "document", 1200, 100)),
    "degree": _of(lambda g: G.degrees(g.nodes, g.edges)),
    "type_histogram": _of(lambda g: G.type_histogram(g.nodes)),
    "oov_count": _of(lambda g: G.out_of_vocabulary(g.nodes, ("Category", "Topic", "Tag"))),
    "hubs": _of(lambda g: G.hubs(g.nodes, g.edges)),
    "content_hubs": _of(lambda g: G.hubs(g.nodes, g.edges, structural=False)),
    "degree_rank_bands": _of(lambda g: G.rank_bands(g.nodes, g.edges)),
    "supercategory_rollup": _of(lambda g: G.node_rollup(g.nodes, g.edges)),
    "category_pair_rollup": _of(lambda g: G.pair_rollup(g.nodes, g.edges)),
    "type_pair_rollup": _of(lambda g: G.pair_rollup(g.nodes, g.edges, by_type=True)),
    "weight_bounds": _of(lambda g: G.weight_bounds(g.edges)),
    "keyword_counts": _of(lambda g: G.keyword_counts(g.edges)),
    "token_counts": _of(lambda g: G.token_counts(G.keyword_counts(g.edges))),
    "verb_harvest": _of(lambda g: G.verb_harvest(G.keyword_counts(g.edges))),
    "token_clusters": _of(lambda g: g.fixed().buckets()),
    "edge_buckets": _of(lambda g: G.classified_edges(g.fixed().edges, g.buckets())),
    "bucket_coverage": _of(lambda g: G.bucket_coverage(G.classified_edges(g.fixed().edges, g.buckets()))),
    "edge_time_bounds": _of(lambda g: G.edge_times(g.relations, g.topics)),
    "peak_quarter": _of(lambda g: G.peak_quarters(g.relations, g.topics)),
    "facet_leave_one_out": _of(lambda g: G.leave_one_out(g.nodes, g.edges, KINDS, 3, "er")),
    "visible_edges": _of(lambda g: G.visible_edges(g.nodes, g.edges, ("tag", "topic"), 4, 0.5)),
    "category_stats": _of(lambda g: G.category_stats(g.nodes, g.edges)),
    "pair_stats": _of(lambda g: G.pair_stats(g.nodes, g.edges, "Structure", "Discussion")),
    "cluster_stats": _of(lambda g: G.cluster_stats(g.nodes.select("name", F.col("entity_type").alias("community")), g.edges)),
    "node_table": _of(lambda g: X.node_table(g.nodes, g.edges, "yard")),
    "connections": _of(lambda g: X.connections(g.nodes, g.edges, SEED)),
    "edges_within": _of(lambda g: X.within(G.edge_times(g.relations, g.topics), 40, 60)),
    "search_context": _of(lambda g: X.search_context(g.nodes, g.edges, "shader", ("tag", "topic"))),
    "topic_index": _of(lambda g: X.topic_index(g.c)),
    "first_mentions": _of(lambda g: X.first_mentions(g.edges, "a", "keywords", ",|<SEP>")),
    "chunk_names": _of(lambda g: X.chunk_names(K.token_chunks(K.topic_documents(g.c), "topic_id", "document", 1200, 100)).select("topic_id", "chunk_no", "source_id")),
    "path_highlight": _of(lambda g: X.highlighted(_paths(g))),
    "neighbour_types": _of(lambda g: G.neighbour_types(g.nodes, g.edges, SEED)),
    "provenance_rank": _of(lambda g: G.provenance(g.entities, g.relations, SEED)),
    "k_hop": _of(lambda g: G.levels(g.fixed().edges, SEED, 2)),
    "shortest_path_len": _of(lambda g: G.levels(g.fixed().edges, SEED)),
    "k_shortest": _of(_paths),
    "ppr_top10": _of(lambda g: G.pagerank(g.fixed().edges, SEED).where(F.col("name") != SEED).orderBy(F.desc("score"), "name").limit(10)),
    "components": _of(lambda g: G.components(g.fixed().edges, g.nodes)),
    "articulation": _of(lambda g: G.articulation_points(g.fixed().edges)),
    "communities": _of(lambda g: G.communities(g.fixed().nodes, g.edges)),
    "canonical_map_case": _of(lambda g: K.case_map(g.variants(), g.nodes.where(F.col("entity_type").isin(*K.STRUCTURAL)))),
    "canonical_map_users": _of(lambda g: K.user_map(g.variants())),
    "pass1_plan": _of(lambda g: K.plan(K.payload_hashes(g.c), K.payload_hashes(g.earlier.c))),
    "stale_edges": _of(lambda g: K.stale(g.relations, g.earlier.relations)),
    "orphans": _of(lambda g: K.orphans(g.nodes, g.earlier.edges)),
    "type_reassertion": _of(lambda g: K.reasserted(_claimed(g), K.structural_types(g.c))),
    "retyped_nodes": _of(lambda g: K.retyped(_claimed(g), K.structural_types(g.c)).select("name", "entity_type")),
    "index_verification": _of(lambda g: K.verification(g.nodes, K.structural_types(g.c))),
    "buffered_writes": _of(_rewritten),
    "title_dedupe": _of(lambda g: K.deduplicated_titles(g.c.topics_raw)),
    "kg_sync": _of(_synced),
    "synth_topics": _of(lambda g: S.topics(g.c.spark, "large")),
    "synth_posts": _of(lambda g: S.posts(g.c.spark, "large")),
    "reply_clock": _of(lambda g: K.reply_clock(g.c.posts)),
}

_BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_TYPES = "('category', 'tag', 'topic', 'user')"
_SUPER = lambda x: "CASE lower(trim({})) ".format(x) + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.SUPER.items()) + " ELSE 'Other' END"
_U, _T, _C = (p[1] for p in K.PINS.values())
#: The graph, for every query to select from.
RELATIONS = rf"""
tn AS (SELECT id AS topic_id, 'topic-' || id AS tid, COALESCE(NULLIF({_STRIP('title')}, ''), 'Topic ' || id) AS name, COALESCE(category_name, 'General') AS category, TRY_CAST(created_at AS TIMESTAMP) AS created_at FROM t0),
tg AS (SELECT DISTINCT topic_id, tag_label FROM vg WHERE tag_label IS NOT NULL),
us AS (SELECT DISTINCT topic_id, username FROM vp WHERE username IS NOT NULL AND username <> ''),
pl AS (SELECT tid, name, unnest(list_distinct(list_filter(string_split_regex(name, '[^\p{{L}}]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{7,}}$')))) AS place, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^\p{{L}}]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$')))) AS words FROM tn),
ent AS (SELECT category AS entity_name, 'category' AS entity_type, 'Forum category: ' || category AS description, tid AS source_id FROM tn
  UNION ALL SELECT name, 'topic', 'Discussion thread in the ' || category || ' category', tid FROM tn
  UNION ALL SELECT tag_label, 'tag', 'Forum tag: ' || tag_label, tid FROM tg JOIN tn USING (topic_id)
  UNION ALL SELECT username, 'user', 'Forum user: ' || username, tid FROM us JOIN tn USING (topic_id)
  UNION ALL SELECT place, 'place', 'Mentioned in ' || name, tid FROM pl),
rel0 AS (SELECT name AS src, category AS tgt, 'Topic posted in the ' || category || ' category' AS description, '{_C}' AS keywords, 1.0::DOUBLE AS weight, tid AS source_id FROM tn
  UNION ALL SELECT name, tag_label, 'Topic tagged with ' || tag_label, '{_T}', 0.8, tid FROM tg JOIN tn USING (topic_id)
  UNION ALL SELECT username, name, username || ' posted in this topic', '{_U}', 0.5, tid FROM us JOIN tn USING (topic_id)),
nd AS (SELECT name, entity_type, description, sources FROM (SELECT entity_name AS name, entity_type, row_number() OVER (PARTITION BY entity_name ORDER BY count(*) DESC, entity_type) AS rn FROM ent GROUP BY 1, 2) JOIN
  (SELECT entity_name AS name, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, count(DISTINCT source_id) AS sources FROM ent GROUP BY 1) USING (name) WHERE rn = 1),
rel AS (SELECT * FROM rel0 UNION ALL SELECT name, place, 'Topic mentions ' || place, array_to_string(words, ', '), 0.3, tid FROM pl),
ed AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, CAST(sum(CAST(round(weight * 10) AS BIGINT)) AS BIGINT) / 10.0::DOUBLE AS weight, string_agg(DISTINCT keywords, '<SEP>' ORDER BY keywords) AS keywords, count(DISTINCT source_id) AS sources FROM rel WHERE src <> tgt GROUP BY 1, 2),
dg AS (SELECT nd.name, nd.entity_type, COALESCE(d, 0) AS degree FROM nd LEFT JOIN (SELECT name, count(*) AS d FROM (SELECT a AS name FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1) USING (name)),
te AS (SELECT ed.*, x.entity_type AS type_a, y.entity_type AS type_b FROM ed JOIN nd x ON x.name = a JOIN nd y ON y.name = b),
adj AS (SELECT a AS x, b AS y FROM ed UNION ALL SELECT b, a FROM ed),
kw AS (SELECT a, b, keyword FROM (SELECT a, b, lower(trim(unnest(string_split(replace(keywords, '<SEP>', ','), ',')))) AS keyword FROM ed) WHERE keyword <> ''),
kc AS (SELECT keyword, count(*) AS n FROM kw GROUP BY 1),
tk AS (SELECT keyword, n, list_filter(regexp_extract_all(lower(keyword), '[a-z][a-z0-9]+'), lambda t: NOT list_contains({list(G.X.STOP_WORDS)!r}, t)) AS toks FROM kc)
"""
_PINNED = "(" + ", ".join(f"'{k}'" for k in K.PIN_KEYWORDS) + ")"
_MONTH = "greatest(0, (year(created_at) - 2018) * 12 + month(created_at) - 1)"
_STEM = "CASE WHEN length(t) > 6 AND ends_with(t, 'ing') THEN t[:-4] WHEN length(t) > 5 AND ends_with(t, 'ed') THEN t[:-3] WHEN length(t) > 5 AND ends_with(t, 'es') THEN t[:-3] WHEN length(t) > 4 AND ends_with(t, 's') THEN t[:-2] ELSE t END"


def on(select: str, more: str = "", recursive: str = "") -> str:
    """SQL of a query over the graph; `recursive` relations come before `more`."""
    text = over(select, ", ".join(x for x in (RELATIONS, recursive, more) if x))
    return text.replace("WITH", "WITH RECURSIVE", 1) if recursive else text


def _levels(most: int) -> str:
    steps = [f"l0 AS MATERIALIZED (SELECT '{SEED}' AS name, 0 AS hops WHERE EXISTS (SELECT 1 FROM adj WHERE x = '{SEED}'))"]
    for i in range(1, most + 1):
        steps.append(f"l{i} AS MATERIALIZED (SELECT * FROM l{i - 1} UNION ALL SELECT DISTINCT y, {i} FROM adj JOIN l{i - 1} ON x = name AND hops = {i - 1} WHERE y NOT IN (SELECT name FROM l{i - 1}))")
    return ", ".join(steps)


def _rank(rounds: int = 30) -> str:
    steps = ["out AS MATERIALIZED (SELECT x, y, count(*) OVER (PARTITION BY x) AS d FROM adj)", f"r0 AS MATERIALIZED (SELECT '{SEED}' AS name, 1.0::DOUBLE AS p)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT name, sum(p) AS p FROM (SELECT y AS name, p / d * 0.85::DOUBLE AS p FROM out JOIN r{i - 1} ON x = name UNION ALL SELECT '{SEED}', 0.15::DOUBLE) GROUP BY 1)")
    return ", ".join(steps)


_FOLD = lambda x: f"translate({x}, '․‧·._', '-----')"
_VARIANTS = "va AS (SELECT DISTINCT * FROM (SELECT name, entity_type FROM nd UNION ALL SELECT upper(name), entity_type FROM nd WHERE length(name) % 3 = 0 AND upper(name) <> lower(upper(name)) UNION ALL SELECT 'User ' || name, 'other' FROM nd WHERE length(name) % 3 = 0 AND entity_type = 'user'))"
_ELIDED = "array_to_string(list_transform(string_split_regex({0}, '[A-Za-z0-9+/=]{{200,}}'), lambda g, i: g || CASE WHEN i <= len(regexp_extract_all({0}, '[A-Za-z0-9+/=]{{200,}}')) THEN '<' || length(regexp_extract_all({0}, '[A-Za-z0-9+/=]{{200,}}')[i]) || '-char encoded blob elided>' ELSE '' END), '')"
_DOCUMENT = f"""SELECT t0.id AS topic_id, '[' || COALESCE(category_name, 'General') || '] ' || COALESCE(title, '') || CASE WHEN closed AND archived THEN ' [closed, archived]' WHEN closed THEN ' [closed]' WHEN archived THEN ' [archived]' ELSE '' END || COALESCE(' (tags: ' || tags_ || ')', '') || ' (' || left(COALESCE(created_at, ''), 10) || ')' || chr(10) || chr(10) || COALESCE(body, '') AS document FROM t0
  LEFT JOIN (SELECT topic_id, string_agg(DISTINCT t, ', ' ORDER BY t) AS tags_ FROM (SELECT topic_id, COALESCE(NULLIF(tag_name, ''), NULLIF(tag_slug, ''), '') AS t FROM vg) WHERE t <> '' GROUP BY 1) s ON s.topic_id = t0.id
  LEFT JOIN (SELECT topic_id, string_agg(x, chr(10) ORDER BY post_number, post_id) AS body FROM (SELECT topic_id, post_number, post_id, COALESCE(username, 'unknown') || ':' || chr(10) || CASE WHEN COALESCE(reply_to_post_number, 0) <> 0 THEN '(in reply to post #' || reply_to_post_number || ')' || chr(10) ELSE '' END || b || chr(10) AS x FROM (SELECT *, {_ELIDED.format(_STRIP('plain_text'))} AS b FROM vp) WHERE b <> '') GROUP BY 1) b ON b.topic_id = t0.id"""

_CHUNKS = f"SELECT topic_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(p) AS INTEGER) AS n_tokens, array_to_string(p, ' ') AS chunk FROM (SELECT topic_id, chunk_no, w[chunk_no * 1100 + 1 : chunk_no * 1100 + 1200] AS p FROM (SELECT topic_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 1200) / 1100.0)) AS BIGINT) + 1)) AS chunk_no FROM (SELECT topic_id, list_filter(string_split_regex(document, '\\s+'), lambda x: x <> '') AS w FROM ({_DOCUMENT})) WHERE len(w) > 0))"

#: Relations and ledgers as of EARLIER.
_EARLIER = f"""
tn1 AS (SELECT * FROM tn WHERE topic_id IN (SELECT id FROM t0 WHERE created_at < '{EARLIER}')),
us1 AS (SELECT DISTINCT topic_id, username FROM vp WHERE username IS NOT NULL AND username <> '' AND post_id IN (SELECT id FROM posts WHERE created_at < '{EARLIER}')),
rel1 AS (SELECT name AS src, category AS tgt FROM tn1 UNION ALL SELECT name, tag_label FROM tg JOIN tn1 USING (topic_id) UNION ALL SELECT username, name FROM us1 JOIN tn1 USING (topic_id) UNION ALL SELECT name, place FROM pl WHERE tid IN (SELECT tid FROM tn1)),
was AS (SELECT topic_id, string_agg(username, ',' ORDER BY username) AS users FROM us1 GROUP BY 1), now AS (SELECT topic_id, string_agg(username, ',' ORDER BY username) AS users FROM us GROUP BY 1)"""
_ACTION = "CASE WHEN tn1.topic_id IS NULL THEN 'INSERT' WHEN was.users IS NOT DISTINCT FROM now.users THEN 'SKIP' ELSE 'RESEED' END"
_LEDGERS = "LEFT JOIN tn1 USING (topic_id) LEFT JOIN was USING (topic_id) LEFT JOIN now USING (topic_id)"
_CLAIMED = "tr AS (SELECT DISTINCT entity_name AS name, lower(entity_type) AS entity_type FROM ent WHERE entity_type <> 'place'), cl AS (SELECT name, CASE WHEN name IN (SELECT place FROM pl) THEN 'place' ELSE entity_type END AS now FROM nd)"
#: Paths up to two hops longer than the shortest (which hold three on the test tables), and the first three of them.
_PATHS = (
    f"""bg(name, hops) USING KEY (name) AS (SELECT x, 0 FROM (SELECT DISTINCT x FROM adj WHERE x = '{GOAL}') UNION SELECT y, min(hops) + 1 FROM bg JOIN adj ON x = bg.name WHERE y NOT IN (SELECT name FROM recurring.bg) GROUP BY 1),
pt(path, last) AS (SELECT [name], name FROM bg WHERE name = '{SEED}' UNION ALL SELECT list_append(path, y), y FROM pt JOIN adj ON x = last JOIN bg ON bg.name = y WHERE last <> '{GOAL}' AND NOT list_contains(path, y) AND len(path) + hops <= (SELECT hops + 2 FROM bg WHERE name = '{SEED}'))""",
    f"kp AS (SELECT path, row_number() OVER (ORDER BY len(path), path) AS n FROM pt WHERE last = '{GOAL}' QUALIFY n <= 3)",
)
#: Token buckets: the seeds, picked along the ranking, and what they route.
_BUCKETS = (
    f"""fr AS (SELECT keyword, n, toks FROM tk WHERE keyword NOT IN {_PINNED}),
rk AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS r FROM (SELECT token, sum(n) AS n FROM (SELECT n, unnest(list_distinct(toks)) AS token FROM fr) GROUP BY 1)),
sd(r, seeds) AS (SELECT CAST(0 AS BIGINT), []::VARCHAR[] UNION ALL SELECT sd.r + 1, CASE WHEN len(seeds) < 12 AND len(list_filter(seeds, lambda s: contains(s, token) OR contains(token, s))) = 0 THEN list_append(seeds, token) ELSE seeds END FROM sd JOIN rk ON rk.r = sd.r + 1)""",
    """ss AS (SELECT seeds FROM sd ORDER BY r DESC LIMIT 1),
ro AS (SELECT * FROM (SELECT keyword, n, seeds, list_min(list_filter(range(1, len(seeds) + 1), lambda i: len(list_filter(toks, lambda t: contains(t, seeds[i]) OR contains(seeds[i], t))) > 0)) AS seed FROM fr, ss) WHERE seed IS NOT NULL),
tb AS (SELECT keyword, CAST(b - 1 AS INTEGER) AS bucket, upper(left(seeds[seed], 1)) || seeds[seed][2:] AS bucket_name, n FROM ro JOIN (SELECT seed, row_number() OVER (ORDER BY sum(n) DESC, seed) AS b FROM ro GROUP BY 1) USING (seed)),
pi(keyword, i) AS (VALUES """ + ", ".join(f"('{k}', {i})" for k, i in K.PIN_KEYWORDS.items()) + f"""),
ix AS (SELECT keyword, i FROM pi UNION ALL SELECT keyword, bucket + {len(K.PINS)} FROM tb),
vo AS (SELECT a, b, i, row_number() OVER (PARTITION BY a, b ORDER BY count(*) DESC, i) AS rn FROM kw JOIN ix USING (keyword) GROUP BY 1, 2, 3),
ce AS (SELECT a, b, weight, CAST(COALESCE(i, -1) AS INTEGER) AS bucket FROM ed LEFT JOIN (SELECT a, b, i FROM vo WHERE rn = 1) USING (a, b))""",
)


SQL: dict[str, str] = {
    "kg_entities": on("SELECT * FROM ent"),
    "kg_edges": on("SELECT * FROM rel"),
    "merged_nodes": on("SELECT * FROM nd"),
    "merged_edges": on("SELECT * FROM ed"),
    "degree": on("SELECT * FROM dg"),
    "type_histogram": on(f"SELECT entity_type, count(*) AS n, entity_type IN {_TYPES} AS structural FROM nd GROUP BY entity_type"),
    "oov_count": on("SELECT entity_type, count(*) AS n FROM nd WHERE lower(entity_type) NOT IN ('category', 'topic', 'tag') GROUP BY 1"),
    "hubs": on("SELECT * FROM dg ORDER BY degree DESC, name LIMIT 15"),
    "content_hubs": on(f"SELECT * FROM dg WHERE entity_type NOT IN {_TYPES} ORDER BY degree DESC, name LIMIT 15"),
    "degree_rank_bands": on("SELECT name, degree, rank, CASE WHEN s <= 0.01 THEN 'top 1%' WHEN s <= 0.05 THEN 'top 5%' WHEN s <= 0.1 THEN 'top 10%' ELSE '' END AS band FROM (SELECT *, rank::DOUBLE / count(*) OVER () AS s FROM (SELECT name, degree, row_number() OVER (ORDER BY degree DESC, name) AS rank FROM dg))"),
    "supercategory_rollup": on(f"SELECT {_SUPER('entity_type')} AS super_category, entity_type, count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS ends, max(degree) AS most FROM dg GROUP BY 1, 2"),
    "category_pair_rollup": on(f"SELECT least(u, v) AS one, greatest(u, v) AS other, count(*) AS edges, CAST(sum(CAST(trunc(weight * 10) AS BIGINT)) AS BIGINT) / 10.0::DOUBLE AS weight FROM (SELECT {_SUPER('type_a')} AS u, {_SUPER('type_b')} AS v, weight FROM te) GROUP BY 1, 2"),
    "type_pair_rollup": on("SELECT least(type_a, type_b) AS one, greatest(type_a, type_b) AS other, count(*) AS edges, CAST(sum(CAST(trunc(weight * 10) AS BIGINT)) AS BIGINT) / 10.0::DOUBLE AS weight FROM te GROUP BY 1, 2"),
    "weight_bounds": on("SELECT COALESCE(max(weight), 1.0) AS most, COALESCE(min(weight), 1.0) AS least FROM ed"),
    "keyword_counts": on("SELECT * FROM kc"),
    "token_counts": on("SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, unnest(list_distinct(toks)) AS token FROM tk) GROUP BY 1"),
    "verb_harvest": on(f"SELECT 'pin' AS kind, keyword AS phrase, n FROM kc WHERE keyword IN {_PINNED} UNION ALL SELECT * FROM (SELECT 'content' AS kind, phrase, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, array_to_string(list_transform(toks, lambda t: {_STEM}), ' ') AS phrase FROM tk WHERE keyword NOT IN {_PINNED}) WHERE phrase <> '' GROUP BY 2 ORDER BY n DESC, phrase LIMIT 12)"),
    "edge_time_bounds": on(f"SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, CAST(min({_MONTH}) AS INTEGER) AS first, CAST(max({_MONTH}) AS INTEGER) AS last FROM rel JOIN tn ON tid = source_id WHERE src <> tgt AND created_at IS NOT NULL GROUP BY 1, 2"),
    "peak_quarter": on(f"SELECT name, quarter, n, total FROM (SELECT name, q AS quarter, n, CAST(sum(n) OVER (PARTITION BY name) AS BIGINT) AS total, count(*) OVER (PARTITION BY name) AS quarters, row_number() OVER (PARTITION BY name ORDER BY n DESC, q DESC) AS rn FROM (SELECT name, q, count(*) AS n FROM (SELECT src AS name, source_id FROM rel UNION ALL SELECT tgt, source_id FROM rel) JOIN (SELECT tid, (m // 12 + 2018) || '-Q' || ((m % 12) // 3 + 1) AS q FROM (SELECT tid, CAST({_MONTH} AS BIGINT) AS m FROM tn WHERE created_at IS NOT NULL)) ON tid = source_id GROUP BY 1, 2)) WHERE rn = 1 AND total >= 4 AND quarters > 1 AND n >= 3 AND n * 4 >= total"),
    "facet_leave_one_out": on("SELECT 'type' AS facet, entity_type AS value, count(*) AS n FROM dg WHERE degree >= 3 AND contains(lower(name), 'er') GROUP BY 2 UNION ALL SELECT 'degree', CAST(least(degree, 10) AS VARCHAR), count(*) FROM dg WHERE entity_type IN ('tag', 'user', 'place') AND contains(lower(name), 'er') GROUP BY 2"),
    "visible_edges": on("SELECT a, b, weight FROM ed WHERE weight >= 0.5 AND a IN (SELECT name FROM dg WHERE entity_type IN ('tag', 'topic') AND degree >= 4) AND b IN (SELECT name FROM dg WHERE entity_type IN ('tag', 'topic') AND degree >= 4)"),
    "category_stats": on(f"SELECT m.super_category, members, COALESCE(i, 0) AS inner_edges, COALESCE(o, 0) AS bridges FROM (SELECT {_SUPER('entity_type')} AS super_category, count(*) AS members FROM nd GROUP BY 1) m LEFT JOIN (SELECT u, count(*) AS i FROM (SELECT {_SUPER('type_a')} AS u, {_SUPER('type_b')} AS v FROM te) WHERE u = v GROUP BY 1) ON u = m.super_category LEFT JOIN (SELECT s, count(*) AS o FROM (SELECT unnest([{_SUPER('type_a')}, {_SUPER('type_b')}]) AS s FROM te WHERE {_SUPER('type_a')} <> {_SUPER('type_b')}) GROUP BY 1) ON s = m.super_category"),
    "pair_stats": on(f"SELECT a, b, weight, (SELECT count(*) FROM pr) AS edges, (SELECT CAST(sum(CAST(trunc(weight * 10) AS BIGINT)) AS BIGINT) / 10.0::DOUBLE FROM pr) AS total FROM pr ORDER BY weight DESC, a, b LIMIT 10", f"pr AS (SELECT a, b, weight FROM te WHERE least({_SUPER('type_a')}, {_SUPER('type_b')}) = 'Discussion' AND greatest({_SUPER('type_a')}, {_SUPER('type_b')}) = 'Structure')"),
    "cluster_stats": on("SELECT m.community, size, COALESCE(i, 0) AS inner_edges, COALESCE(o, 0) AS bridges FROM (SELECT entity_type AS community, count(*) AS size FROM nd GROUP BY 1) m LEFT JOIN (SELECT type_a AS c, count(*) AS i FROM te WHERE type_a = type_b GROUP BY 1) i ON i.c = m.community LEFT JOIN (SELECT c, count(*) AS o FROM (SELECT unnest([type_a, type_b]) AS c FROM te WHERE type_a <> type_b) GROUP BY 1) o ON o.c = m.community"),
    "node_table": on("SELECT name, dg.entity_type, degree, CASE WHEN length(description) > 240 THEN left(description, 240) || '...' ELSE description END AS description FROM dg JOIN nd USING (name) WHERE contains(lower(name), 'yard') OR contains(lower(dg.entity_type), 'yard') OR contains(lower(COALESCE(description, '')), 'yard') ORDER BY degree DESC, name LIMIT 500"),
    "connections": on(f"SELECT name, phrase, weight, entity_type FROM (SELECT CASE WHEN a = '{SEED}' THEN b ELSE a END AS name, trim(string_split(replace(keywords, '<SEP>', ','), ',')[1]) AS phrase, weight FROM ed WHERE a = '{SEED}' OR b = '{SEED}') JOIN nd USING (name) ORDER BY weight DESC, name LIMIT 500"),
    "edges_within": on(f"SELECT * FROM (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, CAST(min({_MONTH}) AS INTEGER) AS first, CAST(max({_MONTH}) AS INTEGER) AS last FROM rel JOIN tn ON tid = source_id WHERE src <> tgt AND created_at IS NOT NULL GROUP BY 1, 2) WHERE last >= 40 AND first <= 60"),
    "search_context": on("SELECT name, 'match' AS role FROM sm UNION ALL SELECT DISTINCT y, 'context' FROM adj JOIN sm ON x = sm.name JOIN nd ON nd.name = y WHERE entity_type IN ('tag', 'topic') AND y NOT IN (SELECT name FROM sm)", "sm AS (SELECT name FROM nd WHERE entity_type IN ('tag', 'topic') AND contains(lower(name), 'shader'))"),
    "topic_index": on("SELECT tn.topic_id, name AS title, COALESCE(tn.created_at, f.created_at) AS created_at, CASE WHEN length(x) > 240 THEN left(x, 240) || '...' ELSE x END AS excerpt, COALESCE(n, 0) AS posts FROM tn LEFT JOIN (SELECT topic_id, created_at, CASE WHEN length(plain_text) > 4000 THEN left(plain_text, 4000) || '...' ELSE plain_text END AS x, row_number() OVER (PARTITION BY topic_id ORDER BY post_number, post_id) AS rn, count(*) OVER (PARTITION BY topic_id) AS n FROM vp WHERE trim(plain_text) <> '') f ON f.topic_id = tn.topic_id AND rn = 1"),
    "first_mentions": on("SELECT a, value, min(place) AS place FROM (SELECT a, trim(v) AS value, CAST(i - 1 AS INTEGER) AS place FROM (SELECT a, unnest(string_split_regex(keywords, ',|<SEP>')) AS v, unnest(range(1, len(string_split_regex(keywords, ',|<SEP>')) + 1)) AS i FROM ed)) WHERE value <> '' GROUP BY 1, 2"),
    "neighbour_types": on(f"SELECT entity_type, count(*) AS n FROM adj JOIN nd ON nd.name = y WHERE x = '{SEED}' GROUP BY 1"),
    "provenance_rank": on(f"SELECT source_id, count(*) AS mentions FROM (SELECT source_id FROM ent WHERE entity_name = '{SEED}' UNION ALL SELECT source_id FROM rel WHERE src = '{SEED}' OR tgt = '{SEED}') GROUP BY 1 ORDER BY mentions DESC, source_id LIMIT 10"),
    "k_hop": on("SELECT * FROM l2", _levels(2)),
    "shortest_path_len": on("SELECT * FROM l6", _levels(6)),
    "ppr_top10": on(f"SELECT name, floor(p * 1e8 + 0.5) / 1e8 AS score FROM r30 WHERE name <> '{SEED}' ORDER BY score DESC, name LIMIT 10", _rank()),
    "canonical_map_case": on(f"SELECT old, canonical FROM (SELECT name AS old, first_value(name) OVER (PARTITION BY key ORDER BY is_seed DESC, {_FOLD('name')} <> name, lower(name) <> name, name) AS canonical FROM ck) WHERE old <> canonical", f"{_VARIANTS}, st AS (SELECT k, min(entity_type) AS kind FROM (SELECT DISTINCT lower(name) AS k, entity_type FROM va WHERE entity_type IN {_TYPES}) GROUP BY 1 HAVING count(*) = 1), mx AS (SELECT k FROM (SELECT DISTINCT lower(name) AS k, entity_type FROM va WHERE entity_type IN {_TYPES}) GROUP BY 1 HAVING count(*) > 1), ck AS (SELECT name, name IN (SELECT name FROM nd WHERE entity_type IN {_TYPES}) AS is_seed, CASE WHEN COALESCE(kind, entity_type) = 'tag' THEN 'tag:' || {_FOLD('lower(name)')} ELSE 'any:' || lower(name) END AS key FROM va LEFT JOIN st ON k = lower(name) WHERE lower(name) NOT IN (SELECT k FROM mx))"),
    "canonical_map_users": on(r"SELECT old, canonical FROM (SELECT name AS old, lower(regexp_replace(regexp_replace(regexp_replace(name, '^User\s+', ''), '\s+Person$', ''), '\s+', '', 'g')) AS k FROM va WHERE entity_type <> 'user') JOIN (SELECT lower(name) AS k, min(name) AS canonical FROM va WHERE entity_type = 'user' GROUP BY 1) USING (k) WHERE old <> canonical", _VARIANTS),
    "topic_document": on(_DOCUMENT),
    "chunk_split": on(_CHUNKS),
    "stale_edges": on("SELECT DISTINCT src, tgt FROM rel WHERE (src, tgt) NOT IN (SELECT (src, tgt) FROM rel1)", _EARLIER),
    "orphans": on(f"SELECT name, entity_type FROM nd WHERE entity_type IN {_TYPES} AND name NOT IN (SELECT src FROM rel1 WHERE src <> tgt UNION ALL SELECT tgt FROM rel1 WHERE src <> tgt)", _EARLIER),
    "pass1_plan": on(f"SELECT topic_id, {_ACTION} AS action FROM tn {_LEDGERS}", _EARLIER),
    "kg_sync": on(f"SELECT topic_id, {_ACTION} AS action FROM tn {_LEDGERS}", _EARLIER),
    "type_reassertion": on("SELECT name, entity_type, CASE WHEN now IS NULL THEN 'missing' WHEN now = entity_type THEN 'keep' ELSE 'write' END AS action FROM tr LEFT JOIN cl USING (name)", _CLAIMED),
    "retyped_nodes": on("SELECT name, COALESCE(t, now) AS entity_type FROM cl LEFT JOIN (SELECT name, max(entity_type) AS t FROM tr JOIN cl USING (name) WHERE now <> entity_type GROUP BY 1) USING (name)", _CLAIMED),
    "index_verification": on("SELECT s.entity_type, COALESCE(in_graph, 0) AS in_graph, in_source, greatest(in_source - COALESCE(in_graph, 0), 0) AS missing FROM (SELECT entity_type, count(*) AS in_source FROM tr GROUP BY 1) s LEFT JOIN (SELECT entity_type, count(*) AS in_graph FROM nd GROUP BY 1) g USING (entity_type)", _CLAIMED),
    "buffered_writes": on("SELECT name, entity_type, sources FROM nd"),
    "title_dedupe": on("SELECT id, CASE WHEN n > 1 THEN title || ' (' || n || ')' ELSE title END AS title FROM (SELECT id, title, row_number() OVER (PARTITION BY title ORDER BY id) AS n FROM t0 WHERE title IS NOT NULL)"),
    "components": on("SELECT name, COALESCE(c, name) AS component FROM nd LEFT JOIN (SELECT x, least(x, min(c)) AS c FROM cc GROUP BY 1) ON x = name", "cc AS (SELECT DISTINCT x, y AS c FROM reach)", recursive="reach(x, y) AS (SELECT x, y FROM adj UNION SELECT r.x, a.y FROM reach r JOIN adj a ON a.x = r.y)"),
    "articulation": on("SELECT DISTINCT m.v AS name FROM many m JOIN adj ON adj.x = m.v WHERE (m.v, adj.y) NOT IN (SELECT v, y FROM past)", recursive="many AS (SELECT x AS v, min(y) AS s FROM adj WHERE x <> y GROUP BY 1 HAVING count(*) > 1), past(v, y) AS (SELECT v, s FROM many UNION SELECT p.v, a.y FROM past p JOIN adj a ON a.x = p.y AND a.y <> p.v)"),
    "shortest_path_len": on("SELECT name, hops FROM bf", recursive=f"bf(name, hops) USING KEY (name) AS (SELECT x, 0 FROM (SELECT DISTINCT x FROM adj WHERE x = '{SEED}') UNION SELECT y, min(hops) + 1 FROM bf JOIN adj ON x = bf.name WHERE y NOT IN (SELECT name FROM recurring.bf) GROUP BY 1)"),
    "k_shortest": on("SELECT CAST(n - 1 AS INTEGER) AS path_no, CAST(len(path) - 1 AS INTEGER) AS hops, path AS nodes FROM kp", _PATHS[1], recursive=_PATHS[0]),
    "path_highlight": on("SELECT name, CAST(min(n) - 1 AS INTEGER) AS path_no FROM (SELECT n, unnest(path) AS name FROM kp) GROUP BY 1", _PATHS[1], recursive=_PATHS[0]),
    "token_clusters": on("SELECT keyword, bucket, bucket_name, n FROM tb", _BUCKETS[1], recursive=_BUCKETS[0]),
    "edge_buckets": on("SELECT a, b, weight, bucket FROM ce", _BUCKETS[1], recursive=_BUCKETS[0]),
    "bucket_coverage": on("SELECT bucket, count(*) AS edges, (SELECT floor(count_if(bucket >= 0) * 1000.0::DOUBLE / count(*) + 0.5) / 10.0::DOUBLE FROM ce) AS coverage FROM ce GROUP BY 1", _BUCKETS[1], recursive=_BUCKETS[0]),
    "graph_signature": on("SELECT 'sha256:' || sha256(string_agg(d, '' ORDER BY p)) AS signature, (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges FROM (SELECT left(h, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d FROM (SELECT sha256('n' || name) AS h FROM nd UNION ALL SELECT sha256('e' || a || chr(31) || b) FROM ed) GROUP BY 1)"),
    "chunk_names": on(f"SELECT topic_id, chunk_no, CASE WHEN chunk_no = 0 THEN 'topic-' || topic_id ELSE 'topic-' || topic_id || '-p' || chunk_no END AS source_id FROM ({_CHUNKS})"),
    "reply_clock": on("SELECT topic_id, post_id, post_number, CAST(sum(COALESCE(gap, 0)) OVER (PARTITION BY topic_id ORDER BY post_number, post_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS minutes FROM (SELECT topic_id, post_id, post_number, CAST(trunc((epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY topic_id ORDER BY post_number, post_id))) / 60000000) AS BIGINT) AS gap FROM vp)"),
}
