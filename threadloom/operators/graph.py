"""Graph analytics over nodes (name, entity_type, ...) and undirected edges (a, b, weight, keywords, ...), a < b.

Iterations keep a table of nodes that is written to the shared folder every few rounds, so no plan grows with their
number. Adjacency is read by hash partition of the node, never gathered.
"""

from __future__ import annotations

import heapq

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize, numbered
from .kg import PIN_KEYWORDS, PINS, STRUCTURAL

# Super-categories by entity type; every other type is Other.
SUPER = {"category": "Structure", "tag": "Structure", "topic": "Discussion", "user": "People", "place": "Places"}
#: Rounds between two writes of an iteration.
ROUNDS = 4


def super_category(kind: Column) -> Column:
    """The super-category of a type, case and blanks ignored."""
    low = F.lower(F.trim(kind))
    out = F.lit("Other")
    for k, v in SUPER.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """x, y, weight in both directions."""
    return edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, entity_type, degree; a node without edges has none, a loop counts twice."""
    d = edges.select(F.col("a").alias("name")).unionAll(edges.select(F.col("b").alias("name"))).groupBy("name").agg(F.count("*").alias("degree"))
    return nodes.select("name", "entity_type").join(d, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("entity_type").agg(F.count("*").alias("n"), F.max(F.col("entity_type").isin(*STRUCTURAL)).alias("structural"))


def out_of_vocabulary(nodes: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """Nodes of each type that the vocabulary lacks, case ignored."""
    return nodes.where(~F.lower("entity_type").isin(*[v.lower() for v in vocabulary])).groupBy("entity_type").agg(F.count("*").alias("n"))


def hubs(nodes: DataFrame, edges: DataFrame, n: int = 15, structural: bool = True) -> DataFrame:
    """The n nodes of most edges."""
    d = degrees(nodes, edges)
    return (d if structural else d.where(~F.col("entity_type").isin(*STRUCTURAL))).orderBy(F.desc("degree"), "name").limit(n)


def rank_bands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, degree, rank and whether it is among the first hundredth, twentieth or tenth."""
    ranked = numbered(degrees(nodes, edges), F.desc("degree"), F.asc("name"), name="rank")
    share = F.col("rank") / F.lit(ranked.count())
    return ranked.select("name", "degree", "rank", F.when(share <= 0.01, "top 1%").when(share <= 0.05, "top 5%").when(share <= 0.1, "top 10%").otherwise("").alias("band"))


def node_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edge ends by super-category and type."""
    d = degrees(nodes, edges).withColumn("super_category", super_category(F.col("entity_type")))
    return d.groupBy("super_category", "entity_type").agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"), F.max("degree").alias("most"))


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the types of their ends."""
    n = nodes.select("name", "entity_type")
    left, right = n.toDF("a", "type_a"), n.toDF("b", "type_b")
    return edges.join(left, "a").join(right, "b")


def pair_rollup(nodes: DataFrame, edges: DataFrame, by_type: bool = False) -> DataFrame:
    """Edges between two super-categories (or types), whichever way: count and weight."""
    e = typed_edges(nodes, edges)
    u, v = (F.col("type_a"), F.col("type_b")) if by_type else (super_category(F.col("type_a")), super_category(F.col("type_b")))
    return e.groupBy(F.least(u, v).alias("one"), F.greatest(u, v).alias("other")).agg(F.count("*").alias("edges"), (F.sum((F.col("weight") * 10).cast("long")) / 10.0).alias("weight"))


def weight_bounds(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("most"), F.coalesce(F.min("weight"), F.lit(1.0)).alias("least"))


def signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """signature, nodes, edges: a SHA-256 of the graph's structure (names and ends, no attributes), in whatever order it comes.

    Digests of nodes and edges are hashed by their first three hex digits and those 4096 digests once more, so that no task
    takes more than a share of them.
    """
    digests = nodes.select(F.sha2(F.concat(F.lit("n"), "name"), 256).alias("h"), F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.sha2(F.concat(F.lit("e"), "a", F.lit("\x1f"), "b"), 256), F.lit(0), F.lit(1)))
    parts = digests.groupBy(F.left("h", F.lit(3)).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "")
    return parts.agg(F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("signature"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


# ---- Keywords and buckets --------------------------------------------------------------------------------------------


def edge_keywords(edges: DataFrame) -> DataFrame:
    """a, b, keyword: the keywords of each edge, small, each as often as it stands there."""
    words = F.split(F.replace(F.col("keywords"), F.lit("<SEP>"), F.lit(",")), ",")
    return edges.select("a", "b", F.explode(words).alias("k")).select("a", "b", F.lower(F.trim("k")).alias("keyword")).where("keyword <> ''")


def keyword_counts(edges: DataFrame) -> DataFrame:
    return edge_keywords(edges).groupBy("keyword").agg(F.count("*").alias("n"))


def token_counts(counts: DataFrame) -> DataFrame:
    """Occurrences of each token: a keyword adds its own once for each different token."""
    return counts.select("n", F.explode(F.array_distinct(X.tokens(F.col("keyword")))).alias("token")).groupBy("token").agg(F.sum("n").alias("n"))


def verb_harvest(counts: DataFrame, top: int = 12) -> DataFrame:
    """Pinned keywords, and the most frequent stemmed phrases of the others."""
    pinned = F.col("keyword").isin(*PIN_KEYWORDS)
    phrase = F.array_join(F.transform(X.tokens(F.col("keyword")), X.stem), " ")
    pins = counts.where(pinned).select(F.lit("pin").alias("kind"), F.col("keyword").alias("phrase"), "n")
    content = counts.where(~pinned).select(phrase.alias("phrase"), "n").where("phrase <> ''").groupBy("phrase").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "phrase").limit(top)
    return pins.unionByName(content.select(F.lit("content").alias("kind"), "phrase", "n"))


def _touches(toks: Column, seed: str) -> Column:
    """Whether a token holds the seed or is held by it."""
    return F.exists(toks, lambda t: t.contains(seed) | F.contains(F.lit(seed), t))


def token_buckets(counts: DataFrame, n: int = 12) -> DataFrame:
    """keyword, bucket, bucket_name: discoverable keywords routed to n seed tokens.

    Seeds are the most frequent tokens of which none holds another; a keyword goes to the first seed that one of its
    tokens equals, holds or is held by; buckets are numbered by size. Only heads of the ranking, 4 n words, reach the driver;
    what the seeds so far rule out is filtered before the next head is taken.
    """
    free = counts.where(~F.col("keyword").isin(*PIN_KEYWORDS))
    left = materialize(token_counts(free), "tokens")
    seeds: list[str] = []
    while len(seeds) < n and (head := left.orderBy(F.desc("n"), "token").limit(4 * n).collect()):
        for t in (r.token for r in head):
            if len(seeds) < n and not any(t in s or s in t for s in seeds):
                seeds.append(t)
        for s in seeds:  # what a seed holds or is held by is out of the ranking, so each head is of new candidates
            left = left.where(~(F.col("token").contains(s) | F.contains(F.lit(s), F.col("token"))))
    found = F.lit(None).cast("int")
    toks = X.tokens(F.col("keyword"))
    for i, seed in reversed([*enumerate(seeds)]):
        found = F.when(_touches(toks, seed), i).otherwise(found)
    routed = free.select("keyword", "n", found.alias("seed")).where("seed IS NOT NULL")
    sizes = routed.groupBy("seed").agg(F.sum("n").alias("size"))
    order = sizes.withColumn("bucket", F.row_number().over(Window.orderBy(F.desc("size"), "seed")) - 1)  # n rows
    name = F.element_at(F.array(*[F.lit(s.capitalize()) for s in seeds] or [F.lit("")]), F.col("seed") + 1)
    return routed.join(order, "seed").select("keyword", "bucket", name.alias("bucket_name"), "n")


def classified_edges(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """a, b, bucket: the bucket of most of an edge's keywords (of equal ones the first), Other (-1) without any; pins come first."""
    pins = edges.sparkSession.createDataFrame(list(PIN_KEYWORDS.items()), "keyword string, i int")
    index = pins.unionByName(buckets.where(~F.col("keyword").isin(*PIN_KEYWORDS)).select("keyword", (F.col("bucket") + len(PINS)).cast("int").alias("i")))
    votes = edge_keywords(edges).join(index, "keyword").groupBy("a", "b", "i").agg(F.count("*").alias("v"))
    best = votes.groupBy("a", "b").agg(F.min_by("i", F.struct((-F.col("v")).alias("v"), "i")).alias("bucket"))
    return edges.select("a", "b", "weight").join(best, ["a", "b"], "left").withColumn("bucket", F.coalesce("bucket", F.lit(-1)))


def bucket_coverage(classified: DataFrame) -> DataFrame:
    """Edges by bucket, and the share of all that have one."""
    counts = classified.groupBy("bucket").agg(F.count("*").alias("edges"))
    total = classified.agg(F.count("*").alias("t"), F.count_if(F.col("bucket") >= 0).alias("c"))
    return counts.crossJoin(F.broadcast(total)).select("bucket", "edges", (F.floor(F.col("c") * 1000.0 / F.col("t") + 0.5) / 10.0).alias("coverage"))  # total is one row


# ---- Time ------------------------------------------------------------------------------------------------------------


def edge_times(relations: DataFrame, topics: DataFrame) -> DataFrame:
    """a, b, first, last: month bins of the topics each edge is from."""
    t = topics.select(F.col("tid").alias("source_id"), X.month_bin(F.col("created_at")).alias("m"))
    pairs = relations.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "source_id").where("a <> b")
    return pairs.join(t, "source_id").where("m IS NOT NULL").groupBy("a", "b").agg(F.min("m").alias("first"), F.max("m").alias("last"))


def peak_quarters(relations: DataFrame, topics: DataFrame) -> DataFrame:
    """Of each node with four dated relations in several quarters the quarter that has at least three and a quarter of them."""
    t = topics.select(F.col("tid").alias("source_id"), X.quarter_of_bin(X.month_bin(F.col("created_at"))).alias("q"))
    ends = relations.select(F.col("src").alias("name"), "source_id").unionAll(relations.select(F.col("tgt").alias("name"), "source_id"))
    counts = ends.join(t, "source_id").where("q IS NOT NULL").groupBy("name", "q").agg(F.count("*").alias("n"))
    best = counts.groupBy("name").agg(F.sum("n").alias("total"), F.count("*").alias("quarters"), F.max_by(F.struct("n", "q"), F.struct("n", "q")).alias("b"))
    return best.where("total >= 4 AND quarters > 1 AND b.n >= 3 AND b.n * 4 >= total").select("name", F.col("b.q").alias("quarter"), F.col("b.n").alias("n"), "total")


# ---- Facets and panels -----------------------------------------------------------------------------------------------


def leave_one_out(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], least: int, term: str) -> DataFrame:
    """facet, value, n: for each value of a facet, how many nodes pass all the other filters (type, degree, text); one pass."""
    d = degrees(nodes, edges)
    of_kind, of_degree, of_text = F.col("entity_type").isin(*kinds), F.col("degree") >= least, F.lower("name").contains(term.lower())
    flags = d.select("entity_type", F.least("degree", F.lit(10)).alias("degree"), (of_degree & of_text).alias("t"), (of_kind & of_text).alias("d"))
    rows = flags.select(F.explode(F.array(F.when(F.col("t"), F.struct(F.lit("type").alias("facet"), F.col("entity_type").alias("value"))), F.when(F.col("d"), F.struct(F.lit("degree").alias("facet"), F.col("degree").cast("string").alias("value"))))).alias("f"))
    return rows.where("f IS NOT NULL").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def visible_edges(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], least_degree: int, least_weight: float) -> DataFrame:
    """Edges of some weight whose ends both pass the node filter; degrees are those of the whole graph."""
    seen = degrees(nodes, edges).where(F.col("entity_type").isin(*kinds) & (F.col("degree") >= least_degree)).select("name")
    e = edges.where(F.col("weight") >= least_weight)
    return e.join(seen.withColumnRenamed("name", "a"), "a", "left_semi").join(seen.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b", "weight")


def category_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each super-category: members, edges within it and bridges to others."""
    e = typed_edges(nodes, edges).select(super_category(F.col("type_a")).alias("u"), super_category(F.col("type_b")).alias("v"))
    inner = e.where("u = v").groupBy(F.col("u").alias("super_category")).agg(F.count("*").alias("inner_edges"))
    ends = e.where("u <> v").select(F.explode(F.array("u", "v")).alias("super_category")).groupBy("super_category").agg(F.count("*").alias("bridges"))
    members = nodes.groupBy(super_category(F.col("entity_type")).alias("super_category")).agg(F.count("*").alias("members"))
    j = members.join(inner, "super_category", "left").join(ends, "super_category", "left")
    return j.select("super_category", "members", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), F.coalesce("bridges", F.lit(0)).alias("bridges"))


def pair_stats(nodes: DataFrame, edges: DataFrame, one: str, other: str) -> DataFrame:
    """The ten heaviest edges between two super-categories, each with the count and sum of all of them."""
    e = typed_edges(nodes, edges)
    u, v = super_category(F.col("type_a")), super_category(F.col("type_b"))
    low, high = sorted((one, other))
    kept = e.where((F.least(u, v) == low) & (F.greatest(u, v) == high)).select("a", "b", "weight")
    total = kept.agg(F.count("*").alias("edges"), F.sum((F.col("weight") * 10).cast("long")).alias("tenths"))
    top = kept.orderBy(F.desc("weight"), "a", "b").limit(10)
    return top.crossJoin(F.broadcast(total)).select("a", "b", "weight", "edges", (F.col("tenths") / 10.0).alias("total"))  # total is one row


def cluster_stats(member: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each cluster (name, community): size, edges within it, bridges to others."""
    m = member.select("name", "community")
    e = edges.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").select("ca", "cb")
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner_edges"))
    bridges = e.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("bridges"))
    j = m.groupBy("community").agg(F.count("*").alias("size")).join(inner, "community", "left").join(bridges, "community", "left")
    return j.select("community", "size", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), F.coalesce("bridges", F.lit(0)).alias("bridges"))


def neighbour_types(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Types of a node's neighbours."""
    near = adjacency(edges).where(F.col("x") == name).select(F.col("y").alias("name"))
    return near.join(nodes.select("name", "entity_type"), "name").groupBy("entity_type").agg(F.count("*").alias("n"))


def provenance(entities: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """Topics that a node or its relations are from, those with most mentions first."""
    own = entities.where(F.col("entity_name") == name).select("source_id")
    near = relations.where((F.col("src") == name) | (F.col("tgt") == name)).select("source_id")
    return own.unionAll(near).groupBy("source_id").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "source_id").limit(10)


# ---- Paths and iterations --------------------------------------------------------------------------------------------


def levels(edges: DataFrame, start: str, most: int | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """name, hops: nodes that a start leads to past none of the blocked ones, and how far they are; within `most` hops if that is given.

    Each round joins the frontier alone and writes it; the nodes seen so far are the frontiers so far, of which a node's
    neighbours can only be in the last two.
    """
    adj = adjacency(edges.where(~F.col("a").isin(*blocked) & ~F.col("b").isin(*blocked)) if blocked else edges).select("x", "y")
    parts = [materialize(adj.where(F.col("x") == start).select(F.col("x").alias("name"), F.lit(0).alias("hops")).distinct(), "levels")]
    while most is None or len(parts) <= most:
        near = adj.join(parts[-1].select(F.col("name").alias("x")), "x").select(F.col("y").alias("name")).distinct()
        for p in parts[-2:]:
            near = near.join(p, "name", "left_anti")
        new = materialize(near.select("name", F.lit(len(parts)).alias("hops")), "levels")
        if new.isEmpty():
            break
        parts.append(new)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def shortest_paths(edges: DataFrame, start: str, goal: str, k: int = 3) -> list[list[str]]:
    """Up to k simple paths, shortest first, equal ones by name, however long they are.

    Distances to the goal are found level by level. Paths grow from the start, the one of least hops so far and to go first;
    the unfinished ones are a table, of which each step reads the least row and adds that node's neighbours. Nothing but the
    paths taken up reaches the driver, about k times as many as a path has nodes.
    """
    back = levels(edges, goal)
    first = back.where(F.col("name") == start).first()
    if first is None:
        return []
    adj = materialize(adjacency(edges).where("x <> y").select("x", "y").distinct().join(back.select(F.col("name").alias("y"), F.col("hops").alias("rest")), "y"), "links")
    unfinished = edges.sparkSession.createDataFrame([([start], first.hops)], "path array<string>, total int")
    found: list[list[str]] = []
    while len(found) < k and (least := unfinished.orderBy("total", "path").first()):
        path = least.path
        unfinished = unfinished.where(F.col("path") != F.array(*map(F.lit, path)))
        if path[-1] == goal:
            found.append(path)
            continue
        new = adj.where((F.col("x") == path[-1]) & ~F.col("y").isin(*path)).select(F.concat(F.array(*map(F.lit, path)), F.array("y")).alias("path"), (F.col("rest") + len(path)).alias("total"))
        unfinished = materialize(unfinished.unionByName(new), "unfinished")
    return found


def pagerank(edges: DataFrame, seed: str, rounds: int = 30, restart: float = 0.15) -> DataFrame:
    """name, score of a personalised PageRank; each round gives the seed `restart` and every node its neighbours' shares.

    Links are parted by the node they leave once and kept so; a round moves the ranks alone.
    """
    adj = adjacency(edges).select("x", "y")
    out = adj.groupBy("x").agg(F.count("*").alias("d"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = materialize(adj.join(out, "x"), "links").repartition(parts, "x").persist(StorageLevel.MEMORY_AND_DISK)  # lost parts are read again from what was written
    rank = links.where(F.col("x") == seed).select(F.col("x").alias("name"), F.lit(1.0).alias("p")).distinct()
    home = rank.select("name", F.lit(restart).alias("p"))
    for i in range(rounds):
        shares = links.join(rank, links["x"] == rank["name"]).select(F.col("y").alias("name"), (F.col("p") / F.col("d") * (1 - restart)).alias("p"))
        rank = shares.unionByName(home).groupBy("name").agg(F.sum("p").alias("p"))
        if i % ROUNDS == ROUNDS - 1 or i == rounds - 1:
            rank = materialize(rank, "rank")
    links.unpersist()
    return rank.select("name", (F.floor(F.col("p") * 1e8 + 0.5) / 1e8).alias("score"))


def _fingerprint(pairs: DataFrame) -> tuple:
    """Number of pairs and two sums over their hashes, which differ if the pairs do."""
    wide = "decimal(38,0)"
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast(wide)), F.sum(F.xxhash64("v", F.lit(7), "u").cast(wide))).first())


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """name, component: the least name of a node's connected component.

    Alternating large-star and small-star steps halve the height of the label trees, so the number of rounds grows with
    the logarithm of the diameter; labels stay in tables. A round that changes no pair is the last; that is told by a
    fingerprint of the pairs, one aggregate a round.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = _fingerprint(pairs)
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs = materialize(small, "stars")
        if (now := _fingerprint(pairs)) == before:
            break
        before = now
    found = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("name"), "component")
    roots = found.select(F.col("component").alias("name"), "component").distinct()
    labelled = found.unionByName(roots)
    if nodes is None:
        return labelled
    return nodes.select("name").distinct().join(labelled, "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def spanning_forest(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges of a forest that spans every component, and (name, root) of its nodes; adj has x, y in both directions.

    Each round every component takes its least edge to another one, in an order all edges share, so that what is taken holds
    no cycle; components at least halve a round, and pointers to those they join are shortened by doubling.
    """
    edges = materialize(adj.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.xxhash64("x", "y").alias("h")), "forest")
    member = materialize(adj.select(F.col("x").alias("name")).distinct().withColumn("root", F.col("name")), "member")
    taken = None
    while True:
        both = edges.join(member.toDF("a", "ra"), "a").join(member.toDF("b", "rb"), "b").where("ra <> rb")
        key = F.struct("h", "a", "b")
        sides = both.select(F.col("ra").alias("c"), F.col("rb").alias("d"), key.alias("k")).unionAll(both.select("rb", "ra", key))
        best = materialize(sides.groupBy("c").agg(F.min(F.struct("k", "d")).alias("m")).select("c", "m.d", "m.k.a", "m.k.b"), "best")
        if best.isEmpty():
            break
        new = best.select("a", "b").distinct()
        taken = new if taken is None else taken.unionByName(new)
        mutual = best.select(F.col("d").alias("c"), F.col("c").alias("d"), F.lit(True).alias("mutual"))
        up = best.select("c", "d").join(mutual, ["c", "d"], "left").select("c", F.when(F.col("mutual") & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("p"))
        while True:
            up = materialize(up, "up")
            further = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved"))
            further = materialize(further, "up")
            up = further.select("c", "p")
            if further.where("moved").isEmpty():
                break
        member = materialize(member.join(up.toDF("root", "top"), "root", "left").select("name", F.coalesce("top", "root").alias("root")), "member")
    return (edges.select("a", "b").limit(0) if taken is None else materialize(taken.distinct(), "forest")), member


def rooted(forest: DataFrame, member: DataFrame) -> DataFrame:
    """name, parent, root, size, pre of a forest's nodes: numbered in preorder (all trees on one line), with the size of the subtree below each.

    An Euler tour is ranked by doubling, so the number of rounds is the logarithm of its length, whatever the depth.
    """
    arcs = forest.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(forest.select("b", "a"))
    arcs = materialize(numbered(arcs, F.asc("x"), F.asc("y"), name="i"), "arcs")
    ends = arcs.groupBy("x").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    back = arcs.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("i").alias("r"))
    start = member.where("name = root").select(F.col("name").alias("x")).join(ends, "x").select(F.col("first").alias("s"), F.lit(True).alias("start"))
    linked = arcs.join(back, ["x", "y"]).join(ends.withColumnRenamed("x", "y"), "y").select("x", "y", "i", "r", F.when(F.col("r") == F.col("last"), F.col("first")).otherwise(F.col("r") + 1).alias("s"))
    linked = linked.join(start, "s", "left").select("x", "y", "i", "r", F.when(F.col("start").isNull(), F.col("s")).alias("s"))
    linked = materialize(linked, "tour")
    rank = linked.select("i", "s", F.lit(1).cast("long").alias("d"))  # d: arcs from here to where s is
    while not rank.where("s IS NOT NULL").isEmpty():
        ahead = rank.select(F.col("i").alias("s"), F.col("s").alias("s2"), F.col("d").alias("d2"))
        rank = materialize(rank.join(ahead, "s", "left").select("i", F.col("s2").alias("s"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")), "rank")
    placed = linked.join(rank.select("i", "d"), "i").join(rank.select(F.col("i").alias("r"), F.col("d").alias("rd")), "r")
    down = placed.where("d > rd").select(F.col("y").alias("name"), F.col("x").alias("parent"), "d", ((F.col("d") - F.col("rd") + 1) / 2).cast("long").alias("size"))
    trees = member.groupBy("root").agg(F.count("*").alias("n"))
    roots = trees.select(F.col("root").alias("name"), F.lit(None).cast("string").alias("parent"), (F.col("n") * 2).alias("d"), F.col("n").alias("size"))
    nodes = down.unionByName(roots).join(member, "name")
    return materialize(numbered(nodes, F.asc("root"), F.desc("d"), name="pre").drop("d"), "rooted")


def subtree_bounds(nodes: DataFrame) -> DataFrame:
    """name, low, high: least lo and greatest hi in the subtree of each of the nodes (name, pre, size, lo, hi).

    A subtree is a stretch of preorder numbers, so two overlapping blocks of a power of two cover it; blocks are doubled as
    often as the largest subtree needs.
    """
    block = materialize(nodes.select("pre", "lo", "hi"), "blocks")
    asked = materialize(nodes.select("name", "pre", "size", F.floor(F.log2("size") + 1e-9).cast("int").alias("k")), "asked")
    found, k = None, 0
    top = asked.agg(F.max("k")).first()[0]
    while top is not None and k <= top:
        q = asked.where(F.col("k") == k)
        ends = q.select("name", F.explode(F.array("pre", F.col("pre") + F.col("size") - (1 << k))).alias("pre"))
        part = ends.join(block, "pre").groupBy("name").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
        found = part if found is None else found.unionByName(part)
        if k < top:
            ahead = block.select((F.col("pre") - (1 << k)).alias("pre"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            block = materialize(block.join(ahead, "pre", "left").select("pre", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")), "blocks")
        k += 1
    return nodes.select("name", F.col("lo").alias("low"), F.col("hi").alias("high")) if found is None else materialize(found, "bounds")


def articulation_points(edges: DataFrame) -> DataFrame:
    """name of every node whose removal disconnects its component, without gathering a component.

    A spanning forest is numbered in preorder; the least and greatest numbers that a subtree's other edges reach decide which
    tree edges belong to one block; a node on tree edges of several blocks is one. Every step takes rounds by the logarithm of
    the number of nodes: a chain needs no more than a star.
    """
    adj = materialize(adjacency(edges).where("x <> y").select("x", "y").distinct(), "adj")
    t = rooted(*spanning_forest(adj))
    pre = t.select("name", "pre")
    pairs = adj.join(pre.toDF("x", "px"), "x").join(pre.toDF("y", "py"), "y")
    own = t.select(F.col("name").alias("x"), "parent")
    other = pairs.join(own, "x").join(own.toDF("y", "parent_y"), "y").where("(parent IS NULL OR parent <> y) AND (parent_y IS NULL OR parent_y <> x)").select("x", "y", "px", "py")
    other = materialize(other, "other")
    reach = other.groupBy(F.col("x").alias("name")).agg(F.min("py").alias("lo"), F.max("py").alias("hi"))
    base = t.join(reach, "name", "left").select("name", "pre", "size", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
    full = t.join(subtree_bounds(base), "name")
    up = t.select(F.col("name").alias("parent"), F.col("pre").alias("ppre"), F.col("size").alias("psize"), F.col("parent").alias("grand"))
    vertical = full.where("parent IS NOT NULL").join(up, "parent").where("grand IS NOT NULL AND (low < ppre OR high >= ppre + psize)").select(F.col("name").alias("a"), F.col("parent").alias("b"))
    sizes = t.select(F.col("name").alias("x"), "size")
    across = other.join(sizes, "x").where("px + size <= py").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = vertical.unionByName(across)
    edge_of = t.where("parent IS NOT NULL").select("name")
    block = components(links, edge_of)
    at = t.where("parent IS NOT NULL").join(block, "name").select("name", "parent", "component")
    ends = at.select("name", "component").unionByName(at.select(F.col("parent").alias("name"), "component"))
    return ends.distinct().groupBy("name").agg(F.count("*").alias("blocks")).where("blocks > 1").select("name")


#: Least gain in modularity for which two more rounds of moves are made.
GAIN = 1e-6


def _moved(adj: DataFrame, strength: DataFrame, total: float) -> DataFrame:
    """name, community after moves of single nodes (x, y, weight) until they no longer raise the modularity.

    Each round half of the nodes move, those whose name hashes to the round's parity, so that neighbours don't swap; what a
    round needs of a community is its total degree. The result depends on the names alone.
    """
    member = materialize(strength.select("name", F.col("name").alias("community")), "member")
    best, best_quality, r = member, -1.0, 0
    while True:
        tot = member.join(strength, "name").groupBy("community").agg(F.sum("k").alias("tot"))
        near = adj.where("x <> y").join(member.select(F.col("name").alias("y"), "community"), "y").groupBy(F.col("x").alias("name"), "community").agg(F.sum("weight").alias("w"))
        own = member.withColumn("w", F.lit(0.0)).select("name", "community", "w")
        options = near.unionByName(own).groupBy("name", "community").agg(F.sum("w").alias("w")).join(tot, "community").join(strength, "name").join(member.select("name", F.col("community").alias("now")), "name")
        rest = F.col("tot") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * rest / total, 9)
        chosen = options.withColumn("gain", gain).groupBy("name").agg(F.max_by("community", F.struct("gain", (F.col("community") == F.col("now")).alias("stay"), "community")).alias("best"), F.max("now").alias("now"))
        moves = (F.abs(F.hash("name")) % 2) == r % 2
        new = materialize(chosen.select("name", F.when(moves, F.col("best")).otherwise(F.col("now")).alias("community"), (moves & (F.col("best") != F.col("now"))).alias("moved")), "member")
        member = new.select("name", "community")
        r += 1
        if r % 2 == 0:
            quality = _quality(member, adj, total)
            if quality > best_quality + GAIN:
                best, best_quality = member, quality
            else:
                return best if best_quality > quality else member


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, community, size: Louvain's communities, numbered by size.

    Nodes move to the neighbouring community of greatest modularity gain until that gains no more; communities then are
    nodes of a smaller graph, and so on until none of them moves.
    """
    adj = materialize(adjacency(edges), "adj")
    total = adj.agg(F.sum("weight").alias("m2")).first().m2 or 1.0
    held = materialize(adj.select(F.col("x").alias("name")).distinct().withColumn("top", F.col("name")), "held")
    while True:
        strength = materialize(adj.groupBy(F.col("x").alias("name")).agg(F.sum("weight").alias("k")), "strength")
        member = _moved(adj, strength, total)
        if member.where("name <> community").isEmpty():
            break
        held = materialize(held.join(member.toDF("top", "community"), "top").select("name", F.col("community").alias("top")), "held")
        m = member.select("name", "community")
        adj = materialize(adj.join(m.toDF("x", "cx"), "x").join(m.toDF("y", "cy"), "y").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("weight").alias("weight")), "adj")
        if member.select("community").distinct().count() == member.count():
            break
    every = nodes.select("name").distinct().join(held, "name", "left").select("name", F.coalesce("top", "name").alias("community"))
    sizes = every.groupBy("community").agg(F.count("*").alias("size"))
    place = numbered(sizes, F.desc("size"), F.asc("community"))
    return every.join(place, "community").select("name", F.col("number").alias("community"), "size")


def _quality(member: DataFrame, adj: DataFrame, total: float) -> float:
    """Modularity of a partition (name, community) of edges in both directions."""
    m = member.select("name", "community")
    both = adj.join(m.toDF("x", "cx"), "x").join(m.toDF("y", "cy"), "y")
    inner = both.agg(F.sum(F.when(F.col("cx") == F.col("cy"), F.col("weight")).otherwise(0.0))).first()[0] or 0.0
    tot = adj.join(m.toDF("x", "c"), "x").groupBy("c").agg(F.sum("weight").alias("t")).agg(F.sum((F.col("t") / total) ** 2)).first()[0] or 0.0
    return inner / total - tot


def modularity(member: DataFrame, edges: DataFrame) -> float:
    """Modularity of a partition (name, community)."""
    adj = adjacency(edges)
    return _quality(member, adj, adj.agg(F.sum("weight")).first()[0] or 1.0)
