"""The knowledge graph: structural facts of topics, merging, canonical names and incremental plans.

Everything is a projection, a union, an aggregate or a join; a pass over the corpus costs one scan of topics and posts,
whatever changed. Null and blank names form no entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tags import stripped, tag_display
from ..session import numbered
from .views import Corpus

# The three structural relations, their weights and keywords.
PINS = {
    "user_posted": ("Posted", "posted, authored, participated", 0.5),
    "topic_tagged": ("Tagged", "tagged, tag, labeled", 0.8),
    "topic_in_category": ("Categorized", "posted in, category, section", 1.0),
}
PIN_KEYWORDS = {k: i for i, (_, words, _) in enumerate(PINS.values()) for k in words.split(", ")}
STRUCTURAL = ("category", "tag", "topic", "user")
SEP = "<SEP>"

Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def topic_name() -> Column:
    return F.coalesce(F.nullif(stripped(F.col("title")), F.lit("")), F.concat(F.lit("Topic "), F.col("id").cast("string")))


def topic_nodes(c: Corpus) -> DataFrame:
    """topic_id, tid, name, category of every topic."""
    return c.topics_raw.select(F.col("id").alias("topic_id"), F.concat(F.lit("topic-"), F.col("id").cast("string")).alias("tid"), topic_name().alias("name"), F.coalesce("category_name", F.lit("General")).alias("category"), F.col("created_at").try_cast("timestamp_ntz").alias("created_at"))


def places(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The extractor used where no language model is: capitalised invented names in titles are places, related to their topic by the title's longer words."""
    words_of = lambda x, form: F.array_sort(F.array_distinct(F.filter(F.split(x, r"[^\p{L}]+"), lambda w: w.rlike(form))))
    found = topics.select("tid", "name", F.explode(words_of(F.col("name"), "^[A-Z][a-z]{7,}$")).alias("place"))
    words = F.array_join(words_of(F.lower("name"), "^[a-z]{4,}$"), ", ")
    entities = found.select(F.col("place").alias("entity_name"), F.lit("place").alias("entity_type"), F.concat(F.lit("Mentioned in "), F.col("name")).alias("description"), F.col("tid").alias("source_id"))
    edges = found.select(F.col("name").alias("src"), F.col("place").alias("tgt"), F.concat(F.lit("Topic mentions "), F.col("place")).alias("description"), words.alias("keywords"), F.lit(0.3).alias("weight"), F.col("tid").alias("source_id"))
    return entities, edges


def entities(c: Corpus, extract: Extractor | None = places) -> DataFrame:
    """entity_name, entity_type, description, source_id: each entity of each topic once."""
    t = topic_nodes(c)
    tags = c.topic_tags.where("tag_label IS NOT NULL").select("topic_id", "tag_label").distinct().join(t.select("topic_id", "tid"), "topic_id")
    users = c.posts.where("username IS NOT NULL AND username <> ''").select("topic_id", "username").distinct().join(t.select("topic_id", "tid"), "topic_id")
    row = lambda name, kind, text: (name.alias("entity_name"), F.lit(kind).alias("entity_type"), text.alias("description"), F.col("tid").alias("source_id"))
    parts = [
        t.select(*row(F.col("category"), "category", F.concat(F.lit("Forum category: "), F.col("category")))),
        t.select(*row(F.col("name"), "topic", F.concat(F.lit("Discussion thread in the "), F.col("category"), F.lit(" category")))),
        tags.select(*row(F.col("tag_label"), "tag", F.concat(F.lit("Forum tag: "), F.col("tag_label")))),
        users.select(*row(F.col("username"), "user", F.concat(F.lit("Forum user: "), F.col("username")))),
    ]
    if extract:
        parts.append(extract(t)[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relations(c: Corpus, extract: Extractor | None = places) -> DataFrame:
    """src, tgt, description, keywords, weight, source_id: each relation of each topic once."""
    t = topic_nodes(c)
    tags = c.topic_tags.where("tag_label IS NOT NULL").select("topic_id", "tag_label").distinct().join(t, "topic_id")
    users = c.posts.where("username IS NOT NULL AND username <> ''").select("topic_id", "username").distinct().join(t, "topic_id")

    def rel(df: DataFrame, src: str, tgt: str, pin: str, text: Column) -> DataFrame:
        _, words, weight = PINS[pin]
        return df.select(F.col(src).alias("src"), F.col(tgt).alias("tgt"), text.alias("description"), F.lit(words).alias("keywords"), F.lit(weight).alias("weight"), F.col("tid").alias("source_id"))

    parts = [
        rel(t, "name", "category", "topic_in_category", F.concat(F.lit("Topic posted in the "), F.col("category"), F.lit(" category"))),
        rel(tags, "name", "tag_label", "topic_tagged", F.concat(F.lit("Topic tagged with "), F.col("tag_label"))),
        rel(users, "username", "name", "user_posted", F.concat(F.col("username"), F.lit(" posted in this topic"))),
    ]
    if extract:
        parts.append(extract(t)[1])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _joined(column: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(column)), SEP)


def merged_nodes(found: DataFrame) -> DataFrame:
    """One node a name: the type most entities give it (of equal ones the first by name), descriptions and sources joined.

    Descriptions and sources are counted apart from types, so a name that most topics share (a category) is merged from
    partial sets.
    """
    votes = found.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"))
    types = votes.groupBy("entity_name").agg(F.min_by("entity_type", F.struct((-F.col("n")).alias("n"), "entity_type")).alias("entity_type"))
    texts = found.groupBy("entity_name").agg(_joined("description").alias("description"), F.count_distinct("source_id").alias("sources"))
    return types.join(texts, "entity_name").select(F.col("entity_name").alias("name"), "entity_type", "description", "sources")


def merged_edges(found: DataFrame) -> DataFrame:
    """One edge a pair of different names, whichever way: weights summed, keywords joined, sources counted."""
    pairs = found.withColumns({"a": F.least("src", "tgt"), "b": F.greatest("src", "tgt")}).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.sum(F.round(F.col("weight") * 10).cast("long")).alias("w"), _joined("keywords").alias("keywords"), F.count_distinct("source_id").alias("sources")).select("a", "b", (F.col("w") / 10.0).alias("weight"), "keywords", "sources")


def topic_documents(c: Corpus) -> DataFrame:
    """topic_id, document: header, then each post with author and what it answers, blobs elided.

    A topic's posts are gathered into one row, as its document is one text.
    """
    shown = c.topic_tags.select("topic_id", tag_display(F.col("tag_name"), F.col("tag_slug")).alias("t")).where("t <> ''").groupBy("topic_id").agg(F.array_join(F.sort_array(F.collect_set("t")), ", ").alias("tags"))
    body = X.blobs_elided(stripped(F.col("plain_text")))
    reply = F.when(F.coalesce("reply_to_post_number", F.lit(0)) != 0, F.concat(F.lit("(in reply to post #"), F.col("reply_to_post_number").cast("string"), F.lit(")\n"))).otherwise("")
    p = c.posts_text.select("topic_id", "post_number", "post_id", F.coalesce("username", F.lit("unknown")).alias("u"), reply.alias("reply"), body.alias("body")).where("body <> ''")
    block = F.concat("u", F.lit(":\n"), "reply", "body", F.lit("\n"))
    blocks = p.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("post_number", "post_id", block.alias("x")))).alias("blocks"))
    status = F.array_join(F.array_compact(F.array(F.when(F.col("closed"), "closed"), F.when(F.col("archived"), "archived"))), ", ")
    t = c.topics_raw.select(F.col("id").alias("topic_id"), F.coalesce("category_name", F.lit("General")).alias("cat"), F.coalesce("title", F.lit("")).alias("title"), status.alias("status"), F.substring(F.coalesce("created_at", F.lit("")), 1, 10).alias("day"))
    j = t.join(shown, "topic_id", "left").join(blocks, "topic_id", "left")
    header = F.concat(F.lit("["), "cat", F.lit("] "), "title", F.when(F.col("status") != "", F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise(""), F.when(F.col("tags").isNotNull(), F.concat(F.lit(" (tags: "), "tags", F.lit(")"))).otherwise(""), F.lit(" ("), "day", F.lit(")"))
    return j.select("topic_id", F.concat(header, F.lit("\n\n"), F.coalesce(F.array_join(F.transform("blocks", lambda b: b["x"]), "\n"), F.lit(""))).alias("document"))


def token_chunks(documents: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """key, chunk_no, n_tokens, chunk: windows of `size` tokens (runs without blanks), each repeating the last `overlap` of the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    words = documents.select(F.col(key), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("w")).where("size(w) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    at = words.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.slice("w", F.col("chunk_no") * step + 1, size)
    return at.select(key, "chunk_no", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk"))


# ---- Checks after indexing -------------------------------------------------------------------------------------------


def structural_types(c: Corpus) -> DataFrame:
    """name, entity_type: every structural pair that the topics say, each once, types small."""
    return entities(c, None).select(F.col("entity_name").alias("name"), F.lower("entity_type").alias("entity_type")).where(F.col("entity_type").isin(*STRUCTURAL)).distinct()


def reasserted(nodes: DataFrame, truth: DataFrame, force: bool = False) -> DataFrame:
    """name, entity_type, action: each pair of `truth` held against the graph's nodes.

    `keep` where the node has that type already, `write` where it has another (or always, if forced), `missing` where there
    is no such node. A name that several structural types claim has a row for each.
    """
    j = truth.join(nodes.select("name", F.col("entity_type").alias("_now")), "name", "left")
    right = F.col("_now") == F.col("entity_type")
    return j.select("name", "entity_type", F.when(F.col("_now").isNull(), "missing").when(right & F.lit(not force), "keep").otherwise("write").alias("action"))


def retyped(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """Nodes with structural types put right; of several types that claim a name the last by name is the one that stays."""
    last = reasserted(nodes, truth).where("action = 'write'").groupBy("name").agg(F.max("entity_type").alias("_type"))
    return nodes.join(last, "name", "left").withColumn("entity_type", F.coalesce("_type", "entity_type")).drop("_type")


def verification(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_type, in_graph, in_source, missing: nodes of each structural type, and what the source has of it."""
    source = truth.groupBy("entity_type").agg(F.count("*").alias("in_source"))
    graph = nodes.groupBy(F.lower("entity_type").alias("entity_type")).agg(F.count("*").alias("in_graph"))
    j = source.join(graph, "entity_type", "left").select("entity_type", F.coalesce("in_graph", F.lit(0)).alias("in_graph"), "in_source")
    return j.withColumn("missing", F.greatest(F.col("in_source") - F.col("in_graph"), F.lit(0)))


def buffered(state: DataFrame, operations: DataFrame, key: str, order: str) -> DataFrame:
    """State after a buffer of upserts and deletes: of each key the last operation wins, deletes are applied after upserts.

    operations have state's columns, `order` (of equal ones deletes win) and `deleted`. One aggregate over the buffer, one
    join; state is read once however many operations there are.
    """
    values = [c for c in state.columns if c != key]
    last = operations.groupBy(key).agg(F.max_by(F.struct("deleted", *values), F.struct(order, F.col("deleted").cast("int"))).alias("_op"))
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("NOT _op.deleted").select(key, *[F.col(f"_op.{c}").alias(c) for c in values]))


# ---- Canonical names -------------------------------------------------------------------------------------------------


def bucket_key(name: Column, kind: Column) -> Column:
    """The key that variants of one name share: case folded, and for tags the marks between parts."""
    low = F.lower(name)
    return F.when(kind == "tag", X.separators_folded(low)).otherwise(low)


def case_map(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """old, canonical: every name that is another spelling of one.

    A bucket of several structural types stays apart. The canonical name is, of a tag with several seeds, the one in slug
    spelling; else a seed; else one in small letters; else the first.
    """
    n = nodes.select("name", "entity_type").join(seeds.select(F.col("name"), F.lit(True).alias("is_seed")).distinct(), "name", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    structural = n.where(F.col("entity_type").isin(*STRUCTURAL)).select(F.lower("name").alias("k"), "entity_type").distinct().groupBy("k").agg(F.min("entity_type").alias("kind"), F.count("*").alias("kinds"))
    typed = n.withColumn("k", F.lower("name")).join(structural, "k", "left").where("coalesce(kinds, 1) = 1")
    kind = F.coalesce("kind", "entity_type")
    keyed = typed.withColumn("key", F.when(kind == "tag", F.concat(F.lit("tag:"), bucket_key(F.col("name"), F.lit("tag")))).otherwise(F.concat(F.lit("any:"), F.lower("name"))))
    rank = F.struct((~F.col("is_seed")).alias("a"), (X.separators_folded(F.col("name")) != F.col("name")).alias("b"), (F.lower("name") != F.col("name")).alias("c"), F.col("name").alias("d"))
    best = keyed.groupBy("key").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(best, "key").where("name <> best.d").select(F.col("name").alias("old"), F.col("best.d").alias("canonical"))


def user_map(nodes: DataFrame) -> DataFrame:
    """old, canonical: names that paraphrase a user, by the user's name."""
    users = nodes.where("entity_type = 'user'").select(F.lower("name").alias("k"), F.col("name").alias("canonical"))
    others = nodes.where("entity_type <> 'user'").select(F.col("name").alias("old"), F.lower(X.affixes_stripped(F.col("name"))).alias("k"))
    return others.join(users.groupBy("k").agg(F.min("canonical").alias("canonical")), "k").where("old <> canonical").select("old", "canonical")


def renamed(relations_: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with their ends by canonical names."""
    a, b = names.select(F.col("old").alias("src"), F.col("canonical").alias("_s")), names.select(F.col("old").alias("tgt"), F.col("canonical").alias("_t"))
    return relations_.join(a, "src", "left").join(b, "tgt", "left").withColumns({"src": F.coalesce("_s", "src"), "tgt": F.coalesce("_t", "tgt")}).drop("_s", "_t")


# ---- Incremental plans -----------------------------------------------------------------------------------------------


def payload_hashes(c: Corpus) -> DataFrame:
    """topic_id, hash of everything structural a topic says."""
    t = topic_nodes(c)
    tags = c.topic_tags.where("tag_label IS NOT NULL").groupBy("topic_id").agg(F.array_join(F.sort_array(F.collect_set("tag_label")), "\x1f").alias("tags"))
    users = c.posts.where("username IS NOT NULL").groupBy("topic_id").agg(F.array_join(F.sort_array(F.collect_set("username")), "\x1f").alias("users"))
    j = t.join(tags, "topic_id", "left").join(users, "topic_id", "left")
    return j.select("topic_id", F.sha2(F.concat_ws("\x1e", "name", "category", F.coalesce("tags", F.lit("")), F.coalesce("users", F.lit(""))), 256).alias("hash"))


def plan(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """topic_id, action: SKIP where the ledger has the same hash, INSERT where it has none, else RESEED."""
    j = current.join(ledger.select("topic_id", F.col("hash").alias("_old")), "topic_id", "left")
    return j.select("topic_id", F.when(F.col("_old").isNull() | (F.col("_old") == ""), "INSERT").when(F.col("_old") == F.col("hash"), "SKIP").otherwise("RESEED").alias("action"))


def stale(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded (src, tgt) that no current relation has; the way they point counts."""
    return recorded.select("src", "tgt").distinct().join(current.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural nodes without an edge; others are never dropped."""
    ends = edges.select(F.col("a").alias("name")).unionByName(edges.select(F.col("b").alias("name"))).distinct()
    return nodes.where(F.col("entity_type").isin(*STRUCTURAL)).join(ends, "name", "left_anti").select("name", "entity_type")


def deduplicated_titles(topics: DataFrame) -> DataFrame:
    """id, title: the nth topic of a title has ` (n)` after it."""
    ranked = numbered(topics.where("title IS NOT NULL").select("id", "title"), F.asc("title"), F.asc("id"), name="place")
    first = ranked.groupBy("title").agg(F.min("place").alias("first"))
    n = F.col("place") - F.col("first") + 1
    return ranked.join(first, "title").select("id", F.when(n > 1, F.concat("title", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"))


def reply_clock(posts: DataFrame) -> DataFrame:
    """topic_id, post_number, minutes since the topic's first post, by a running sum of the gaps."""
    place = Window.partitionBy("topic_id").orderBy("post_number", "post_id")
    gap = F.coalesce(F.timestamp_diff("MINUTE", F.lag("created_at").over(place), F.col("created_at")), F.lit(0))
    return posts.select("topic_id", "post_id", "post_number", "created_at").withColumn("gap", gap).select("topic_id", "post_id", "post_number", F.sum("gap").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("minutes"))
