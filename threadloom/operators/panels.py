"""What an explorer's panels show: hubs and bridges within groups, glances, styles, summaries, samples and budgets.

Every top-k is by a count and then by name, with its size as a parameter; ranks within a group keep k rows a task before the
shuffle. Null names and types count as none.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import adjacency, degrees, edge_keywords, super_category

#: Colours in a palette; positions beyond it begin anew.
PALETTE = 16


def best_of(rows: DataFrame, keys: tuple[str, ...], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def grouped(nodes: DataFrame) -> DataFrame:
    """name, community: nodes by super-category, for the panels that take any partition."""
    return nodes.select("name", super_category(F.col("entity_type")).alias("community"))


def homes(entities: DataFrame, topics: DataFrame) -> DataFrame:
    """name, community: each node by the first category of the topics that it is from."""
    t = topics.select(F.col("tid").alias("source_id"), "category")
    return entities.join(t, "source_id").groupBy(F.col("entity_name").alias("name")).agg(F.min("category").alias("community"))


def _sided(member: DataFrame, edges: DataFrame) -> DataFrame:
    m = member.select("name", "community")
    return edges.select("a", "b").join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b")


def inner_hubs(member: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """community, name, degree, rank: the nodes of most edges within their own group."""
    inner = _sided(member, edges).where("ca = cb")
    ends = inner.select("ca", F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
    d = member.select("name", "community").join(ends, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return best_of(d, ("community",), n, F.desc("degree"), F.asc("name")).select("community", "name", "degree", "rank")


def outer_hubs(member: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """community, other, name, bridges, rank: of each pair of groups the nodes of the other with most edges into the one."""
    across = _sided(member, edges).where("ca <> cb")
    ends = across.select(F.explode(F.array(F.struct(F.col("ca").alias("community"), F.col("cb").alias("other"), F.col("b").alias("name")), F.struct(F.col("cb").alias("community"), F.col("ca").alias("other"), F.col("a").alias("name")))).alias("e"))
    counts = ends.groupBy("e.community", "e.other", "e.name").agg(F.count("*").alias("bridges"))
    return best_of(counts, ("community", "other"), n, F.desc("bridges"), F.asc("name")).select("community", "other", "name", "bridges", "rank")


def composition(nodes: DataFrame, member: DataFrame, cut: DataFrame) -> DataFrame:
    """community, entity_type, n, cut_nodes: what a group is made of, and how many of them hold it together."""
    c = cut.select("name", F.lit(1).alias("cut")).distinct()
    j = nodes.select("name", "entity_type").join(member.select("name", "community"), "name").join(c, "name", "left")
    return j.groupBy("community", "entity_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("cut", F.lit(0))).cast("long").alias("cut_nodes"))


def size_ranks(member: DataFrame) -> DataFrame:
    """community, size, rank, band: groups by size, and whether one is among the first hundredth, twentieth or tenth. A row a group."""
    sizes = member.groupBy("community").agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community")))
    share = F.col("rank") * 100.0 / F.count("*").over(Window.partitionBy())
    return ranked.withColumn("band", F.when(share <= 1, "top 1%").when(share <= 5, "top 5%").when(share <= 10, "top 10%").otherwise(""))


def relation_types(member: DataFrame, edges: DataFrame, n: int = 8) -> DataFrame:
    """community, keyword, n, rank: the most frequent keywords of the edges within each group."""
    m = member.select("name", "community")
    e = edge_keywords(edges).join(m.toDF("a", "community"), "a").join(m.toDF("b", "cb"), "b").where("community = cb")
    counts = e.groupBy("community", "keyword").agg(F.count("*").alias("n"))
    return best_of(counts, ("community",), n, F.desc("n"), F.asc("keyword")).select("community", "keyword", "n", "rank")


def glance(nodes: DataFrame, edges: DataFrame, counts: DataFrame, n: int = 5) -> DataFrame:
    """section, item, n: the first nodes, super-categories and relation keywords of a graph."""
    top = lambda df, section: df.orderBy(F.desc("n"), "item").limit(n).select(F.lit(section).alias("section"), "item", "n")
    first = top(degrees(nodes, edges).select(F.col("name").alias("item"), F.col("degree").alias("n")), "nodes")
    kinds = top(nodes.groupBy(super_category(F.col("entity_type")).alias("item")).agg(F.count("*").alias("n")), "categories")
    return first.unionByName(kinds).unionByName(top(counts.select(F.col("keyword").alias("item"), "n"), "relations"))


def edge_panel(edges: DataFrame, relations: DataFrame, one: str, other: str) -> DataFrame:
    """source_id, weight, phrases, rank: an edge's weight and first three phrases beside each topic it is from."""
    a, b = sorted((one, other))
    phrases = F.slice(F.filter(F.transform(F.split(F.replace(F.col("keywords"), F.lit("<SEP>"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    e = edges.where((F.col("a") == a) & (F.col("b") == b)).select("weight", F.array_join(phrases, ", ").alias("phrases"))
    r = relations.where((F.least("src", "tgt") == a) & (F.greatest("src", "tgt") == b)).groupBy("source_id").agg(F.count("*").alias("n"))
    ranked = r.orderBy(F.desc("n"), "source_id").limit(10)
    return ranked.crossJoin(F.broadcast(e)).select("source_id", "n", "weight", "phrases")  # e is one row


def locked(member: DataFrame, edges: DataFrame, community: str) -> DataFrame:
    """a, b, weight of the edges of which both ends are in one group."""
    own = member.where(F.col("community") == community).select("name")
    return edges.join(own.toDF("a"), "a", "left_semi").join(own.toDF("b"), "b", "left_semi").select("a", "b", "weight")


def drilled(nodes: DataFrame, edges: DataFrame, category: str) -> DataFrame:
    """entity_type, nodes, ends: a super-category opened into the types it holds."""
    d = degrees(nodes, edges).where(super_category(F.col("entity_type")) == category)
    return d.groupBy("entity_type").agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"))


def in_view(positions: DataFrame, x: Column, y: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose place is within a box (least x, least y, most x, most y), its edges included."""
    return positions.where((x >= box[0]) & (y >= box[1]) & (x <= box[2]) & (y <= box[3]))


def labelled(nodes: DataFrame, edges: DataFrame, n: int = 50) -> DataFrame:
    """name, label of the n nodes of most edges, labels cut to thirty characters."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "name").limit(n).select("name", X.truncated(F.col("name"), 30, "…").alias("label"))


# ---- Styles and texts ------------------------------------------------------------------------------------------------


def _rounded(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def node_styles(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """name, size, colour: size by the logarithm of the degree, colour by the type's place in `types` (others none), round the palette."""
    d = degrees(nodes, edges)
    most = d.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    colour = F.when(F.array_position(F.array(*map(F.lit, types)), F.col("entity_type")) > 0, (F.array_position(F.array(*map(F.lit, types)), F.col("entity_type")) - 1) % PALETTE)
    return d.crossJoin(F.broadcast(most)).select("name", _rounded(8 + 35 * F.log1p("degree") / F.log1p("most")).alias("size"), colour.alias("colour"))  # most is one row


def edge_styles(edges: DataFrame) -> DataFrame:
    """a, b, width by weight."""
    most = edges.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("most"))
    return edges.crossJoin(F.broadcast(most)).select("a", "b", _rounded(0.5 + 4 * F.col("weight") / F.col("most")).alias("width"))  # most is one row


def tooltips(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, tooltip: name, super-category, type and degree, a blank line, and the description cut to 240 characters."""
    d = degrees(nodes, edges).join(nodes.select("name", "description"), "name")
    line = F.concat(super_category(F.col("entity_type")), F.lit(" · "), "entity_type", F.lit(" · deg "), F.col("degree").cast("string"))
    return d.select("name", F.concat_ws("\n", "name", line, F.lit(""), X.truncated(F.coalesce("description", F.lit("")), 240, "…")).alias("tooltip"))


def summary_lines(nodes: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """name, line: one line of markdown for each of the n nodes of most edges."""
    d = degrees(nodes, edges).orderBy(F.desc("degree"), "name").limit(n)
    return d.select("name", F.concat(F.lit("- **"), X.markdown_cell(F.col("name")), F.lit("** ("), "entity_type", F.lit(", "), F.col("degree").cast("string"), F.lit(" connections)")).alias("line"))


def edge_names(edges: DataFrame) -> DataFrame:
    """a, b, label: an edge by the names of its ends."""
    return edges.select("a", "b", F.concat("a", F.lit(" ↔ "), "b").alias("label"))


def quoted(text: Column) -> Column:
    """struct(sql, shell, attribute): a text as a literal of each."""
    q = F.lit("'")
    escaped = text
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    return F.struct(F.concat(q, F.replace(text, q, F.lit("''")), q).alias("sql"), F.concat(q, F.replace(text, q, F.lit("'\\''")), q).alias("shell"), F.concat(F.lit('"'), escaped, F.lit('"')).alias("attribute"))


#: Slots of a template at most.
SLOTS = 16


def filled(template: str, slots: dict[str, Column]) -> Column:
    """A template with its {slots} filled from left to right; null values are empty. An unknown slot, or too many, is an error."""
    parts = re.split(r"\{(\w+)\}", template)
    names = parts[1::2]
    if len(names) > SLOTS:
        raise ValueError(f"more than {SLOTS} slots")
    if unknown := [n for n in names if n not in slots]:
        raise ValueError(f"unknown slot {unknown[0]}")
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(slots[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])


# ---- Samples, batches, budgets, questions ----------------------------------------------------------------------------


def first_files(topics: DataFrame, n: int) -> DataFrame:
    """id, file_name of the first n topic files by name (so 10 comes before 9)."""
    return topics.select("id", F.concat(F.lit("topic-"), F.col("id").cast("string"), F.lit(".json")).alias("file_name")).orderBy("file_name").limit(n)


def sampled(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows (all, if there are fewer) without replacement, each as likely as any: those whose key and seed have the least digests."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def label_frequency(sample: DataFrame, text: str, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """label, n: in how many sampled texts each label is seen, by any of its words; the stand-in for a model that labels."""
    low = F.lower(text)
    seen = [F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in words)), F.lit(name)) for name, words in labels.items()]
    return sample.select(F.explode(F.array_compact(F.array(*seen))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def shared_names(one: DataFrame, other: DataFrame) -> DataFrame:
    """name: what two vocabularies have in common, case ignored."""
    return one.select(F.lower("name").alias("name")).intersect(other.select(F.lower("name").alias("name")))


def batched(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with the number of the batch of `size` they are asked for in, each key by itself."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))


def within_budget(rows: DataFrame, key: str, cost: str, budget: int, *order: Column) -> DataFrame:
    """Of each key (a context's kind, of top-k rows) those rows in order whose running cost is within a budget."""
    spent = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("spent", spent).where(F.col("spent") <= budget)


COUNTING = r"\b(how many|count|number of|most|top [0-9]+|average|per month|least|total)\b"


def advised(question: Column) -> Column:
    """`sql` for a question that asks for a count, `local` for one about something named, else `mix`."""
    return F.when(F.lower(question).rlike(COUNTING), "sql").when(question.rlike(r"[a-z,] [A-Z][a-z]{3,}"), "local").otherwise("mix")


def question_keywords(question: Column) -> Column:
    """struct(low, high): the names in a question, and its other words of weight, each once in order."""
    names = F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0)))
    small = F.transform(names, lambda x: F.lower(x))
    return F.struct(F.array_join(names, ", ").alias("low"), F.array_join(F.array_except(F.array_distinct(X.tokens(question)), small), ", ").alias("high"))


def neighbours_of(edges: DataFrame, name: str) -> DataFrame:
    """name, weight: what one node is connected to, the sum of weights of each."""
    return adjacency(edges).where(F.col("x") == name).groupBy(F.col("y").alias("name")).agg(F.sum("weight").alias("weight"))


def preferred(available: DataFrame, column: str, preferences: tuple[str, ...]) -> DataFrame:
    """The first of some preferences that there is; no row without any."""
    place = F.array_position(F.array(*map(F.lit, preferences)), F.col(column))
    return available.where(place > 0).orderBy(place).select(column).limit(1)
