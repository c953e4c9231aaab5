"""Retrieval by vectors and by the graph around what they find.

Queries are taken in blocks of a checked size, each sent to the workers once; every batch of rows keeps its own k best, so
what is shuffled is k rows a batch, never a score for each pair. Null and zero vectors match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kg import SEP

#: Queries in a block, least cosine that counts, results of a query.
BLOCK, FLOOR, TOP = 4096, 0.2, 20
DIMENSIONS = 64


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = TOP, floor: float = FLOOR) -> DataFrame:
    """query_id, row_id, score, rank: for each query its k nearest rows by cosine, ties by key; a row may match itself."""
    spark = rows.sparkSession
    ids = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    numbered = ids.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-ids.count() * 5 // (BLOCK * 4))))))
    blocks = [r.block for r in numbered.select("block").distinct().orderBy("block").collect()]
    found = None
    for b in blocks:
        part = numbered.where(F.col("block") == b).orderBy("q").toPandas()
        sent = spark.sparkContext.broadcast((part["q"].to_numpy(), _unit(np.stack(part["v"].to_numpy()).astype(float))))

        def near(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            for batch in batches:
                batch = batch[batch["v"].notna()]
                if not len(batch):
                    continue
                scores = q @ _unit(np.stack(batch["v"].to_numpy()).astype(float)).T
                ids_ = batch["r"].to_numpy()
                order = np.lexsort((np.broadcast_to(ids_, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, axis=1)
                out = pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "row_id": ids_[order].ravel(), "score": best.ravel()})
                yield out[out["score"] >= floor]

        hits = rows.select(F.col(key).cast("long").alias("r"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(near, "query_id long, row_id long, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id long, row_id long, score double")
    rounded = found.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _hashed(texts: pd.Series) -> pd.Series:
    import zlib

    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode("utf-8", "replace"))
            out[i, h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
    return pd.Series(list(_unit(out).astype(np.float32)))


def embedded(text: Column) -> Column:
    """The stand-in for an embedding model: signed hashed words, of unit length."""
    return _hashed(text)


def entity_texts(nodes: DataFrame) -> DataFrame:
    """key, name, vector of each node, by name and description."""
    return nodes.select(F.xxhash64("name").alias("key"), "name", embedded(F.concat_ws(" ", "name", F.replace(F.col("description"), F.lit(SEP), F.lit(" ")))).alias("vector"))


def relation_texts(edges: DataFrame) -> DataFrame:
    """key, a, b, vector of each edge, by keywords and ends."""
    return edges.select(F.xxhash64("a", "b").alias("key"), "a", "b", embedded(F.concat_ws(" ", F.replace(F.col("keywords"), F.lit(SEP), F.lit(" ")), "a", "b")).alias("vector"))


def _question(df: DataFrame, text: str) -> DataFrame:
    one = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), embedded(F.lit(text)).alias("vector"))
    return one


def local_context(nodes: DataFrame, edges: DataFrame, relations: DataFrame, question: str, k: int = 60) -> DataFrame:
    """kind, item, score: entities nearest to a question, the edges on them and the sources of those."""
    e = entity_texts(nodes)
    hits = top_k(_question(e, question), e.select("key", "vector"), "key", "vector", k).select(F.col("row_id").alias("key"), "score").join(e.select("key", "name"), "key")
    near = edges.join(hits.select(F.col("name").alias("a"), "score"), "a").select("a", "b", "score").unionByName(edges.join(hits.select(F.col("name").alias("b"), "score"), "b").select("a", "b", "score")).groupBy("a", "b").agg(F.max("score").alias("score"))
    return _context(hits.select("name", "score"), near, relations)


def global_context(nodes: DataFrame, edges: DataFrame, relations: DataFrame, question: str, k: int = 60) -> DataFrame:
    """kind, item, score: edges nearest to a question, their ends and sources."""
    r = relation_texts(edges)
    near = top_k(_question(r, question), r.select("key", "vector"), "key", "vector", k).select(F.col("row_id").alias("key"), "score").join(r.select("key", "a", "b"), "key").select("a", "b", "score")
    ends = near.select(F.explode(F.array("a", "b")).alias("name"), "score").groupBy("name").agg(F.max("score").alias("score"))
    return _context(ends, near, relations)


def _context(entities: DataFrame, near: DataFrame, relations: DataFrame) -> DataFrame:
    pairs = relations.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "source_id")
    chunks = near.join(pairs, ["a", "b"]).groupBy("source_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "source_id").limit(TOP)
    return (
        entities.select(F.lit("entity").alias("kind"), F.col("name").alias("item"), "score")
        .unionByName(near.select(F.lit("relation").alias("kind"), F.concat("a", F.lit(" ↔ "), "b").alias("item"), "score"))
        .unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("source_id").alias("item"), "score"))
    )


def naive_context(chunks: DataFrame, question: str, k: int = TOP) -> DataFrame:
    """kind, item, score: the chunks (topic_id, chunk_no, chunk) nearest to a question by their own vectors."""
    tid = F.concat(F.lit("topic-"), F.col("topic_id").cast("string"))
    c = chunks.select(F.xxhash64("topic_id", "chunk_no").alias("key"), tid.alias("item"), embedded(F.col("chunk")).alias("vector"))
    hits = top_k(_question(c, question), c.select("key", "vector"), "key", "vector", k).select(F.col("row_id").alias("key"), "score").join(c.select("key", "item"), "key")
    return hits.groupBy("item").agg(F.max("score").alias("score")).select(F.lit("chunk").alias("kind"), "item", "score")


def hybrid_context(nodes: DataFrame, edges: DataFrame, relations: DataFrame, question: str) -> DataFrame:
    """The union of the local and the global context, each item once by its better score."""
    both = local_context(nodes, edges, relations, question).unionByName(global_context(nodes, edges, relations, question))
    return both.groupBy("kind", "item").agg(F.max("score").alias("score"))


def mix_context(nodes: DataFrame, edges: DataFrame, relations: DataFrame, chunks: DataFrame, question: str) -> DataFrame:
    """The hybrid context and the chunks nearest to the question, each item once by its better score."""
    both = hybrid_context(nodes, edges, relations, question).unionByName(naive_context(chunks, question))
    return both.groupBy("kind", "item").agg(F.max("score").alias("score"))


def k_means(rows: DataFrame, key: str, vector: str, k: int = 50, seed: int = 42) -> DataFrame:
    """key, centroid of each vector of unit length, by distributed k-means++."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.col(vector).cast("array<double>"), lambda x: x / F.when(norm > 0, norm).otherwise(1.0))
    features = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(unit).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(features)
    return model.transform(features).select(key, F.col("prediction").alias("centroid"))


def ward_merged(centres: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """For each of a few centroids (k-means' k) the number of its group, after merging the two of least added variance until n remain."""
    groups = [[i] for i in range(len(centres))]
    c, w = centres.astype(float).copy(), sizes.astype(float).copy()
    alive = [i for i in range(len(c)) if w[i] > 0] or [*range(len(c))]
    while len(alive) > n:
        sub, m = c[alive], w[alive]
        cost = ((sub[:, None] - sub[None]) ** 2).sum(2) * (m[:, None] * m[None]) / np.maximum(m[:, None] + m[None], 1e-12)
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(divmod(int(cost.argmin()), len(alive)))
        a, b = alive[i], alive[j]
        c[a] = (c[a] * w[a] + c[b] * w[b]) / max(w[a] + w[b], 1e-12)
        w[a] += w[b]
        groups[a] += groups[b]
        alive.pop(j)
    out = np.zeros(len(centres), dtype=int)
    for number, a in enumerate(alive):
        out[groups[a]] = number
    return out
