"""Relation buckets from keyword vectors: k-means centroids, Ward merging to n buckets, and balancing by what edges vote for.

Centroids are few (k-means' k), so their geometry is worked out on the driver; how many edges each bucket gets is counted
over all edges, once a round.
"""

from __future__ import annotations

from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import edge_keywords
from .kg import PIN_KEYWORDS
from .retrieve import DIMENSIONS, embedded, k_means, ward_merged

ROUNDS = 30


def keyword_centroids(counts: DataFrame, k: int = 50, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(keyword, centroid), and the centroids' means and sizes, of the keywords that aren't pinned."""
    vectors = materialize(counts.where(~F.col("keyword").isin(*PIN_KEYWORDS)).select("keyword", "n", embedded(F.col("keyword")).alias("v")), "keyword-vectors")
    k = max(1, min(k, vectors.count()))
    found = materialize(k_means(vectors, "keyword", "v", k, seed), "keyword-centroids")
    means = found.join(vectors, "keyword").groupBy("centroid").agg(F.count("*").alias("size"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(DIMENSIONS)]).collect()
    centres, sizes = np.zeros((k, DIMENSIONS)), np.zeros(k)
    for r in means:
        centres[r.centroid], sizes[r.centroid] = [r[f"m{i}"] for i in range(DIMENSIONS)], r["size"]
    return found, centres, sizes


def edge_votes(edges: DataFrame, centroids: DataFrame) -> DataFrame:
    """a, b, centroid, votes of each edge with keywords that aren't pinned, written once."""
    return materialize(edge_keywords(edges).join(centroids, "keyword").groupBy("a", "b", "centroid").agg(F.count("*").alias("votes")), "votes")


def bucket_sizes(votes: DataFrame, buckets: np.ndarray) -> np.ndarray:
    """Edges of each bucket: an edge is of the bucket of most of its votes, of equal ones the first."""
    bucket = F.element_at(F.array(*[F.lit(int(b)) for b in buckets]), F.col("centroid") + 1)
    cast = votes.groupBy("a", "b", bucket.alias("bucket")).agg(F.sum("votes").alias("v"))
    best = cast.groupBy("a", "b").agg(F.min_by("bucket", F.struct((-F.col("v")).alias("v"), "bucket")).alias("bucket"))
    out = np.zeros(int(buckets.max()) + 1, dtype=int)
    for r in best.groupBy("bucket").count().collect():  # a row a bucket
        out[r.bucket] = r["count"]
    return out


def _emptied(target: int, biggest: int, buckets: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centroids of one bucket moved to the nearest bucket that is neither it nor, if there is another, the biggest."""
    others = [b for b in np.unique(buckets) if b not in (target, biggest)] or [biggest]
    means = np.array([centres[buckets == b].mean(0) for b in others])
    out = buckets.copy()
    for c in np.flatnonzero(buckets == target):
        out[c] = others[int(((means - centres[c]) ** 2).sum(1).argmin())]
    return out


def _halved(bucket: int, slot: int, buckets: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """One bucket's centroids parted at its widest direction; the farther half goes to an empty slot."""
    own = np.flatnonzero(buckets == bucket)
    x = centres[own] - centres[own].mean(0)
    side = x @ np.linalg.svd(x, full_matrices=False)[2][0] > 0
    out = buckets.copy()
    out[own[side if side.any() and not side.all() else np.arange(len(own)) == 0]] = slot
    return out


def balanced(votes: DataFrame, buckets: np.ndarray, centres: np.ndarray, threshold: float = 4.0, least_percent: float = 0.5, rounds: int = ROUNDS) -> np.ndarray:
    """Buckets of the centroids, as many as before, without tiny ones and with none much bigger than the middle one.

    Each round empties the smallest bucket into its neighbours and halves the biggest into the free slot, while some bucket
    has under least_percent of the edges or the biggest has over threshold times the median; it stops when that no longer helps.
    """
    best, best_score = buckets, np.inf
    for _ in range(rounds):
        sizes = bucket_sizes(votes, buckets)
        some = sizes[sizes > 0]
        if len(some) == 0:
            return buckets
        ratio = some.max() / median(some.tolist()) if len(some) > 1 else 1.0
        tiny = int((sizes < least_percent / 100 * sizes.sum()).sum())
        if (score := tiny * 1000 + ratio) < best_score:
            best, best_score = buckets, score
        biggest, smallest = int(sizes.argmax()), int(sizes.argmin())
        if not (tiny or ratio > threshold) or biggest == smallest or (buckets == biggest).sum() < 2:
            break
        buckets = _halved(biggest, smallest, _emptied(smallest, biggest, buckets, centres), centres)
    return best


def keyword_buckets(edges: DataFrame, counts: DataFrame, n: int = 12, k: int = 50) -> DataFrame:
    """keyword, bucket, n: the keywords that aren't pinned in n balanced buckets."""
    found, centres, sizes = keyword_centroids(counts, k)
    buckets = ward_merged(centres, sizes, n)
    buckets = balanced(edge_votes(edges, found), buckets, centres)
    bucket = F.element_at(F.array(*[F.lit(int(b)) for b in buckets]), F.col("centroid") + 1)
    return found.join(counts, "keyword").select("keyword", bucket.alias("bucket"), "n")
