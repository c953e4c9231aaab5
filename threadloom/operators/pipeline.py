"""Indexing from end to end: sync, merge, right types, canonical names, verification; and a question put to the result.

Steps are retried, a failing one leaves the state before it in force, and whoever runs it is told how far it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import incremental as I
from . import kg as K
from . import panels as P
from . import retrieve as V
from .views import Corpus

T = TypeVar("T")
#: Waits before the second and third try of a step, in seconds.
WAITS = (1.0, 2.0)
#: Tokens of a context's entities and relations, and rows of each.
ENTITY_TOKENS, RELATION_TOKENS, TOP, CHUNKS = 6000, 8000, 60, 20
MODES = ("naive", "local", "global", "hybrid", "mix")


def retried(step: Callable[[], T], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> T:
    """A step's result; an error is raised only after it failed once more than there are waits."""
    for wait in (*waits, None):
        try:
            return step()
        except Exception:
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError


class FlushGate:
    """Says at every call whether to flush: never while suppressed, else each `every`-th time."""

    def __init__(self, every: int = 1) -> None:
        self.every, self.calls, self.suppressed = max(1, every), 0, False

    def __call__(self) -> bool:
        if self.suppressed:
            return False
        self.calls += 1
        return self.calls % self.every == 0


def progress(done: int, total: int, began: float, now: float) -> str:
    """`3/10 30% 12s left`, the rest by the pace so far."""
    left = (now - began) / done * (total - done) if done else 0.0
    return f"{done}/{total} {done * 100 // max(1, total)}% {left:.0f}s left"


class Limited(Corpus):
    """A corpus of its first topics by file name alone."""

    def __init__(self, corpus: Corpus, n: int) -> None:
        super().__init__(corpus.spark, corpus.sf_dir)
        self.base, self.n = corpus, n

    def table(self, name: str) -> DataFrame:
        df = self.base.table(name)
        if name not in ("topics", "posts"):
            return df
        kept = P.first_files(self.base.topics_raw, self.n).select(F.col("id").alias("_kept"))
        return df.join(kept, F.col("id" if name == "topics" else "topic_id") == F.col("_kept"), "left_semi")


def index(corpus: Corpus, state: str, clear: bool = False, limit: int | None = None, enrich_only: bool = False, say: Callable[[str], None] = print) -> DataFrame:
    """Brings a state up to the corpus and returns the verification of its graph.

    clear forgets the state first; limit takes the first topics by file name; enrich_only leaves the relations as they are
    and only puts types right. The graph is written beside the state, as a version of its own.
    """
    spark = corpus.spark
    c = Limited(corpus, limit) if limit is not None else corpus
    began, steps = time.time(), 4
    tell = lambda n, what: say(f"{what}: {progress(n, steps, began, time.time())}")
    if clear:
        path = spark._jvm.org.apache.hadoop.fs.Path(state)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if not enrich_only:
        retried(lambda: I.sync(c, state))
    tell(1, "sync")
    relations = I.recorded(spark, state)
    names = relations.select(F.explode(F.array("src", "tgt")).alias("name")).distinct()
    nodes = retried(lambda: materialize(K.merged_nodes(K.entities(c)).join(names, "name", "left_semi"), "nodes"))
    tell(2, "merge")
    truth = K.structural_types(c)
    typed = retried(lambda: materialize(K.retyped(nodes, truth), "typed"))
    tell(3, "types")
    mapped = K.renamed(relations, K.case_map(typed, typed.where(F.col("entity_type").isin(*K.STRUCTURAL))))
    version = f"{state}/graph-{int(began * 1000)}"
    retried(lambda: K.merged_edges(mapped).write.mode("overwrite").parquet(f"{version}/edges"))
    retried(lambda: typed.write.mode("overwrite").parquet(f"{version}/nodes"))
    tell(4, "graph")
    return K.verification(typed, truth)


def context(corpus: Corpus, nodes: DataFrame, edges: DataFrame, relations: DataFrame, question: str, mode: str = "mix") -> DataFrame:
    """kind, item, score: what a mode of retrieval finds for a question, within the budgets of tokens; the best first."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    found = None
    if mode in ("local", "hybrid", "mix"):
        found = V.local_context(nodes, edges, relations, question, TOP)
    if mode in ("global", "hybrid", "mix"):
        other = V.global_context(nodes, edges, relations, question, TOP)
        found = other if found is None else found.unionByName(other)
    if mode in ("naive", "mix"):
        chunks = K.token_chunks(K.topic_documents(corpus), "topic_id", "document", 1200, 100)
        other = V.naive_context(chunks, question, CHUNKS)
        found = other if found is None else found.unionByName(other)
    best = found.groupBy("kind", "item").agg(F.max("score").alias("score"))
    tokens = F.size(F.split("item", r"\s+"))
    budget = F.when(F.col("kind") == "entity", ENTITY_TOKENS).when(F.col("kind") == "relation", RELATION_TOKENS).otherwise(ENTITY_TOKENS + RELATION_TOKENS)
    spent = P.within_budget(best.withColumn("tokens", tokens), "kind", "tokens", 1 << 30, F.desc("score"), F.asc("item"))
    return spent.where(F.col("spent") <= budget).select("kind", "item", "score")
