"""Held-out texts that leak into a corpus: rare n-gram seeds, then Smith-Waterman alignment.

Every window of RUN words of an item is represented by its rarest n-gram in the corpus (exact counts over all documents),
so a passage of RUN consecutive words that an item and a document share always contains a seed of that item: no such leak
is lost, and no frequent phrase (a prompt that many texts begin with) becomes a seed unless a passage has nothing rarer.
An edited copy may lack every seed, so a pair is also taken if the document holds n-grams of two stretches of the item
that are apart by an edit, at most RUN words from one to the next, however frequent they are. A pair that shares a single
stretch of less than RUN words without a seed is not looked at. Pairs are aligned word by word around the places where they
share n-grams. A pair is a leak if its best local alignment scores LEAK (an edited copy loses a word's worth for each edit)
and the words aligned include enough of those that few other items have: texts from one mould, with other names in it, align
well too. An exact run of RUN words, told by its length, is a leak whatever its words.

Words are runs of letters and digits, case ignored. Null, empty and blank texts hold no words and leak nothing; items of
fewer than RUN words have no window. Items with one text are aligned once and reported each. Documents with one text are
each reported. Rows repeated in either table count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import columns

#: Words of a seed, and of the shortest passage that counts.
SEED, RUN = 5, 13
#: Most item n-grams that are sent to every worker (8 bytes each); beyond it they are joined by shuffle.
SENT_GRAMS = 4_000_000
#: Bits of the Bloom filter that is sent in their place.
BLOOM = 1 << 26
#: Alignment scores of a pair of equal words, of unequal ones and of a word left out; the score of a leak, that of the shortest passage that counts.
EQUAL, UNEQUAL, GAP = 2, -1, -1
LEAK = EQUAL * RUN
#: An item's own words: those that no more than this share of the item texts have, or this many; of them an edited copy keeps a share, two at least.
OWN_SHARE, OWN_LEAST, KEPT = 0.01, 3, 3
#: Pairs aligned at once, documents with something to align in a task.
TOGETHER, DOCUMENTS_A_TASK = 64, 2000

_WORDS = re.compile(r"[^\W_]+")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(RUN)], dtype=np.uint64)


class _Hashes(dict):
    """64-bit hashes of words, case ignored; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.lower())
        return found


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word of a text."""
    return np.fromiter((_HASHES[w] for w in _WORDS.findall(text or "")), dtype=np.uint64)


def grams(words: np.ndarray, size: int = SEED) -> np.ndarray:
    """The hash of each n-gram of words, as signed 64-bit numbers."""
    if len(words) < size:
        return np.empty(0, dtype=np.int64)
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, power in enumerate(_POWERS[:size]):
            out += words[i : i + n] * power
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def item_texts(items: DataFrame) -> DataFrame:
    """text_id, text: each different text of the items once."""
    return items.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_id"), "text").distinct()


def own_words(texts: DataFrame) -> DataFrame:
    """text_id, text, own: the item texts with the hashes of the words that few of them have."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["text_id"], batch["text"], strict=True):
                found = np.unique(word_hashes(text)).view(np.int64)
                yield pd.DataFrame({"text_id": key, "word": found})

    words = texts.mapInPandas(cut, "text_id long, word long")
    most = max(OWN_LEAST, int(OWN_SHARE * texts.count()))
    rare = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("word")
    return texts.join(words.join(rare, "word").groupBy("text_id").agg(F.collect_list("word").alias("own")), "text_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))


def item_grams(texts: DataFrame) -> DataFrame:
    """text_id, at, gram of every n-gram of the item texts long enough to hold a passage."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["text_id"], batch["text"], strict=True):
                words = word_hashes(text)
                if len(words) >= RUN:
                    found = grams(words)
                    yield pd.DataFrame({"text_id": key, "at": np.arange(len(found)), "gram": found})

    return texts.mapInPandas(cut, "text_id long, at long, gram long")


def _bits(grams_: np.ndarray, size: int = BLOOM) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each n-gram in a Bloom filter."""
    g = grams_.view(np.uint64)
    return (g & np.uint64(size - 1)).astype(np.int64), ((g >> np.uint64(33)) & np.uint64(size - 1)).astype(np.int64)


def bloom(wanted: DataFrame, size: int = BLOOM) -> np.ndarray:
    """A Bloom filter of n-grams, `size` bits (a power of two) whatever their number, made where they are and joined by parts."""
    part = 1 << 20

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            for at in _bits(batch["gram"].to_numpy(dtype=np.int64), size):
                bits[at] = True
        packed = np.packbits(bits)
        yield pd.DataFrame({"part": range(0, len(packed), part), "bits": [packed[i : i + part].tobytes() for i in range(0, len(packed), part)]})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in rows["bits"]]).tobytes()]})

    out = np.zeros(size // 8, dtype=np.uint8)
    for r in wanted.mapInPandas(fill, "part long, bits binary").groupBy("part").applyInPandas(join, "part long, bits binary").collect():
        out[r.part : r.part + len(r.bits)] |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def gram_hits(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, gram, at: each place of a wanted n-gram in a document.

    The wanted ones are counted first; up to SENT_GRAMS they are sent to every worker. Beyond that a Bloom filter of fixed
    size is, and the n-grams that pass it are joined.
    """
    spark = documents.sparkSession
    exact = wanted.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS
    known = spark.sparkContext.broadcast(np.sort(wanted.toPandas()["gram"].to_numpy(dtype=np.int64)) if exact else bloom(wanted))

    def passed(found: np.ndarray) -> np.ndarray:
        if exact:
            return known.value[np.minimum(np.searchsorted(known.value, found), len(known.value) - 1)] == found if len(known.value) else np.zeros(len(found), dtype=bool)
        one, other = _bits(found)
        return (known.value[one >> 3] >> (7 - (one & 7)) & known.value[other >> 3] >> (7 - (other & 7)) & 1).astype(bool)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, hits, places = [], [], []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = grams(word_hashes(text))
                at = np.flatnonzero(passed(found)) if len(found) else found
                if len(at):
                    docs.append(np.full(len(at), key))
                    hits.append(found[at])
                    places.append(at)
            if docs:
                yield pd.DataFrame({"doc_id": np.concatenate(docs), "gram": np.concatenate(hits), "at": np.concatenate(places)})

    hits = documents.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInPandas(scan, "doc_id long, gram long, at long")
    return hits if exact else hits.join(wanted, "gram", "left_semi").select("doc_id", "gram", "at")


def seeds(found: DataFrame, hits: DataFrame) -> DataFrame:
    """text_id, gram: the rarest n-gram of each window of RUN words; of equally rare ones the one with the least hash."""
    counts = hits.select("gram", "doc_id").distinct().groupBy("gram").agg(F.count("*").alias("docs"))
    ranked = found.join(counts, "gram", "left").withColumn("rank", F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "gram"))
    width = RUN - SEED
    place = Window.partitionBy("text_id").orderBy("at")
    windows = ranked.select("text_id", F.min("rank").over(place.rowsBetween(0, width)).alias("best"), F.count("*").over(place.rowsBetween(0, width)).alias("n"))
    return windows.where(F.col("n") == width + 1).select("text_id", "best.gram").distinct()


def stretches(found: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, text_id, place: where documents have two n-grams of an item, no more than RUN words apart in it, and none of those between them."""
    places = hits.join(found.withColumnRenamed("at", "item_at"), "gram").groupBy("doc_id", "text_id", "item_at").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    step = F.col("item_at") - F.lag("item_at").over(Window.partitionBy("doc_id", "text_id").orderBy("item_at"))
    apart = places.select("doc_id", "text_id", "at", "last", step.alias("step")).where(F.col("step").between(2, RUN))
    return apart.select("doc_id", "text_id", F.explode(F.array("at", "last")).alias("place")).distinct()


def windows(places: list[int], words: int, size: int) -> list[tuple[int, int]]:
    """The stretches of a document of so many words that any local alignment through one of some places lies in, joined where they touch.

    An alignment of an item of `size` words pays for each word left out, so it spans no more than three times as many.
    """
    out: list[list[int]] = []
    for p in sorted(places):
        lo, hi = max(0, p - 3 * size), min(words, p + 3 * size + SEED)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """For each pair of word sequences the score of the best local alignment, and the length of the longest common run.

    Pairs of like sizes go through the recurrence together, padded with words that equal none: row by row over the shorter
    sequences; along a row the gaps are a running maximum, so each row is a few vector steps for TOGETHER pairs.
    """
    sides = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    order = sorted(range(len(sides)), key=lambda i: (len(sides[i][1]), len(sides[i][0])))
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        rows, width = max(len(sides[i][0]) for i in some), max(len(sides[i][1]) for i in some)
        a, b = np.zeros((len(some), rows), dtype=np.uint64), np.zeros((len(some), width), dtype=np.uint64)
        filled_a, filled_b = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
        for k, i in enumerate(some):
            x, y = sides[i]
            a[k, : len(x)], b[k, : len(y)], filled_a[k, : len(x)], filled_b[k, : len(y)] = x, y, True, True
        slope = np.arange(width + 1, dtype=np.int32) * -GAP
        score, run = np.zeros((len(some), width + 1), dtype=np.int32), np.zeros((len(some), width + 1), dtype=np.int32)
        best, longest = np.zeros(len(some), dtype=np.int32), np.zeros(len(some), dtype=np.int32)
        for r in range(rows):
            same = (b == a[:, r : r + 1]) & filled_b & filled_a[:, r : r + 1]
            new = score + GAP
            np.maximum(new[:, 1:], score[:, :-1] + np.where(same, EQUAL, UNEQUAL).astype(np.int32), out=new[:, 1:])
            np.maximum(new, 0, out=new)
            score = np.maximum.accumulate(new + slope, axis=1) - slope
            np.maximum(best, score.max(axis=1), out=best)
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            np.maximum(longest, run.max(axis=1), out=longest)
        for k, i in enumerate(some):
            out[i] = int(best[k]), int(longest[k])
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """align_all of one pair."""
    return align_all([(a, b)])[0]


def _prepared(text: str, own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An item's words, its own ones, and its runs of RUN words."""
    words = word_hashes(text)
    return words, np.array(own, dtype=np.int64).view(np.uint64), np.unique(grams(words, RUN))


_SCORED = "doc_id long, text_id long, score long, run_words long, item_words long, own_words long, leak boolean"


def aligned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, item_words, run_words, own_words of documents and items that share a seed or two stretches and may be leaks, and whether they are.

    Each document is sent once, with the places of all its items; only the words around those places are aligned. The words
    of the items are sent to every worker up to SENT_GRAMS, beyond that they go along with the places.
    """
    spark = documents.sparkSession
    documents, items = columns(documents, "doc_id", "text"), columns(items, "item_id", "text")
    keyed = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", F.xxhash64("text").alias("text_id")).distinct()
    texts = materialize(own_words(item_texts(items)), "item-texts")
    found = materialize(item_grams(texts), "item-grams")
    hits = materialize(gram_hits(documents, found.select("gram").distinct()), "gram-hits")
    by_seed = hits.join(seeds(found, hits), "gram").select("doc_id", "text_id", F.col("at").alias("place"))
    places = by_seed.unionByName(stretches(found, hits)).groupBy("doc_id", "text_id").agg(F.collect_set("place").alias("places"))
    sent = found.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS
    known = spark.sparkContext.broadcast({r.text_id: _prepared(r.text, r.own) for r in texts.collect()} if sent else {})
    if not sent:
        places = places.join(texts.select("text_id", F.col("text").alias("item_text"), "own"), "text_id")
    entry = F.struct("text_id", "places", *([] if sent else ["item_text", "own"]))
    asked = materialize(places.groupBy("doc_id").agg(F.collect_list(entry).alias("asked")), "places")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count() // DOCUMENTS_A_TASK)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, pairs, kept = [], [], []
            for doc, text, wanted in zip(batch["doc_id"], batch["text"], batch["asked"], strict=True):
                words = word_hashes(text)
                for w in wanted:
                    item, own, runs = known.value[w["text_id"]] if sent else _prepared(w["item_text"], w["own"])
                    for lo, hi in windows(list(w["places"]), len(words), len(item)):
                        part = words[lo:hi]
                        n = int(np.isin(own, part).sum())
                        enough = n >= max(min(2, len(own)), len(own) / KEPT)
                        if enough or np.isin(grams(part, RUN), runs).any():  # else it is no leak, however it aligns
                            keys.append((doc, w["text_id"], len(item)))
                            pairs.append((item, part))
                            kept.append((n, enough))
            rows = [(d, t, s, r, n, k, r >= RUN or s >= LEAK and enough) for (d, t, n), (s, r), (k, enough) in zip(keys, align_all(pairs), kept, strict=True)]
            yield pd.DataFrame(rows, columns=_SCORED.replace(" long", "").replace(" boolean", "").split(", "))

    with_text = documents.where("text IS NOT NULL").join(asked, "doc_id").repartition(tasks)
    scored = with_text.select("doc_id", "text", "asked").mapInPandas(score, _SCORED)
    best = scored.groupBy("doc_id", "text_id").agg(*[F.max(c).alias(c) for c in ("score", "run_words", "item_words", "own_words", "leak")])
    return best.join(keyed, "text_id").select("doc_id", "item_id", "score", "item_words", "run_words", "own_words", "leak")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, item_words, run_words, own_words of every document that holds an item, part of it or an edited copy."""
    return aligned(documents, items).where("leak").drop("leak")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found: doc_id, item_id of the leaks that share at least RUN consecutive words."""
    return leaks(documents, items).where(F.col("run_words") >= RUN).select("doc_id", "item_id")
