"""Cutting oversized items into pieces under a limit, at natural boundaries, with overlap, range by range.

An item is a sequence of units: the characters of a text, the entries of a list, or the bytes of a file. It is read as
ranges of a fixed size. Workers find the boundaries of each range by itself (with a halo of what stands just before it);
the boundary tables, a few numbers a range, are stitched by running values over the ranges of an item, span by span; the last boundary
of each range is an anchor at which a piece ends, so that every range then emits its own pieces by offset. No task ever
holds a whole item, and no table has a row for each boundary.

Nulls: an item that is null or no longer than the limit is not oversized and gives no row. Rows that are repeated must be
removed before. A stretch of more than `limit` units without a boundary is cut at the limit.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from ..sources.tables import columns, latest

#: Units in a range. A boundary table keeps the first and last boundary of each block of a sixteenth of a piece.
RANGE_CHARS, RANGE_ENTRIES, RANGE_BYTES, BLOCKS = 1 << 16, 1 << 12, 8 << 20, 16

_BREAKS = re.compile(r"[\s。！？]")
_BYTE_BREAKS = re.compile(rb"[\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80[\x80\x82]|\xef\xbc[\x81\x9f]")
_PART = re.compile(r"(.*)-p([1-9][0-9]*)", re.S)
_FOUND = "item_key string, n long, range_no long, range_start long, is_last boolean, first_stop long, last_go long, inner_gap long, cuts array<long>"
#: Ranges of files that a task reads, about.
RANGES_A_TASK = 4
#: Ranges that a running value is carried over at once; what precedes them comes from a table with a row for each so many.
SPAN = 4096


def text_breaks(body: str, halo: str) -> list[tuple[int, int]]:
    """(stop, go) of each white space or mark: the stretch before it ends at stop, the next one begins at go."""
    return [m.span() for m in _BREAKS.finditer(body)]


def list_breaks(body: list, halo: str | None) -> list[tuple[int, int]]:
    """The places before entries that continue no other; halo is the entry before the first one.

    `<chunk>-p1` continues `<chunk>`, and `<chunk>-p<n+1>` continues `<chunk>-p<n>`, if that is the entry just before it.
    """
    found, before = [], halo
    for i, entry in enumerate(body):
        m = _PART.fullmatch(entry or "")
        continues = m and before == (m[1] if m[2] == "1" else f"{m[1]}-p{int(m[2]) - 1}")
        if not continues:
            found.append((i, i))
        before = entry
    return found


def byte_breaks(body: bytes, halo: bytes) -> list[tuple[int, int]]:
    """As text_breaks in UTF-8 bytes; a mark that began in the halo counts from where the range begins."""
    return [(max(0, a - len(halo)), b - len(halo)) for a, b in (m.span() for m in _BYTE_BREAKS.finditer(halo + body)) if b > len(halo)]


def _summary(breaks: list[tuple[int, int]], start: int, width: int) -> tuple:
    """First stop, last go, longest stretch between and the boundary table of a range, in places of the item."""
    if not breaks:
        return None, None, 0, []
    inner = max((b[0] - a[1] for a, b in zip(breaks, breaks[1:], strict=False)), default=0)
    cuts: list[int] = []
    for _, go in breaks:
        if len(cuts) >= 2 and cuts[-1] // width == go // width == cuts[-2] // width:
            cuts[-1] = go
        else:
            cuts.append(go)
    return start + breaks[0][0], start + breaks[-1][1], inner, [start + x for x in cuts]


def _scan(ranges: DataFrame, find: Callable, width: int) -> DataFrame:
    """The boundary table of each range (item_key, n, range_no, range_start, body, halo)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.item_key, r.n, r.range_no, r.range_start, r.range_start + len(r.body) >= r.n, *_summary(find(r.body, r.halo), r.range_start, width)) for r in batch.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=["item_key", "n", "range_no", "range_start", "is_last", "first_stop", "last_go", "inner_gap", "cuts"])
            yield out.astype({"first_stop": "Int64", "last_go": "Int64"})

    return materialize(ranges.mapInPandas(scan, _FOUND), "boundaries")


def text_ranges(items: DataFrame, limit: int, size: int = RANGE_CHARS) -> DataFrame:
    """Ranges of the texts (item_key, body) over the limit, each text read once from front to back.

    The quantifier is possessive: a greedy one recurses wherever characters of one and of two code units meet.
    """
    parts = items.where(F.length("body") > limit).select("item_key", F.length("body").cast("long").alias("n"), F.posexplode(F.regexp_extract_all("body", F.lit("(?s).{1,%d}+" % size), F.lit(0))).alias("range_no", "body"))
    return parts.select("item_key", "n", F.col("range_no").cast("long").alias("range_no"), (F.col("range_no") * F.lit(size).cast("long")).alias("range_start"), "body", F.lit("").alias("halo"))


def list_ranges(items: DataFrame, limit: int, size: int = RANGE_ENTRIES) -> DataFrame:
    """Ranges of the lists (item_key, body) over the limit, each with the entry before it."""
    n = F.size("body")
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda at: F.struct(at.alias("at"), F.slice("body", at + 1, size).alias("body"), F.when(at > 0, F.get("body", at - 1)).alias("halo")))
    parts = items.where(n > limit).select("item_key", n.cast("long").alias("n"), F.explode(cut).alias("r"))  # each row has its own entries alone
    return parts.select("item_key", "n", (F.col("r.at") / size).cast("long").alias("range_no"), F.col("r.at").cast("long").alias("range_start"), "r.body", "r.halo")


def file_ranges(spark: SparkSession, paths: list[str], limit: int, size: int = RANGE_BYTES) -> DataFrame:
    """Ranges of files (or of those in folders): places only; workers read the bytes they need. The listing is Spark's, which reads no content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    files = listed.select(F.regexp_replace("path", "^file:/+", "file:///").alias("item_key"), F.col("length").alias("n")).where(F.col("n") > limit)
    parts = files.select("item_key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("range_start"))
    tasks = max(1, parts.count() // RANGES_A_TASK)
    return parts.repartition(tasks).select("item_key", "n", (F.col("range_start") / size).cast("long").alias("range_no"), "range_start")


def read_bytes(uri: str, start: int, size: int) -> bytes:
    """Bytes of a file, without reading the rest."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, start)


def scan_files(ranges: DataFrame, size: int, width: int) -> DataFrame:
    """Boundary tables of file ranges; the halo is the three bytes before, as many as a mark may have begun with."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                head = min(3, r.range_start)
                data = read_bytes(r.item_key, r.range_start - head, min(size, r.n - r.range_start) + head)
                rows.append((r.item_key, r.n, r.range_no, r.range_start, r.range_start + size >= r.n, *_summary(byte_breaks(data[head:], data[:head]), r.range_start, width)))
            out = pd.DataFrame(rows, columns=["item_key", "n", "range_no", "range_start", "is_last", "first_stop", "last_go", "inner_gap", "cuts"])
            yield out.astype({"first_stop": "Int64", "last_go": "Int64"})

    return materialize(ranges.mapInPandas(scan, _FOUND), "boundaries")


def _before(ranges: DataFrame, value: Column, how: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """ranges (item_key, range_no, ...) with a running aggregate of what precedes each range in its item, null before the first.

    It runs over SPAN ranges at once, and over spans by their aggregates, so that no task sorts all ranges of an item.
    """
    rows = ranges.withColumns({"_v": value, "_span": (F.col("range_no") / SPAN).cast("long")})
    item, ahead = Window.partitionBy("item_key").orderBy("_span"), Window.partitionBy("item_key", "_span").orderBy("range_no")
    spans = rows.groupBy("item_key", "_span").agg(how(F.col("_v")).alias("_t"))
    carried = spans.select("item_key", "_span", how(F.col("_t")).over(item.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inner = rows.withColumn("_inner", how(F.col("_v")).over(ahead.rowsBetween(Window.unboundedPreceding, -1)))
    both = inner.join(carried, ["item_key", "_span"])
    return both.withColumn(name, F.coalesce(join(F.col("_inner"), F.col("_carry")), "_inner", "_carry")).drop("_v", "_span", "_inner", "_carry")


def stitch(found: DataFrame) -> DataFrame:
    """Boundary tables with, for each range, where the part it emits begins (from_cut) and ends (to_cut), and the stretch that ends in it.

    Only a few numbers a range pass through the running maximum; the tables of cuts are attached where they are needed.
    """
    slim = _before(found.drop("cuts"), F.col("last_go"), F.max, F.greatest, "from_cut").withColumn("from_cut", F.coalesce("from_cut", F.lit(0).cast("long")))
    return slim.withColumns(
        {
            "to_cut": F.when(F.col("is_last"), F.col("n")).otherwise(F.col("last_go")),
            "stretch": F.greatest("inner_gap", F.col("first_stop") - F.col("from_cut"), F.when(F.col("is_last"), F.col("n") - F.coalesce("last_go", "from_cut"))),
        }
    )


def cut_kinds(stitched: DataFrame, limit: int) -> DataFrame:
    """item_key, cut_kind: `inside` if some stretch without a boundary is over the limit, else `boundary`."""
    return stitched.groupBy("item_key").agg(F.when(F.max("stretch") > limit, "inside").otherwise("boundary").alias("cut_kind"))


def _emit(start: int, end: int, cuts: list[int], limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, whether it ends at a boundary) of one part; the piece before it ended at start."""
    pieces, cut = [], start
    while cut < end:
        begin = max(0, cut - overlap) if cut else 0
        reach = begin + limit
        if reach >= end:
            new, natural = end, True
        else:
            i = bisect.bisect_right(cuts, reach)
            natural = bool(i) and cuts[i - 1] > cut
            new = cuts[i - 1] if natural else reach
        pieces.append((begin, new, natural))
        cut = new
    return pieces


def piece_places(found: DataFrame, limit: int, overlap: int) -> DataFrame:
    """item_key, piece_no, start_at, end_at, natural_end. Pieces are numbered by prefix sums of their counts over the ranges."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    @F.pandas_udf("array<struct<start_at:long,end_at:long,natural_end:boolean>>")
    def emit(start: pd.Series, end: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([[{"start_at": a, "end_at": b, "natural_end": c} for a, b, c in _emit(int(s), int(e), list(k), limit, overlap)] for s, e, k in zip(start, end, cuts, strict=True)])

    parts = stitch(found).where("to_cut > from_cut").join(found.select("item_key", "range_no", "cuts"), ["item_key", "range_no"])
    parts = materialize(parts.select("item_key", "range_no", emit("from_cut", "to_cut", "cuts").alias("pieces")), "pieces")
    counts = _before(parts.select("item_key", "range_no", F.size("pieces").cast("long").alias("k")), F.col("k"), F.sum, lambda a, b: a + b, "first_no")
    counted = counts.join(parts, ["item_key", "range_no"])
    rows = counted.select("item_key", F.coalesce("first_no", F.lit(0)).alias("first_no"), F.posexplode("pieces").alias("i", "p"))
    return rows.select("item_key", (F.col("first_no") + F.col("i")).alias("piece_no"), "p.start_at", "p.end_at", "p.natural_end")


def _assembled(ranges: DataFrame, places: DataFrame, size: int, cut: Callable, join: Callable) -> DataFrame:
    """Pieces with their body, put together from the ranges they touch."""
    touched = places.withColumn("range_no", F.explode(F.sequence((F.col("start_at") / size).cast("long"), ((F.col("end_at") - 1) / size).cast("long"))))
    parts = touched.join(ranges.select("item_key", "range_no", "range_start", "body"), ["item_key", "range_no"])
    begin = F.greatest(F.col("start_at") - F.col("range_start"), F.lit(0))
    part = cut(F.col("body"), begin, F.col("end_at") - F.col("range_start") - begin)
    found = parts.groupBy("item_key", "piece_no", "start_at", "end_at", "natural_end").agg(F.sort_array(F.collect_list(F.struct("range_no", part.alias("part")))).alias("parts"))
    return found.select("item_key", "piece_no", "start_at", "end_at", "natural_end", join(F.transform("parts", lambda x: x["part"])).alias("body"))


def split_texts(items: DataFrame, limit: int = 2000, overlap: int = 200, size: int = RANGE_CHARS) -> DataFrame:
    """Pieces of the texts (item_key, body) over the limit: item_key, piece_no, start_at, end_at, natural_end, body."""
    ranges = text_ranges(items, limit, size)
    places = piece_places(_scan(ranges, text_breaks, max(1, limit // BLOCKS)), limit, overlap)
    return _assembled(ranges, places, size, lambda b, at, n: F.substr(b, (at + 1).cast("int"), n.cast("int")), lambda parts: F.array_join(parts, ""))


def split_lists(items: DataFrame, limit: int = 12, overlap: int = 1, size: int = RANGE_ENTRIES) -> DataFrame:
    """Pieces of the lists (item_key, body) over the limit, with the entries of each as body."""
    ranges = list_ranges(items, limit, size)
    places = piece_places(_scan(ranges, list_breaks, 1), limit, overlap)
    return _assembled(ranges, places, size, lambda b, at, n: F.slice(b, (at + 1).cast("int"), F.least(n, F.lit(size)).cast("int")), F.flatten)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, size: int = RANGE_BYTES) -> DataFrame:
    """Places of the pieces of giant UTF-8 files, in bytes: item_key, piece_no, start_at, end_at, natural_end; read_bytes gives a piece."""
    return piece_places(scan_files(file_ranges(spark, paths, limit, size), size, max(1, limit // BLOCKS)), limit, overlap)


def posts_items(posts: DataFrame) -> DataFrame:
    """(item_key, body): the plain_text of each post id in the version with the latest updated_at."""
    rows = columns(posts, "id", "plain_text", "updated_at").select("id", "plain_text", F.expr("try_cast(updated_at AS timestamp)").alias("at"))
    return latest(rows, "id", "at", ["plain_text"]).select(F.col("id").cast("string").alias("item_key"), F.col("plain_text").alias("body"))


def status_items(status: DataFrame) -> DataFrame:
    """(item_key, body): the chunks_list of each doc_id in the row with the latest updated_at."""
    rows = columns(status, "doc_id", "chunks_list", "updated_at").select("doc_id", "chunks_list", F.expr("try_cast(updated_at AS timestamp)").alias("at"))
    return latest(rows, "doc_id", "at", ["chunks_list"]).select(F.col("doc_id").alias("item_key"), F.col("chunks_list").alias("body"))


def found(posts: DataFrame, status: DataFrame, text_limit: int = 2000, list_limit: int = 12) -> DataFrame:
    """p3_found: field_name, item_key, cut_kind."""
    texts = text_ranges(posts_items(posts).where(F.length("body") > text_limit).distinct(), text_limit)
    lists = list_ranges(status_items(status).where(F.size("body") > list_limit).distinct(), list_limit)
    a = cut_kinds(stitch(_scan(texts, text_breaks, max(1, text_limit // BLOCKS))), text_limit).select(F.lit("plain_text").alias("field_name"), "item_key", "cut_kind")
    b = cut_kinds(stitch(_scan(lists, list_breaks, 1)), list_limit).select(F.lit("chunks_list").alias("field_name"), "item_key", "cut_kind")
    return a.unionByName(b)


def pieces(posts: DataFrame, status: DataFrame) -> DataFrame:
    """Every piece of every oversized post and list: field_name, item_key, piece_no, start_at, end_at, natural_end, body (entries joined by line ends)."""
    texts = split_texts(posts_items(posts).where(F.length("body") > 2000).distinct())
    lists = split_lists(status_items(status).where(F.size("body") > 12).distinct())
    lists = lists.withColumn("body", F.array_join(F.transform("body", lambda x: F.coalesce(x, F.lit(""))), "\n"))
    return texts.select(F.lit("plain_text").alias("field_name"), "*").unionByName(lists.select(F.lit("chunks_list").alias("field_name"), "*"))


def rejoined(spark: SparkSession, documents: DataFrame, limit: int = 4000, overlap: int = 400, size: int = 1 << 16) -> DataFrame:
    """item_key, bytes, within, digest: texts written as one file a language, split by byte ranges, and put together from the pieces again.

    The digest is that of what the pieces add, so it is the file's if no byte is lost or repeated; within tells whether every piece is
    within the limit. The files are several ranges long, so that boundaries are stitched and pieces numbered across ranges.
    """
    folder = shared_path(spark, "files")
    texts = columns(documents, "doc_id", "lang", "text").where("text IS NOT NULL").select(F.concat(F.lit("x"), F.hex(F.coalesce("lang", F.lit("")))).alias("l"), "doc_id", "text")
    texts.repartition("l").sortWithinPartitions("l", "doc_id").select("l", "text").write.partitionBy("l").text(folder)
    places = split_files(spark, [folder], limit, overlap, size)
    before = F.coalesce(F.lag("end_at").over(Window.partitionBy("item_key").orderBy("piece_no")), F.lit(0))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["added"] = [read_bytes(k, int(a), int(b - a)) for k, a, b in zip(batch["item_key"], batch["done"], batch["end_at"], strict=True)]
            yield batch[["item_key", "piece_no", "start_at", "end_at", "added"]]

    parts = places.select("item_key", "piece_no", "start_at", "end_at", before.alias("done")).mapInPandas(read, "item_key string, piece_no long, start_at long, end_at long, added binary")
    whole = parts.groupBy("item_key").agg(F.max("end_at").alias("bytes"), F.max(F.col("end_at") - F.col("start_at")).alias("most"), F.sort_array(F.collect_list(F.struct("piece_no", F.hex("added").alias("x")))).alias("p"))
    digest = F.md5(F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), "")))
    return whole.select(F.regexp_extract("item_key", "/l=(x[0-9A-F]*)/", 1).alias("item_key"), "bytes", (F.col("most") <= limit).alias("within"), digest.alias("digest"))
