"""Deeply nested JSON records as flat related tables.

Each record is read by an incremental tokenizer with a stack of its own, which hands on path-value-ordinal triples while it
reads, some HELD at a time; neither a tree nor a list of a record's triples is built, and nesting has no limit. Triples
are grouped by the repeated ancestor they hang on, and each group is pivoted into one table whose rows name their parent;
the links between elements are read off those tables. Groups come from the data: every array that holds an object is one,
whatever its name, and so are the arrays of REPEATED. An object that is no element stays, as JSON text without the groups
below it, a field of the element it belongs to; so does an array of scalars. What is a group in one record is one in all. Such a value, and JSON text in place of an
array, is held whole until it ends.

Null, cut off or non-JSON bodies, and JSON that is no object, give no row. A lone object in place of an array that is
a group is its only element; JSON text in place of an array of TEXT_ARRAYS stands for the value it holds;
another scalar in place of an array is a field of that name. Wrapping objects aren't part of a path; of a name inside and
outside of them the first that isn't null counts, and of a name twice in one object the last. Of equally late records of a
topic the one with the greatest record_id counts. Null elements of `tags` are elements; those of other arrays are not,
though they count as ordinals. Half a surrogate pair, which no text can hold, is stored as U+FFFD.
"""

from __future__ import annotations

import math
import re
from collections.abc import Generator, Iterator
from functools import reduce
from json.decoder import scanstring
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import columns

#: Groups that are arrays in every record, by the names of their ancestors, and the table each goes to; others go to one of their own.
REPEATED = {"tags": "tags", "posts": "posts", "posts/link_counts": "links", "posts/polls": "polls", "posts/polls/options": "options"}
#: Objects of a record that only wrap others.
WRAPPERS = ("topic", "post_stream")
#: Arrays that may be stored as JSON text, and those whose null elements count.
TEXT_ARRAYS, NULL_ELEMENTS = ("tags", "posts"), ("tags",)
#: Triples, and characters of bodies, that are held until they are handed on.
HELD, HELD_TEXT = 16_384, 16 << 20

_BLANKS = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null")

Triple = tuple[str, str | None, str, int, str | None, str | None]


class _Out(list):
    """Triples on their way, of which the first `sent` have been handed on. Places are counted from the record's first triple."""

    __slots__ = ("sent", "voids")

    def __init__(self) -> None:
        super().__init__()
        self.sent = 0
        self.voids: list[tuple[int, int]] = []  # from and to where triples that were handed on are void

    def void(self, start: int, end: int) -> None:
        """Takes triples back."""
        if start < self.sent and start < end:
            self.voids.append((start, min(end, self.sent)))
        a, b = max(start - self.sent, 0), max(end - self.sent, 0)
        self[a:b] = [None] * (b - a)

    def hand_on(self) -> tuple[int, list]:
        """The place of the first triple held, and all that are held; void ones are None."""
        start, rows = self.sent, self[:]
        self.sent += len(rows)
        self.clear()
        return start, rows


class _Frame:
    """What is open at a point of the text: the record itself (R), an element (E), a wrapper (W), an object (O) or an array (A)."""

    __slots__ = ("form", "out", "up", "element", "group", "path", "parent", "kind", "ordinal", "key", "parts", "count", "repeated", "own", "taken")

    def __init__(self, form: str, out: _Out, up: _Frame | None, group: str = "", path: str = "topic", ordinal: int = 0) -> None:
        self.form, self.out, self.up, self.group, self.path, self.ordinal = form, out, up, group, path, ordinal
        self.element = up.element if up else None  # the element it belongs to
        self.key, self.count, self.repeated = "", 0, False
        self.parts: list = []  # of an object or array that is no group: its JSON text in parts
        self.own: dict[str, list[int]] = {}  # from and to where the triples of each key stand
        self.taken: dict[str, _Frame] = {}  # of a record: who holds the value of a name


class _Reader:
    """Reads one record. `more` are groups besides REPEATED whose lone objects are elements."""

    def __init__(self, more: frozenset[str] = frozenset()) -> None:
        self.known = frozenset(REPEATED) | more

    def read(self, text: str, top: _Frame, held: float = math.inf) -> Generator[tuple[int, list], None, bool]:
        """Reads one value into the frame that waits for it, handing triples on whenever `held` are there; False if the text is anything else."""
        i, stack, out = _BLANKS.match(text).end(), [top], top.out
        while True:
            if len(out) >= held:
                yield out.hand_on()
            frame, c = stack[-1], text[i : i + 1]
            if c == "{" or c == "[":
                stack.append(self._object(frame) if c == "{" else self._array(frame))
                i = _BLANKS.match(text, i + 1).end()
                if text[i : i + 1] != ("}" if c == "{" else "]"):
                    if c == "{" and (i := self._key(text, i, stack[-1])) < 0:
                        return False
                    continue
                self._close(stack.pop())
                i += 1
            elif c == '"':
                try:
                    value, i = scanstring(text, i + 1, True)
                except ValueError:
                    return False
                self._value(frame, value, None)
            elif m := _SCALAR.match(text, i):
                i, value = m.end(), m[0]
                if m[1] or m[2]:
                    number = repr(float(value))
                    value = value if number[-1] in "fn" else number
                self._value(frame, None if value == "null" else value, value)
            else:
                return False
            while True:  # after a value
                i = _BLANKS.match(text, i).end()
                if len(stack) == 1:
                    return i == len(text)
                frame, c = stack[-1], text[i : i + 1]
                if c == ",":
                    i = _BLANKS.match(text, i + 1).end()
                    if frame.form != "A" and (i := self._key(text, i, frame)) < 0:
                        return False
                    break
                if c != ("]" if frame.form == "A" else "}"):
                    return False
                self._close(stack.pop())
                i += 1

    def _key(self, text: str, i: int, frame: _Frame) -> int:
        """Reads a name and its colon; where its value begins, or -1."""
        if text[i : i + 1] != '"':
            return -1
        try:
            key, i = scanstring(text, i + 1, True)
        except ValueError:
            return -1
        i = _BLANKS.match(text, i).end()
        if text[i : i + 1] != ":":
            return -1
        out = frame.out
        here = out.sent + len(out)
        if frame.own:
            frame.own[frame.key][1] = here
        if key in frame.own:  # the same name again: what it gave before is void
            out.void(*frame.own[key])
            if frame.form == "O":
                frame.parts = [p for p in frame.parts if p[0] != key]
        frame.own[key] = [here, here]
        frame.key = key
        return _BLANKS.match(text, i + 1).end()

    @staticmethod
    def _sink(frame: _Frame) -> _Out:
        """Where the triples of a frame's present key go: nowhere if the record has a value of that name already."""
        if frame.form != "O" and frame.element.group == "" and frame.element.taken.setdefault(frame.key, frame) is not frame:
            return _Out()
        return frame.out

    @staticmethod
    def _below(frame: _Frame) -> tuple[str, str]:
        """Group and path of what a frame's key holds."""
        return f"{frame.group}/{frame.key}" if frame.group else frame.key, frame.key if frame.path == "topic" else f"{frame.path}/{frame.key}"

    @staticmethod
    def _element(up: _Frame, out: _Out, group: str, path: str, ordinal: int) -> _Frame:
        """Opens an element and emits it."""
        e = _Frame("E", out, up, group, path, ordinal)
        e.parent, e.kind = up.element.path if up.element else None, REPEATED.get(group, group) if group else "topic"
        e.element = e
        out.append((e.kind, e.parent, path, ordinal, None, None))
        return e

    @staticmethod
    def _emit(e: _Frame, out: _Out, field: str, value: str | None) -> None:
        out.append((e.kind, e.parent, e.path, e.ordinal, field, value))

    def _object(self, frame: _Frame) -> _Frame:
        if frame.form == "R":
            return self._element(frame, frame.out, "", "topic", 0)
        if frame.form == "A":
            self._promote(frame)
            return self._element(frame, frame.out, frame.group, f"{frame.path}/{frame.count}", frame.count)
        if frame.form != "O" and frame.element.group == "" and frame.key in WRAPPERS:
            return _Frame("W", frame.out, frame)
        group, path = self._below(frame)
        out = self._sink(frame)
        return self._element(frame, out, group, f"{path}/0", 0) if group in self.known else _Frame("O", out, frame, group, path)

    def _array(self, frame: _Frame) -> _Frame:
        if frame.form in "RA":
            a = _Frame("A", frame.out, frame, ordinal=frame.count)
            if f"{frame.group}/[]" in self.known:
                self._promote(a)
            return a
        group, path = self._below(frame)
        a = _Frame("A", self._sink(frame), frame, group, path)
        a.repeated = group in self.known
        return a

    def _promote(self, array: _Frame) -> None:
        """An array turns out to be a group: what it held so far are elements, and so is it if it stands in an array."""
        chain = [array]
        while chain[-1].form == "A" and not chain[-1].repeated:
            chain.append(chain[-1].up)
        for a in reversed(chain[:-1]):
            a.repeated = True
            if a.up.form == "A":
                a.group, a.path = f"{a.up.group}/[]", f"{a.up.path}/{a.ordinal}"
                a.element = self._element(a.up, a.out, a.up.group, a.path, a.ordinal)
            held, a.parts, a.count = a.parts, [], 0
            for value, text in held:
                self._value(a, value, text)

    def _close(self, frame: _Frame) -> None:
        """Hands a finished object or array, as JSON text, to what holds it; elements and groups have been emitted."""
        if frame.form == "O":
            text = "{" + ", ".join(f"{encode_basestring(k)}: {t}" for k, t in frame.parts) + "}"
            self._value(frame.up, text, text)
        elif frame.form == "A" and not frame.repeated:
            text = "[" + ", ".join(encode_basestring(v) if t is None else t for v, t in frame.parts) + "]"
            self._value(frame.up, text, text)
        elif frame.up.form == "A":
            frame.up.count += 1

    def _value(self, frame: _Frame, value: str | None, text: str | None) -> None:
        """Takes a value, given as what is stored and, unless it is a string, its JSON text."""
        if frame.form == "A":
            if not frame.repeated:
                frame.parts.append((value, text))
            elif value is not None or frame.group in NULL_ELEMENTS:
                e = self._element(frame, frame.out, frame.group, f"{frame.path}/{frame.count}", frame.count)
                if value is not None:
                    self._emit(e, frame.out, "value", value)
            frame.count += 1
        elif frame.form == "O":
            frame.parts.append((frame.key, encode_basestring(value) if text is None else text))
        elif frame.form != "R":
            known = self._below(frame)[0] in self.known
            if value is None:
                if not known:
                    self._emit(frame.element, frame.out, frame.key, None)
            elif not (known and text is None and frame.element.group == "" and frame.key in TEXT_ARRAYS and self._nested(frame, value)):
                self._emit(frame.element, self._sink(frame), frame.key, value)

    def _nested(self, frame: _Frame, text: str) -> bool:
        """Reads JSON text in place of an array; False if it holds neither an array nor an object."""
        begin = _BLANKS.match(text).end()
        if text[begin : begin + 1] not in ("[", "{"):
            return False
        found = _Out()
        holder = _Frame("E", found, frame.up, frame.group, frame.path)
        holder.element, holder.key = frame.element, frame.key
        taken = frame.element.taken
        before = taken.get(frame.key)
        taken[frame.key] = holder
        ok = _end(self.read(text, holder))
        if before is None:
            del taken[frame.key]
        else:
            taken[frame.key] = before
        if ok:
            self._sink(frame).extend(found)
        return ok


def _end(reading: Generator) -> object:
    """What a generator returns in the end."""
    while True:
        try:
            next(reading)
        except StopIteration as e:
            return e.value


def stream(text: str | None, more: frozenset[str] = frozenset(), held: float = HELD) -> Generator[tuple[int, list[Triple | None]], None, list[tuple[int, int]] | None]:
    """Hands on (kind, parent_path, path, ordinal, field, value) of one record while it is read: the place of the first, and some in a row.

    A triple with a null field is an element itself; None in place of one was taken back. Returns from and to where triples
    handed on before are void, or None if the text is no JSON object and all of them are.
    """
    if text is None or not text.startswith("{", _BLANKS.match(text).end()):
        return None
    out = _Out()
    if not (yield from _Reader(more).read(text, _Frame("R", out, None), held)):
        return None
    yield out.hand_on()
    return out.voids


def triples(text: str | None, more: frozenset[str] = frozenset()) -> list[Triple] | None:
    """All triples of one record; None if the text is no JSON object."""
    reading, found = stream(text, more, math.inf), []
    while True:
        try:
            found += [t for t in next(reading)[1] if t is not None]
        except StopIteration as e:
            return None if e.value is None else found


def topic_of(path: Column) -> Column:
    """The number in a file path; null where there is none."""
    return F.regexp_extract(path, r"([0-9]+)[^/0-9]*$", 1).try_cast("long")


_TRIPLES = "record_id long, seq long, kind string, parent_path string, path string, ordinal long, field string, value string"
_RECORDS = "topic_id long, fetched_at timestamp_ntz, voids array<struct<start:long,end:long>>"
_COLUMNS = pa.schema([
    ("record_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("parent_path", pa.string()), ("path", pa.string()), ("ordinal", pa.int64()), ("field", pa.string()), ("value", pa.string()),
    ("topic_id", pa.int64()), ("fetched_at", pa.timestamp("us")), ("voids", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def _texts(values: tuple[str | None, ...]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v and v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())


def _batch(**known: list | pa.Array) -> pa.RecordBatch:
    """A batch of _COLUMNS; those not given are null."""
    n = len(known["record_id"])
    arrays = [pa.nulls(n, c.type) if (v := known.get(c.name)) is None else v if isinstance(v, pa.Array) else pa.array(v, c.type) for c in _COLUMNS]
    return pa.RecordBatch.from_arrays(arrays, schema=_COLUMNS)


class _Rows:
    """Triples of one record after another, as batches."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.places: list[int] = []
        self.rows: list[Triple] = []
        self.text = 0

    def add(self, record_id: int, start: int, rows: list[Triple | None]) -> None:
        kept = [t for t in rows if t is not None]
        self.places += range(start, start + len(rows)) if len(kept) == len(rows) else [start + i for i, t in enumerate(rows) if t is not None]
        self.ids += [record_id] * len(kept)
        self.rows += kept

    def batch(self) -> pa.RecordBatch:
        kinds, parents, paths, ordinals, fields, values = zip(*self.rows, strict=True)
        return _batch(record_id=self.ids, seq=self.places, kind=_texts(kinds), parent_path=_texts(parents), path=_texts(paths), ordinal=list(ordinals), field=_texts(fields), value=_texts(values))


def _latest_triples(files: DataFrame, known: frozenset[str]) -> DataFrame:
    """The triples of the latest record of each topic whose body is a JSON object, where REPEATED and `known` are groups.

    Triples are written as they come, a row each; a row without a kind closes each record that turned out to be an object.
    The choice of the latest record reads those rows only.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Rows()
        for batch in batches:
            closed, voids = [], []
            for i, (record_id, body) in enumerate(zip(batch.column("record_id"), batch.column("body"), strict=True)):
                record_id, text = record_id.as_py(), body.as_py()
                reading = stream(text, known)
                while True:
                    try:
                        held.add(record_id, *next(reading))
                    except StopIteration as e:
                        if e.value is not None:
                            closed.append(i)
                            voids.append(e.value or None)
                        break
                    if len(held.rows) >= HELD:
                        yield held.batch()
                        held = _Rows()
                held.text += len(text)
                if held.rows and held.text >= HELD_TEXT:
                    yield held.batch()
                    held = _Rows()
            kept = batch.take(pa.array(closed, pa.int64()))
            yield _batch(record_id=kept.column("record_id"), topic_id=kept.column("topic_id"), fetched_at=kept.column("fetched_at"), voids=[v and [{"start": a, "end": b} for a, b in v] for v in voids])
        if held.rows:
            yield held.batch()

    keyed = columns(files, "record_id", "file_path", "fetched_at", "body").select(F.col("record_id").cast("long"), topic_of(F.col("file_path")).alias("topic_id"), F.col("fetched_at").cast("timestamp_ntz"), "body").where("topic_id IS NOT NULL AND body IS NOT NULL")
    records = materialize(keyed.mapInArrow(read, f"{_TRIPLES}, {_RECORDS}"), "records")
    last = F.max_by(F.struct("record_id", "voids"), F.struct("fetched_at", "record_id"))
    chosen = materialize(records.where("kind IS NULL").groupBy("topic_id").agg(last.alias("r")).select("topic_id", "r.*"), "latest")
    kept = records.where("kind IS NOT NULL").drop("topic_id", "fetched_at", "voids").join(chosen, "record_id")
    return kept.where("voids IS NULL OR NOT exists(voids, v -> v.start <= seq AND seq < v.end)").select("topic_id", "record_id", "kind", "parent_path", "path", "ordinal", "field", "value")


def groups(found: DataFrame) -> list[str]:
    """The groups that the data has besides REPEATED: names of arrays, as few as a schema has."""
    return [r.kind for r in found.where(~F.col("kind").isin("topic", *REPEATED.values())).select("kind").distinct().orderBy("kind").collect()]


def record_triples(files: DataFrame) -> DataFrame:
    """The triples of the latest record of each topic whose body is a JSON object, each with the repeated ancestor it hangs on.

    Every body is read once if REPEATED are all groups. Others are repeated in some records and may be a lone object in
    others, so where there are any, bodies are read again with those known.
    """
    known: frozenset[str] = frozenset()
    while True:
        found = _latest_triples(files, known)
        if known.issuperset(more := groups(found)):
            return found
        known |= frozenset(more)


def by_ancestor(found: DataFrame) -> GroupedData:
    """Triples grouped by the repeated ancestor they hang on: an element of an array, or the topic."""
    return found.groupBy("kind", "topic_id", "parent_path", "path", "ordinal")


def pivot(found: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """The table of one kind: topic_id, parent_path, path, ordinal, the given fields cast to their types, and `rest`, a map of all others."""
    rows = found.where(F.col("kind") == kind)
    named = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    others = F.map_from_entries(F.sort_array(F.collect_set(F.when(F.col("field").isNotNull() & F.col("value").isNotNull() & ~F.coalesce(F.col("field").isin(*fields), F.lit(False)), F.struct("field", "value")))))
    flat = by_ancestor(rows).agg(*named, others.alias("rest"))
    return flat.select("topic_id", "parent_path", "path", "ordinal", *[F.expr(f"try_cast(`{f}` AS {t})").alias(f) for f, t in fields.items()], "rest")


def others(found: DataFrame) -> DataFrame:
    """Every element of the groups the data has besides REPEATED: kind, topic_id, parent_path, path, ordinal, and its fields in `rest`."""
    rows = found.where(~F.col("kind").isin("topic", *REPEATED.values()))
    entries = F.collect_set(F.when(F.col("field").isNotNull() & F.col("value").isNotNull(), F.struct("field", "value")))
    return by_ancestor(rows).agg(F.map_from_entries(F.sort_array(entries)).alias("rest"))


#: Known fields of each table.
TABLES = {
    "topic": {"id": "bigint", "title": "string", "slug": "string", "category_id": "bigint", "category_name": "string", "created_at": "timestamp", "last_posted_at": "timestamp", "bumped_at": "timestamp", "views": "bigint", "like_count": "bigint", "posts_count": "bigint", "reply_count": "bigint", "pinned": "boolean", "closed": "boolean", "archived": "boolean"},
    "posts": {"id": "bigint", "post_number": "bigint", "username": "string", "created_at": "timestamp", "updated_at": "timestamp", "plain_text": "string", "like_count": "bigint", "reads": "bigint", "reply_to_post_number": "bigint"},
    "tags": {"id": "bigint", "name": "string", "slug": "string", "value": "string"},
    "links": {"url": "string", "internal": "boolean", "clicks": "bigint"},
    "polls": {"name": "string"},
    "options": {"id": "string", "label": "string", "votes": "bigint"},
}


def element_paths(found: DataFrame) -> DataFrame:
    """topic_id, parent_path, child_path of every row of the tables of REPEATED."""
    tables = [pivot(found, kind, TABLES[kind]) for kind in REPEATED.values()]
    return reduce(DataFrame.unionByName, [t.select("topic_id", "parent_path", F.col("path").alias("child_path")) for t in tables])


def flat_table(files: DataFrame, kind: str) -> DataFrame:
    """One of TABLES from nested records, or that of another group by its name."""
    return pivot(record_triples(files), kind, TABLES.get(kind, {}))
