"""Schemas that drift between files: one consistent table and a report of each change.

Every line is parsed into a tagged union: each field keeps the JSON type it came with (its alternative) beside the
canonical forms its value has as a moment, as a set of tags and as a plain value. Per-file schemas are fused from partial
aggregates; conflicts between files are told by comparing the alternatives of a field along its lineage, renames by
comparing canonical forms of the same record in neighbouring files, for which only the names that go or come are read
again. Only names and types, a few rows a file, reach the per-feed walk; values never do. The consistent table has the
columns that the lineages have, whatever they are called.

Lines that are null or no JSON object don't count, nor does a file without any that do. Repeated lines count once. Null
and empty arrays are no values. Records without an id take no part in the
comparison of values and are rows of their own. A name that goes and one
that comes are paired one to one, those with more common records first, then by name; without a common record there is
no rename.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import columns

RECORD_ID = "id"
_PARSED = "feed string, file_no int, line_no int, loaded_at timestamp_ntz, rid string, field string, alternative string, moment long, tags array<string>, plain string"
_NUMERIC = re.compile(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?")
_ISO = re.compile(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?\s*(Z|z|UTC|GMT|[+-]\d\d:?(\d\d)?)?)?")
_DOTTED = re.compile(r"(\d\d?)\.(\d\d?)\.(\d{4})(?:[ T,]+(\d\d?):(\d\d)(?::(\d\d))?)?")
_NAMED = re.compile(r"[A-Za-z]{3,9},? \d{1,2} [A-Za-z]{3} \d{4} .*|\d{1,2} [A-Za-z]{3} \d{4} .*")
#: Seconds and milliseconds since 1970 that are taken for moments: 1980 to 2100.
_SECONDS = (315_532_800, 4_102_444_800)


class Fraction(float):
    """A number written with a point, with its digits."""

    def __new__(cls, text: str) -> Fraction:
        self = super().__new__(cls, text)
        self.text = text
        return self


def _no_constant(name: str) -> None:
    raise ValueError(name)


def record_of(line: str | None) -> dict | None:
    """The object of a line, or None."""
    try:
        found = json.loads(line, parse_float=Fraction, parse_constant=_no_constant) if line is not None else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def alternative(value: object) -> str | None:
    """The JSON type of a value; None for what is no value."""
    if value is None or value == []:
        return None
    if isinstance(value, list):
        inner = sorted({t for x in value if (t := alternative(x))})
        return f"array<{'|'.join(inner)}>" if inner else None
    return next(name for kind, name in ((str, "string"), (bool, "boolean"), (int, "integer"), (float, "float"), (dict, "object")) if isinstance(value, kind))


def _ms(moment: datetime) -> int:
    moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
    return round((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000)


def moment_of(value: object) -> int | None:
    """Milliseconds since 1970 of a time in any of the known notations."""
    if isinstance(value, dict):
        return moment_of(next(iter(value.values()))) if len(value) == 1 and not isinstance(next(iter(value.values())), dict) else None
    if isinstance(value, bool) or value is None or isinstance(value, list):
        return None
    text = value.strip() if isinstance(value, str) else str(getattr(value, "text", value))
    try:
        if _NUMERIC.fullmatch(text):
            number = float(text)
            return round(number * 1000) if _SECONDS[0] <= number < _SECONDS[1] else round(number) if _SECONDS[0] * 1000 <= number < _SECONDS[1] * 1000 else None
        if _ISO.fullmatch(text):
            return _ms(datetime.fromisoformat(re.sub(r"\s*(UTC|GMT)$", "Z", text.replace("z", "Z"))))
        if m := _DOTTED.fullmatch(text):
            day, month, year, *clock = (int(x or 0) for x in m.groups())
            return _ms(datetime(year, month, day, *clock))
        if _NAMED.fullmatch(text):
            return _ms(parsedate_to_datetime(text))
    except (ValueError, OverflowError, TypeError):
        pass
    return None


def tags_of(value: object) -> list[str] | None:
    """The labels of tags stored as a list of labels or objects, as an object with a key for each, or as one text with separators; sorted, each once."""
    if isinstance(value, str):
        found = re.split(r"\s*[|,;]\s*", value.strip())
    elif isinstance(value, dict):
        found = list(value) if value and not any(isinstance(x, (dict, list)) for x in value.values()) else None
    elif isinstance(value, list):
        found = [x if isinstance(x, str) else next((x[k] for k in ("slug", "name", "label") if isinstance(x.get(k), str) and x[k].strip()), None) if isinstance(x, dict) else None for x in value if x is not None]
        found = None if None in found else found
    else:
        found = None
    return sorted({x.strip() for x in found} - {""}) or None if found else None


def plain_of(value: object) -> str:
    """A value as text, however it was written: numbers without needless digits, truth values in small letters."""
    if isinstance(value, bool):
        return "true" if value else "false"
    text = value.strip() if isinstance(value, str) else str(getattr(value, "text", value)) if isinstance(value, (int, float)) else json.dumps(value, sort_keys=True, ensure_ascii=False, default=float)
    if _NUMERIC.fullmatch(text):
        try:
            number = Decimal(text)
            return f"{number.normalize():f}" if abs(number.adjusted()) < 40 else text
        except InvalidOperation:
            return text
    return text.lower() if text.lower() in ("true", "false") else text


def forms_of(value: object) -> tuple[list[str], int | None, list[str] | None, str]:
    """Canonical forms of a value (two values are the same if they share one), and the moment, tags and plain text among them."""
    moment, tags, plain = moment_of(value), tags_of(value), plain_of(value)
    forms = [f"v:{plain}"]
    if plain in ("0", "1") and not isinstance(value, str):
        forms.append("v:true" if plain == "1" else "v:false")
    if moment is not None:
        forms.append(f"m:{moment}")
    if tags is not None:
        forms.append("t:" + "\x1f".join(tags))
    return forms, moment, tags, plain


class _Forms(dict):
    """Canonical forms of strings, as values repeat; forgotten when there are too many."""

    def __missing__(self, value: str) -> tuple[list[str], int | None, list[str] | None, str]:
        if len(self) > 1 << 14:
            self.clear()
        self[value] = found = forms_of(value)
        return found


_STRINGS = _Forms()


def _schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fused schemas of the parts of files in each batch: no row for a value, one for each file, name and alternative."""
    for batch in batches:
        found: dict[tuple, None] = {}
        for feed, no, text in zip(batch["feed"], batch["file_no"], batch["record"], strict=True):
            for field, value in (record_of(text) or {}).items():
                found[feed, no, field, alternative(value)] = None
        yield pd.DataFrame(list(found), columns=["feed", "file_no", "field", "alternative"])


def _rid(record: dict) -> str | None:
    rid = record.get(RECORD_ID)
    return None if rid is None else plain_of(rid)


def _wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Canonical forms of the values of the wanted names of each line."""
    for batch in batches:
        rows = []
        for feed, no, names, text in zip(batch["feed"], batch["file_no"], batch["names"], batch["record"], strict=True):
            record = record_of(text)
            if record is None or (rid := _rid(record)) is None:
                continue
            for field in names:
                value = record.get(field)
                if alternative(value):
                    rows.append((feed, no, rid, field, (_STRINGS[value] if isinstance(value, str) else forms_of(value))[0]))
        yield pd.DataFrame(rows, columns=["feed", "file_no", "rid", "field", "forms"])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    for batch in batches:
        rows = []
        for feed, no, line, loaded, text in zip(batch["feed"], batch["file_no"], batch["line_no"], batch["loaded_at"], batch["record"], strict=True):
            record = record_of(text)
            if record is None:
                continue
            rid = _rid(record)
            for field, value in record.items():
                kind = alternative(value)
                _, moment, tags, plain = (_STRINGS[value] if isinstance(value, str) else forms_of(value)) if kind else (None, None, None, None)
                rows.append((feed, no, line, loaded, rid, field, kind, moment, tags, plain))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"moment": "Int64"})


def _lines(files: DataFrame) -> DataFrame:
    return columns(files, "feed", "file_no", "line_no", "loaded_at", "record").where("feed IS NOT NULL AND file_no IS NOT NULL AND record IS NOT NULL")


def schemas(files: DataFrame) -> DataFrame:
    """feed, file_no, field, alternatives: the fused schema of each file, written once."""
    parts = _lines(files).select("feed", "file_no", "record").mapInPandas(_schemas, "feed string, file_no int, field string, alternative string")
    return materialize(parts.groupBy("feed", "file_no", "field").agg(F.sort_array(F.collect_set("alternative")).alias("alternatives")), "schemas")


def _transitions(schema: DataFrame) -> DataFrame:
    """feed, file_no, prev_no of every file but the first of its feed."""
    files = schema.select("feed", "file_no").distinct()
    return files.withColumn("prev_no", F.lag("file_no").over(Window.partitionBy("feed").orderBy("file_no"))).where("prev_no IS NOT NULL")


def same_values(files: DataFrame, schema: DataFrame) -> DataFrame:
    """feed, file_no, old, new, common: names that go and come between neighbouring files and hold the same value in every common record.

    Only values of such names are read again, from files that have any.
    """
    steps = _transitions(schema)
    now = schema.select("feed", "file_no", "field")
    before = steps.join(schema.select("feed", F.col("file_no").alias("prev_no"), "field"), ["feed", "prev_no"])
    gone = before.join(now, ["feed", "file_no", "field"], "left_anti")
    come = steps.join(now, ["feed", "file_no"]).join(before.select("feed", "file_no", "field"), ["feed", "file_no", "field"], "left_anti")
    both = gone.select("feed", "file_no").distinct().join(come.select("feed", "file_no").distinct(), ["feed", "file_no"])  # a step at which names only go, or only come, renames nothing
    gone, come = gone.join(both, ["feed", "file_no"], "left_semi"), come.join(both, ["feed", "file_no"], "left_semi")
    names = gone.select("feed", F.col("prev_no").alias("file_no"), "field").unionByName(come.select("feed", "file_no", "field"))
    asked = names.groupBy("feed", "file_no").agg(F.collect_set("field").alias("names"))
    lines = _lines(files).select("feed", "file_no", "record").join(asked, ["feed", "file_no"])
    values = materialize(lines.mapInPandas(_wanted, "feed string, file_no int, rid string, field string, forms array<string>"), "values")
    old = gone.join(values.withColumnRenamed("file_no", "prev_no"), ["feed", "prev_no", "field"]).select("feed", "file_no", "rid", F.col("field").alias("old"), F.col("forms").alias("old_forms"))
    new = come.join(values, ["feed", "file_no", "field"]).select("feed", "file_no", "rid", F.col("field").alias("new"), F.col("forms").alias("new_forms"))
    records = old.join(new, ["feed", "file_no", "rid"]).groupBy("feed", "file_no", "old", "new", "rid").agg(F.max(F.arrays_overlap("old_forms", "new_forms")).alias("same"))
    return records.groupBy("feed", "file_no", "old", "new").agg(F.min("same").alias("same"), F.count("*").alias("common")).where("same").drop("same")


_STEP = "feed string, file_no int, field_name string, change_kind string, lineage string, detail string"


def _walk(metadata: pd.DataFrame) -> pd.DataFrame:
    """Changes and lineages of one feed from its schemas (rows with alternatives) and its equal pairs (rows with old and new)."""
    feed = metadata["feed"].iloc[0]
    schema, pairs = metadata[metadata["old"].isna()], metadata[metadata["old"].notna()]
    equal = {no: sorted(zip(-g["common"], g["field"], g["old"], strict=True)) for no, g in pairs.groupby("file_no")}
    out: list[tuple] = []
    lineage: dict[str, str] = {}  # name now -> name of its line
    kinds: dict[str, list[str]] = {}  # name now -> alternatives in the nearest earlier file with values
    for first, (no, group) in zip([True] + [False] * len(metadata), sorted(schema.groupby("file_no"), key=lambda x: x[0]), strict=False):
        types = {f: sorted(a) for f, a in zip(group["field"], group["alternatives"], strict=True)}
        renamed: dict[str, str] = {}
        for _, new, old in equal.get(no, []):
            if new not in renamed and old not in renamed.values():
                renamed[new] = old
        old_lines, old_kinds = lineage, kinds
        lineage, kinds = {}, {}
        for name in sorted(types):
            source = name if name in old_lines else renamed.get(name)
            known = source in old_lines
            lineage[name] = old_lines[source] if known else f"{name}@{no}"
            earlier = old_kinds.get(source, []) if known else []
            if not first and name not in old_lines:
                out.append((feed, no, name, "renamed" if known else "added", lineage[name], source if known else None))
            if types[name] and earlier and types[name] != earlier:
                out.append((feed, no, name, "type_changed", lineage[name], f"{' + '.join(earlier)} -> {' + '.join(types[name])}"))
            kinds[name] = types[name] or earlier
            out.append((feed, no, name, None, lineage[name], None))
        out += [(feed, no, name, "removed", old_lines[name], None) for name in sorted(set(old_lines) - set(types) - set(renamed.values()))]
    return pd.DataFrame(out, columns=[x.split()[0] for x in _STEP.split(", ")])


def history(files: DataFrame) -> DataFrame:
    """Every change (change_kind, detail) and, with a null change_kind, the lineage of every field of every file."""
    schema = schemas(files)
    pairs = same_values(files, schema)
    metadata = schema.select("feed", "file_no", "field", "alternatives", F.lit(None).cast("string").alias("old"), F.lit(None).cast("long").alias("common")).unionByName(
        pairs.select("feed", "file_no", F.col("new").alias("field"), F.lit(None).cast("array<string>").alias("alternatives"), "old", "common")
    )
    return metadata.groupBy("feed").applyInPandas(_walk, _STEP)


def changes(files: DataFrame) -> DataFrame:
    """feed, file_no, field_name, change_kind, detail of each change."""
    return history(files).where("change_kind IS NOT NULL").select("feed", "file_no", "field_name", "change_kind", "detail")


# ---- One consistent table --------------------------------------------------------------------------------------------


def lineages(files: DataFrame) -> DataFrame:
    """feed, file_no, field, name: the consistent name of every field of every file.

    A lineage is known by the one of its names that most files of all feeds use. Several lineages of a feed with one such
    name in a file stay apart: the later ones have `_2`, `_3`, … after it.
    """
    lines = materialize(history(files).where("change_kind IS NULL").select("feed", "file_no", F.col("field_name").alias("field"), "lineage"), "lineages")
    votes = lines.groupBy("field").agg(F.count("*").alias("files"))
    best = lines.join(votes, "field").groupBy("feed", "lineage").agg(F.max_by("field", F.struct("files", "field")).alias("name"), F.min("file_no").alias("since"))
    named = lines.join(best, ["feed", "lineage"])
    place = F.row_number().over(Window.partitionBy("feed", "file_no", "name").orderBy("since", "lineage"))
    apart = named.withColumn("place", place).groupBy("feed", "lineage").agg(F.max("place").alias("place"))
    name = F.when(F.col("place") > 1, F.concat("name", F.lit("_"), F.col("place").cast("string"))).otherwise(F.col("name"))
    return named.join(apart, ["feed", "lineage"]).select("feed", "file_no", "field", name.alias("name"))


def parsed(files: DataFrame) -> DataFrame:
    """A row for each field of each record by its consistent name, written once: its alternative and canonical forms."""
    rows = _lines(files).mapInPandas(_parse, _PARSED).join(lineages(files), ["feed", "file_no", "field"]).drop("field")
    return materialize(rows, "drift")


def branches(rows: DataFrame) -> dict[str, tuple[str, list[str]]]:
    """Of each consistent name the type that all its values convert to (moment, tags, bigint, double, boolean or string) and the alternatives it came as.

    Counted where the values are; a row for each name and alternative, as many as a schema has, reaches the driver.
    """
    number = F.col("plain").try_cast("double").isNotNull()
    fits = {
        "moment": F.col("moment").isNotNull(),
        "boolean": F.col("plain").isin("true", "false") | (F.col("plain").isin("0", "1") & F.col("alternative").isin("integer", "string")),
        "bigint": F.col("plain").try_cast("bigint").isNotNull() & ~F.contains("plain", F.lit(".")), "double": number,
        "tags": F.col("tags").isNotNull(),
    }
    spoken = F.max(F.col("plain").isin("true", "false")).alias("spoken")
    found = rows.where("alternative IS NOT NULL").groupBy("name", "alternative").agg(*[F.min(c).alias(k) for k, c in fits.items()], spoken).collect()
    out: dict[str, tuple[str, list[str]]] = {}
    for name in sorted({r.name for r in found}):
        own = [r for r in found if r.name == name]
        many = any(r.alternative.startswith(("array", "object")) for r in own)
        kind = next((k for k in fits if all(r[k] for r in own) and (k != "boolean" or any(r.spoken for r in own)) and (k != "tags" or many)), "string")
        out[name] = (kind, sorted(r.alternative for r in own))
    return out


def consistent(files: DataFrame) -> DataFrame:
    """One row for each record id of each feed, from its latest line, and one for each line without an id: feed, rid, file_no,
    line_no and a column for each field by its consistent name.

    A field whose values came with several JSON types has, besides the canonical column, a typed branch for each of them
    (`views__integer`, `views__string`, …) that holds the value if it came with that type. `plain` and `alternatives` hold
    every value as text and the type it came with. Fields of no values at all are null text.
    """
    rows = parsed(files)
    kinds = branches(rows)
    entry = lambda x: F.struct("name", x)
    key = ["feed", "rid", "file_no", "loaded_at", "line_no"]
    value = F.struct("plain", "moment", "tags", "alternative")
    once = rows.groupBy(*key, "name").agg(F.max(value).alias("v"))
    record = once.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(F.col("v.alternative").isNotNull(), entry("v")))).alias("m"))
    place = Window.partitionBy("feed", "rid", F.when(F.col("rid").isNull(), F.struct("file_no", "loaded_at", "line_no"))).orderBy(F.desc("file_no"), F.desc("loaded_at"), F.desc("line_no"))
    newest = record.withColumn("_r", F.row_number().over(place)).where("_r = 1")
    out = []
    for name, (kind, came) in kinds.items():
        v = F.try_element_at("m", F.lit(name))
        out.append(_typed(v, kind).alias(name))
        if len(came) > 1:
            out += [F.when(v["alternative"] == a, _typed(v, _BRANCH.get(a, "tags" if kind == "tags" else "string"))).alias(f"{name}__{a}") for a in came]
    plain, alternatives = F.transform_values("m", lambda _, v: v["plain"]).alias("plain"), F.transform_values("m", lambda _, v: v["alternative"]).alias("alternatives")
    taken = {"feed", "rid", "file_no", "line_no", "plain", "alternatives"}
    fields = [c.alias(f"{n}_") if n.lower() in taken else c for c, n in zip(out, _names(kinds), strict=True)]
    return newest.select("feed", "rid", "file_no", "line_no", *fields, plain, alternatives)


#: Types of the branches of scalar alternatives.
_BRANCH = {"integer": "bigint", "float": "double", "boolean": "boolean", "string": "string"}


def _names(kinds: dict[str, tuple[str, list[str]]]) -> list[str]:
    return [n for name, (_, came) in kinds.items() for n in (name, *(f"{name}__{a}" for a in came if len(came) > 1))]


def _typed(v: Column, kind: str) -> Column:
    """A value in one type; null where it has none of it."""
    if kind == "moment":
        return F.timestamp_millis(v["moment"])
    if kind == "tags":
        return v["tags"]
    if kind == "boolean":
        return F.when(v["plain"].isin("true", "1"), True).when(v["plain"].isin("false", "0"), False)
    return v["plain"] if kind == "string" else v["plain"].try_cast(kind)
