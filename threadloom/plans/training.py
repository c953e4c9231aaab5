"""Queries of the general operators on nested and drifting records, and what they are in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import drift, nested
from ..session import ship
from ..sources.tables import table


def _of(function: Callable[[DataFrame], DataFrame], name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(table(ship(spark), sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": _of(lambda t: nested.element_paths(nested.record_triples(t)), "topic_files"),
    **{f"p4_{'topics' if kind == 'topic' else kind}": _of(lambda t, kind=kind: nested.flat_table(t, kind), "topic_files") for kind in nested.TABLES},
    "p5_found": _of(lambda t: drift.changes(t).drop("detail"), "index_files"),
    "p5_changes": _of(drift.changes, "index_files"),
    "p5_table": _of(drift.consistent, "index_files"),
}

# ---- Nested records in SQL -------------------------------------------------------------------------------------------

_SOME = lambda x: f"CASE WHEN json_type({x}) <> 'NULL' THEN {x} END"
_FIRST = lambda name: "COALESCE(" + ", ".join(_SOME(f"json_extract(b, '$.{p}{name}')") for p in ("", "post_stream.", "topic.", "topic.post_stream.")) + ")"
_SPOKEN = lambda x: f"CASE WHEN json_type({x}) = 'VARCHAR' AND COALESCE(json_valid({x} ->> '$'), false) THEN ({x} ->> '$')::JSON ELSE {x} END"
_LIST = lambda x: f"CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"
_BELOW = lambda source, column, prefix: f"SELECT topic_id, path AS parent_path, {prefix} || (i - 1) AS path, i - 1 AS ordinal, x FROM (SELECT topic_id, path, unnest({column}) AS x, unnest(range(1, len({column}) + 1)) AS i FROM {source})"

#: The elements of the latest valid record of each topic.
_NESTED = f"""
WITH v AS (SELECT record_id, fetched_at, TRY_CAST(regexp_extract(file_path, '([0-9]+)[^/0-9]*$', 1) AS BIGINT) AS topic_id, body::JSON AS b FROM (SELECT *, CASE WHEN json_valid(body) THEN json_type(body) END AS jt FROM topic_files) WHERE jt = 'OBJECT'),
r AS (SELECT topic_id, b FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at DESC NULLS LAST, record_id DESC) AS rn FROM v WHERE topic_id IS NOT NULL) WHERE rn = 1),
c AS (SELECT topic_id, 'topic' AS path, {_LIST('t')} AS tags, {_LIST('p')} AS posts FROM (SELECT topic_id, {_SPOKEN('t0')} AS t, {_SPOKEN('p0')} AS p FROM (SELECT topic_id, {_FIRST('tags')} AS t0, {_FIRST('posts')} AS p0 FROM r))),
tags AS ({_BELOW('c', 'tags', "'tags/'")}),
posts AS (SELECT * FROM ({_BELOW('c', 'posts', "'posts/'")}) WHERE json_type(x) <> 'NULL'),
pc AS (SELECT topic_id, path, {_LIST("json_extract(x, '$.link_counts')")} AS links, {_LIST("json_extract(x, '$.polls')")} AS polls FROM posts),
links AS (SELECT * FROM ({_BELOW('pc', 'links', "path || '/link_counts/'")}) WHERE json_type(x) <> 'NULL'),
polls AS (SELECT * FROM ({_BELOW('pc', 'polls', "path || '/polls/'")}) WHERE json_type(x) <> 'NULL'),
oc AS (SELECT topic_id, path, {_LIST("json_extract(x, '$.options')")} AS options FROM polls),
options AS (SELECT * FROM ({_BELOW('oc', 'options', "path || '/options/'")}) WHERE json_type(x) <> 'NULL')
"""
_SQL_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}


def _cell(field: str, kind: str, source: str) -> str:
    """A field's text cast to its type; the value of an element that is no object stands for itself."""
    text = "CASE WHEN json_type(x) NOT IN ('OBJECT', 'NULL') THEN x ->> '$' END" if field == "value" else f"CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.{field}') END"
    if source == "r":
        text = f"{_FIRST(field)} ->> '$'"
    return f"TRY_CAST({text} AS {_SQL_TYPES[kind]}) AS {field}"


def _others(known: list[str], source: str) -> str:
    """The other scalar fields of an element, as a map."""
    if source == "r":
        return "MAP_FROM_ENTRIES(list_filter([ROW('stream_size', {0} ->> '$')], lambda e: e[2] IS NOT NULL)) AS rest".format(_FIRST("stream_size"))
    names = "[" + ", ".join(f"'{k}'" for k in (*known, "link_counts", "polls", "options")) + "]"
    return f"MAP_FROM_ENTRIES(list_transform(list_filter(CASE WHEN json_type(x) = 'OBJECT' THEN list_sort(json_keys(x)) ELSE [] END, lambda k: NOT list_contains({names}, k) AND json_extract_string(x, '$.\"' || k || '\"') IS NOT NULL), lambda k: ROW(k, json_extract_string(x, '$.\"' || k || '\"')))) AS rest"


def _flat(kind: str) -> str:
    fields = nested.TABLES[kind]
    source = "r" if kind == "topic" else kind
    cells = ", ".join(_cell(f, t, source) for f, t in fields.items())
    keys = "topic_id, CAST(NULL AS VARCHAR) AS parent_path, 'topic' AS path, CAST(0 AS BIGINT) AS ordinal" if source == "r" else "topic_id, parent_path, path, ordinal"
    return f"{_NESTED} SELECT {keys}, {cells}, {_others([*fields], source)} FROM {source}"


# ---- Drifting records in SQL -----------------------------------------------------------------------------------------

_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'float' WHEN 'OBJECT' THEN 'object' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' END"
_INNER = "list_sort(list_distinct(list_filter(list_transform(from_json(v, '[\"JSON\"]'), lambda e: " + _KIND.format("e") + "), lambda e: e IS NOT NULL)))"
_TEXT = "CASE WHEN json_type(v) = 'OBJECT' AND len(json_keys(v)) = 1 THEN json_extract_string(v, '$.\"' || json_keys(v)[1] || '\"') WHEN json_type(v) NOT IN ('ARRAY', 'OBJECT', 'BOOLEAN') THEN v ->> '$' END"
_MOMENT = """CASE WHEN regexp_full_match(s, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN CASE WHEN s::DOUBLE >= 315532800 AND s::DOUBLE < 4102444800 THEN CAST(round(s::DOUBLE * 1000) AS BIGINT) WHEN s::DOUBLE >= 315532800000 AND s::DOUBLE < 4102444800000 THEN CAST(round(s::DOUBLE) AS BIGINT) END
  WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN epoch_ms(TRY_CAST(s AS TIMESTAMP))
  ELSE epoch_ms(COALESCE(try_strptime(s, '%d.%m.%Y %H:%M:%S'), try_strptime(s, '%a, %d %b %Y %H:%M:%S GMT'))) END"""
_TAGS = """CASE json_type(v) WHEN 'VARCHAR' THEN string_split_regex(trim(v ->> '$'), '\\s*[|,;]\\s*') WHEN 'OBJECT' THEN CASE WHEN len(list_filter(json_keys(v), lambda k: json_type(v, '$."' || k || '"') IN ('OBJECT', 'ARRAY'))) = 0 THEN json_keys(v) END
  WHEN 'ARRAY' THEN list_transform(from_json(v, '["JSON"]'), lambda e: CASE json_type(e) WHEN 'VARCHAR' THEN e ->> '$' WHEN 'OBJECT' THEN COALESCE(NULLIF(trim(e ->> '$.slug'), ''), NULLIF(trim(e ->> '$.name'), ''), NULLIF(trim(e ->> '$.label'), '')) END) END"""
_PLAIN = """CASE WHEN json_type(v) IN ('ARRAY', 'OBJECT') THEN v::VARCHAR WHEN regexp_full_match(trim(v ->> '$'), '[+-]?[0-9]{1,15}(\\.[0-9]{1,6})?') THEN CAST(CAST(trim(v ->> '$') AS DECIMAL(30, 6)) AS VARCHAR) WHEN lower(trim(v ->> '$')) IN ('true', 'false') THEN lower(trim(v ->> '$')) ELSE trim(v ->> '$') END"""
_DRIFT = f"""
WITH RECURSIVE lines AS (SELECT feed, file_no, record::JSON AS o FROM (SELECT feed, file_no, record, CASE WHEN json_valid(record) THEN json_type(record) END AS jt FROM index_files) WHERE jt = 'OBJECT' AND feed IS NOT NULL AND file_no IS NOT NULL),
f0 AS (SELECT feed, file_no, o ->> '$.id' AS rid, k AS field, json_extract(o, '$."' || k || '"') AS v FROM (SELECT feed, file_no, o, unnest(json_keys(o)) AS k FROM lines)),
f1 AS (SELECT *, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN CASE WHEN len({_INNER}) > 0 THEN 'array<' || array_to_string({_INNER}, '|') || '>' END ELSE {_KIND.format('v')} END AS kind FROM f0),
files AS (SELECT feed, file_no, row_number() OVER (PARTITION BY feed ORDER BY file_no) AS idx FROM (SELECT DISTINCT feed, file_no FROM f1)),
sch AS (SELECT f1.feed, idx, f1.file_no, field, COALESCE(string_agg(DISTINCT kind, ' + ' ORDER BY kind), '') AS types FROM f1 JOIN files USING (feed, file_no) GROUP BY 1, 2, 3, 4),
gone AS (SELECT a.feed, a.idx + 1 AS idx, a.field FROM sch a JOIN files n ON n.feed = a.feed AND n.idx = a.idx + 1 ANTI JOIN sch b ON b.feed = a.feed AND b.idx = a.idx + 1 AND b.field = a.field),
come AS (SELECT a.feed, a.idx, a.field FROM (SELECT * FROM sch WHERE idx > 1) a ANTI JOIN sch b ON b.feed = a.feed AND b.idx = a.idx - 1 AND b.field = a.field),
vals AS MATERIALIZED (SELECT feed, idx, rid, field, forms FROM (SELECT feed, file_no, rid, field, list_filter(['v:' || p, CASE WHEN kind <> 'string' AND p IN ('0.000000', '1.000000') THEN CASE WHEN p = '1.000000' THEN 'v:true' ELSE 'v:false' END END, 'm:' || {_MOMENT}, 't:' || array_to_string(list_sort(list_distinct(list_filter(list_transform(t, lambda x: trim(x)), lambda x: x <> ''))), chr(31))], lambda x: x IS NOT NULL) AS forms
  FROM (SELECT *, {_PLAIN} AS p, trim({_TEXT}) AS s, {_TAGS} AS t FROM f1 WHERE kind IS NOT NULL AND rid IS NOT NULL)) JOIN files USING (feed, file_no)),
ov AS (SELECT g.feed, g.idx, rid, g.field AS old, forms FROM gone g JOIN vals v ON v.feed = g.feed AND v.idx = g.idx - 1 AND v.field = g.field),
nv AS (SELECT c.feed, c.idx, rid, c.field AS new, forms FROM come c JOIN vals v ON v.feed = c.feed AND v.idx = c.idx AND v.field = c.field),
same AS (SELECT feed, idx, old, new, count(*) AS common FROM (SELECT feed, idx, old, new, rid, max(list_has_any(ov.forms, nv.forms)) AS eq FROM ov JOIN nv USING (feed, idx, rid) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4 HAVING min(eq)),
ren AS (SELECT feed, idx, old, new FROM (SELECT *, row_number() OVER (PARTITION BY feed, idx, old ORDER BY common DESC, new, old) AS a, row_number() OVER (PARTITION BY feed, idx, new ORDER BY common DESC, new, old) AS b FROM same) WHERE a = 1 AND b = 1),
link AS (SELECT s.feed, s.idx, s.field, COALESCE(ren.old, CASE WHEN p.field IS NOT NULL THEN s.field END) AS source FROM sch s LEFT JOIN ren ON ren.feed = s.feed AND ren.idx = s.idx AND ren.new = s.field LEFT JOIN sch p ON p.feed = s.feed AND p.idx = s.idx - 1 AND p.field = s.field),
back AS (SELECT feed, idx, field, types, idx AS at, field AS name, '' AS earlier FROM sch WHERE types <> ''
  UNION ALL SELECT b.feed, b.idx, b.field, b.types, s.idx, s.field, s.types FROM back b JOIN link l ON l.feed = b.feed AND l.idx = b.at AND l.field = b.name JOIN sch s ON s.feed = l.feed AND s.idx = l.idx - 1 AND s.field = l.source WHERE b.earlier = ''),
found AS (SELECT c.feed, c.idx, c.field AS field_name, CASE WHEN old IS NULL THEN 'added' ELSE 'renamed' END AS change_kind, old AS detail FROM come c LEFT JOIN ren ON ren.feed = c.feed AND ren.idx = c.idx AND ren.new = c.field
  UNION ALL SELECT g.feed, g.idx, g.field, 'removed', NULL FROM gone g ANTI JOIN ren ON ren.feed = g.feed AND ren.idx = g.idx AND ren.old = g.field
  UNION ALL SELECT feed, idx, field, 'type_changed', earlier || ' -> ' || types FROM back WHERE earlier <> '' AND earlier <> types)
"""

SQL: dict[str, str] = {
    "p4_found": f"{_NESTED} SELECT topic_id, parent_path, path AS child_path FROM (SELECT topic_id, parent_path, path FROM tags UNION ALL SELECT topic_id, parent_path, path FROM posts UNION ALL SELECT topic_id, parent_path, path FROM links UNION ALL SELECT topic_id, parent_path, path FROM polls UNION ALL SELECT topic_id, parent_path, path FROM options)",
    **{f"p4_{'topics' if kind == 'topic' else kind}": _flat(kind) for kind in nested.TABLES},
    "p5_found": f"{_DRIFT} SELECT feed, file_no, field_name, change_kind FROM found JOIN files USING (feed, idx)",
    "p5_changes": f"{_DRIFT} SELECT feed, file_no, field_name, change_kind, detail FROM found JOIN files USING (feed, idx)",
}
