import json

from threadloom.operators import drift

SCHEMA = "feed string, file_no int, file_name string, line_no int, loaded_at timestamp_ntz, record string"


def files(spark, by_file, feed="f", schema=SCHEMA, more=()):
    rows = [(feed, no, f"{no}.json", i, None, x if x is None or isinstance(x, str) else json.dumps(x), *more) for no, lines in by_file.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, schema)


def changes(spark, by_file, **kw):
    return {(r.file_no, r.field_name, r.change_kind) for r in drift.changes(files(spark, by_file, **kw)).collect()}


def test_rename_by_moment_and_tags(spark):
    got = changes(spark, {
        1: [{"id": 1, "created_at": "2024-01-02T03:04:05Z", "tags": ["a", "b"]}],
        4: [{"id": 1, "made": 1704164645, "labels": "b|a"}, {"id": 2, "made": None, "labels": []}],
        5: [{"id": 1, "made": {"utc": "2024-01-02T05:04:05+02:00"}, "labels": {"a": True, "b": True}}],
    })
    assert got == {(4, "made", "renamed"), (4, "labels", "renamed"), (4, "made", "type_changed"), (4, "labels", "type_changed"), (5, "made", "type_changed"), (5, "labels", "type_changed")}


def test_different_values_are_no_rename(spark):
    got = changes(spark, {1: [{"id": 1, "a": 1}, {"id": 2, "a": 2}], 2: [{"id": 1, "b": 1}, {"id": 2, "b": 3}]})
    assert got == {(2, "a", "removed"), (2, "b", "added")}
    assert changes(spark, {1: [{"id": 1, "a": 1}], 2: [{"id": 9, "b": 1}]}) == {(2, "a", "removed"), (2, "b", "added")}


def test_types_skip_files_without_values_but_not_removals(spark):
    base = {1: [{"id": 1, "x": 1}], 2: [{"id": 1, "x": None}], 3: [{"id": 1, "x": 1.5}]}
    assert changes(spark, base) == {(3, "x", "type_changed")}
    gone = {1: [{"id": 1, "x": 1}], 2: [{"id": 1}], 3: [{"id": 1, "x": "1"}]}
    assert changes(spark, gone) == {(2, "x", "removed"), (3, "x", "added")}


def test_bad_lines_repeats_and_empty(spark):
    got = changes(spark, {1: [{"id": 1, "x": True}, {"id": 1, "x": True}, None, "", "[]", "# end", '{"id": 1'], 2: [{"id": 1, "x": "True"}], 3: ["nothing"]})
    assert got == {(2, "x", "type_changed")}
    assert drift.changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert changes(spark, {1: [{"x": 1}], 2: [{"y": 1}]}) == {(2, "x", "removed"), (2, "y", "added")}  # no ids
    assert changes(spark, {1: [{"id": 1, "x": 1}], 2: [{"id": 1}]}, schema=SCHEMA + ", Feed string, field string", more=("u", "v")) == {(2, "x", "removed")}


def test_times_however_written():
    same = ["2024-08-05T10:11:12Z", "2024-08-05 10:11:12", "05.08.2024 10:11:12", "Mon, 05 Aug 2024 10:11:12 GMT", "2024-08-05T12:11:12+02:00", 1722852672, 1722852672000, drift.Fraction("1722852672.0"), {"utc": "2024-08-05T10:11:12.000Z"}]
    assert {drift.moment_of(x) for x in same} == {1722852672000}
    assert drift.moment_of("05.13.2024") is None and drift.moment_of("x") is None and drift.moment_of(True) is None and drift.moment_of(12) is None


def test_alternatives():
    got = [drift.alternative(x) for x in (None, [], "a", True, 1, 1.0, {}, ["a", 1], [[]], [None])]
    assert got == [None, None, "string", "boolean", "integer", "float", "object", "array<integer|string>", None, None]


def test_consistent_table(spark):
    df = files(spark, {1: [{"id": 1, "title": "A", "tags": ["x"], "created_at": "2024-01-02T03:04:05Z"}], 2: [{"id": 1, "title": "B", "labels": [{"slug": "x"}], "created_at": 1704164645}, {"id": "2", "title": None, "labels": None, "created_at": None}]})
    got = {r.rid: r for r in drift.consistent(df).collect()}
    assert set(got) == {"1", "2"} and got["1"].title == "B" and got["2"].title is None
    assert got["1"].plain["title"] == "B" and got["1"].alternatives["created_at"] == "integer"


def test_table_has_what_the_lineages_have(spark):
    """Names that no fixture has, alternatives as branches, records without an id, columns with taken names."""
    df = files(spark, {
        1: [{"id": 1, "wagons": 3, "colour": ["red"], "plain": "x", "seen": "2024-01-02"}, {"wagons": 4}, {"wagons": 4}],
        2: [{"id": 2, "wagons": "5", "hue": "red|blue", "plain": "y", "seen": 1704164645}, {"id": 1, "wagons": 6, "hue": {"red": True}, "plain": None}],
    })
    t = drift.consistent(df)
    assert {"wagons", "wagons__integer", "wagons__string", "hue", "plain_", "seen", "seen__integer", "seen__string"} <= set(t.columns) and "colour" not in t.columns
    rows = t.collect()
    by = {r.rid: r for r in rows if r.rid}
    assert len(rows) == 4 and sorted(r.wagons for r in rows if r.rid is None) == [4, 4]
    assert (by["2"].wagons, by["2"].wagons__integer, by["2"].wagons__string, by["2"].hue, by["2"].plain_) == (5, None, "5", ["blue", "red"], "y")
    assert (by["1"].file_no, by["1"].wagons, by["1"].hue, by["1"].plain_) == (2, 6, ["red"], None) and by["1"].alternatives["hue"] == "object"


def test_lineages_of_one_name_stay_apart(spark):
    """A name that was given away and taken up again by another field loses neither."""
    df = files(spark, {1: [{"id": 1, "a": "u"}], 2: [{"id": 1, "b": "u", "a": "w"}], 3: [{"id": 1, "a": "w", "b": "u"}]})
    r = drift.consistent(df).first()
    assert {r.plain["a"], r.plain["b"]} == {"u", "w"}
    df = files(spark, {1: [{"id": 1, "x": 1}], 2: [{"id": 1, "y": 1}], 3: [{"id": 1, "y": 1, "x": 2}], 4: [{"id": 9, "x": 2}], 5: [{"id": 9, "x": 2}]}, feed="g")
    assert drift.consistent(df).where("rid = '1'").select("x", "x_2").first()[:] == (1, 2)  # y's lineage began as x, the name of most files
