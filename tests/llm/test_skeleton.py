from threadloom.llm import skeleton as S

TOPICS = "id long, title string, tags array<string>"
REGISTRY = "tag_id long, name string, slug string, label string"


def pairs(spark, topics, registry=(), schema=TOPICS, reg_schema=REGISTRY):
    df = S.found(spark.createDataFrame(topics, schema), spark.createDataFrame(list(registry), reg_schema))
    return sorted(map(tuple, df.collect()))


def same(a, b):
    return S.skeleton_of(a) == S.skeleton_of(b)


def test_looks_the_same():
    for a, b in [("Café", "Café"), ("Ｔａｘｉ", "Taxi"), ("a b", "a b"), (" x ", "x"), ("ze​ro", "zero"), ("раураl", "paypal"), ("ﬁne", "fine"), ("a‑b", "a-b"), ("Ⅼive", "Live"), ("Ångström", "Ångström"), ("ѕіgnal", "signal"), ("x﻿", "x"), ("co­op", "coop"), ("－", "-")]:
        assert same(a, b), (a, b)


def test_looks_different():
    for a, b in [("x²", "x2"), ("②", "2"), ("½", "1/2"), ("a–b", "a-b"), ("Café", "Cafe"), ("O", "0"), ("l", "1"), ("I", "l"), ("rn", "m"), ("A", "a"), ("ł", "l"), ("a b", "ab"), ("a  b", "a b"), ("ß", "ss"), ("ſ", "s"), ("σ", "o"), ("т", "t")]:
        assert not same(a, b), (a, b)


def test_null_empty_and_long():
    assert S.skeleton_of(None) is None and S.skeleton_of("") == "" and S.skeleton_of(" ​　") == ""
    assert S.skeleton_of("а" * 1_000_000) == "a" * 1_000_000


def test_pairs(spark):
    rows = [(1, "Café", None), (1, "Café", None), (2, "Café", []), (3, "Café", None), (4, "Cafe", None), (5, None, None), (6, "Cаfé", None), (None, "Café", None)]
    assert pairs(spark, rows) == [("title", 1, 2), ("title", 1, 6), ("title", 2, 3), ("title", 2, 6), ("title", 3, 6)]


def test_labels(spark):
    registry = [(10, "a-b", "a-b", "a-b"), (11, "A b", "900-tag", "A b"), (12, None, None, None)]
    rows = [
        (1, None, ["a‑b", "a-b"]), (2, None, [None, '{"id": 10, "name": "x", "slug": "a-b "}']), (3, None, ['{"name": "A b", "slug": "900-tag"}']),
        (4, None, ['{"name": "a-b", "slug": null}', "a-B"]), (5, None, None), (6, None, ["{broken", ""]), (1, None, ["a‑b"]),
    ]
    assert pairs(spark, rows, registry) == [("tags", 1, 10), ("tags", 2, 10), ("tags", 3, 11)]


def test_empty_and_clashing(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, [(1, "x", None, "u", "v"), (2, "х", None, "u", "v")], (), TOPICS + ", Title string, skeleton string") == [("title", 1, 2)]


def test_many_copies_make_no_pairs_of_equals(spark):
    rows = [(i, "Same title", None) for i in range(3000)] + [(5000, "Sаme title", None)]
    got = pairs(spark, rows)
    assert len(got) == 3000 and all(b == 5000 for _, _, b in got)


def test_consistent(spark):
    df = S.consistent(spark.createDataFrame([(1, "Ｘ", ["ｙ", None]), (2, None, None)], TOPICS))
    assert sorted(map(tuple, df.collect())) == [(1, "tags", "ｙ", "y"), (1, "title", "Ｘ", "X")]


def test_capitals_of_other_scripts_with_one_glyph():
    assert S.skeleton_of("ꓐꓬꓔꓰ") == "BYTE" and S.skeleton_of("ⲞⲤⲦ") == "OCT" and S.skeleton_of("ᏢᎪ") == "PA" and S.skeleton_of("ᴏᴠᴡ") == "ovw"
    assert S.skeleton_of("α") == "α" and S.skeleton_of("γ") != "y"
