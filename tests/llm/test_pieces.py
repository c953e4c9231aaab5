import random
import re

import pytest

from threadloom.llm import pieces as P

POSTS = "id long, plain_text string, updated_at string"
STATUS = "doc_id string, chunks_list array<string>, updated_at string"
T0, T1 = "2024-01-01T00:00:00.000Z", "2024-02-01T00:00:00.000Z"


def texts(rng, n):
    out = []
    for _ in range(n):
        parts = []
        while sum(map(len, parts)) < rng.choice([10, 60, 300, 900]):
            parts.append("".join(rng.choice("abcé日𝄞") for _ in range(rng.choice([1, 3, 7, 12, 45]))) + rng.choice([" ", "。", "\n", "！", " 　", ""]))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("size", [40, 64, 1 << 16])
def test_split_whatever_the_range(spark, size, monkeypatch):
    monkeypatch.setattr(P, "SPAN", 3)
    limit, overlap = 40, 6
    items = {str(i): t for i, t in enumerate(texts(random.Random(size), 40))}
    df = spark.createDataFrame(list(items.items()), "item_key string, body string")
    got = {}
    for r in P.split_texts(df, limit, overlap, size).collect():
        got.setdefault(r.item_key, []).append(r)
    assert set(got) == {k for k, t in items.items() if len(t) > limit}
    for k, rows in got.items():
        t = items[k]
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        assert rows[0].start_at == 0 and rows[-1].end_at == len(t)
        for a, b in zip(rows, rows[1:]):
            assert b.start_at == max(0, a.end_at - overlap) and b.end_at > a.end_at
        for r in rows:
            assert r.body == t[r.start_at : r.end_at] and len(r.body) <= limit
        cuts = {m.end() for m in re.finditer(r"[\s。！？]", t)} | {len(t)}
        for a, r in zip([None, *rows], rows):
            done = a.end_at if a else 0
            if any(done < c <= r.start_at + limit for c in cuts):
                assert r.end_at in cuts


@pytest.mark.parametrize("size", [5, 64, 1 << 16])
def test_kinds_whatever_the_range(spark, size, monkeypatch):
    monkeypatch.setattr(P, "SPAN", 2)
    items = {str(i): t for i, t in enumerate(texts(random.Random(size + 1), 60))}
    df = spark.createDataFrame(list(items.items()), "item_key string, body string")
    ranges = P.text_ranges(df, 30, size)
    got = {r.item_key: r.cut_kind for r in P.cut_kinds(P.stitch(P._scan(ranges, P.text_breaks, 3)), 30).collect()}
    assert got == {k: "inside" if max(map(len, re.split(r"[\s。！？]", t))) > 30 else "boundary" for k, t in items.items() if len(t) > 30}


def found(spark, posts, status, ps=POSTS, ss=STATUS):
    return sorted(map(tuple, P.found(spark.createDataFrame(posts, ps), spark.createDataFrame(status, ss)).collect()))


def test_found(spark):
    word = "word " * 500
    posts = [(1, word, T0), (1, "short", T1), (2, "x" * 2001, T0), (3, "x" * 2000, T0), (4, "x" * 2000 + " y", T0), (5, None, T0), (6, "", T0), (7, word, T1), (7, word, T1), (7, "x" * 3000, T0), (8, "。".join(["x" * 900] * 3), None), (None, None, None)]
    parts = lambda n: ["c", *[f"c-p{i}" for i in range(1, n)]]
    status = [("a", parts(13), T0), ("b", parts(12) + ["d"], T0), ("c", ["e"] * 12, T0), ("d", None, T0), ("e", [], T0), ("f", ["x-p1", *parts(12)], T0), ("g", [None] * 13, T0), ("h", parts(13), T0), ("h", ["z"], T1), ("i", ["c", *[f"c-p{i}" for i in range(2, 14)]], T0)]
    assert found(spark, posts, status) == [
        ("chunks_list", "a", "inside"), ("chunks_list", "b", "boundary"), ("chunks_list", "f", "boundary"), ("chunks_list", "g", "boundary"), ("chunks_list", "i", "boundary"),
        ("plain_text", "2", "inside"), ("plain_text", "4", "boundary"), ("plain_text", "7", "boundary"), ("plain_text", "8", "boundary"),
    ]


def test_empty_and_clashing(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "x" * 2001, T0, "a", 5)], [], POSTS + ", Plain_Text string, n int") == [("plain_text", "1", "inside")]


def test_lists(spark):
    body = [f"c{i // 4}" if i % 4 == 0 else f"c{i // 4}-p{i % 4}" for i in range(50)]
    df = spark.createDataFrame([("a", body), ("b", body[:12])], "item_key string, body array<string>")
    rows = sorted(P.split_lists(df, 12, 1, 16).collect(), key=lambda r: r.piece_no)
    assert rows[-1].end_at == 50 and all(len(r.body) <= 12 and r.body == body[r.start_at : r.end_at] for r in rows)
    assert all(b.start_at == a.end_at - 1 and a.end_at % 4 == 0 for a, b in zip(rows, rows[1:]))


def test_files(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(rng.choice(["word", "日本", "ü"]) + rng.choice([" ", "。", "", "\n"]) for _ in range(20_000))
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    data = path.read_bytes()
    rows = sorted(P.split_files(spark, [f"file://{path}"], 500, 40, 4096).collect(), key=lambda r: r.piece_no)
    assert rows[0].start_at == 0 and rows[-1].end_at == len(data)
    cuts = {len(text[: m.end()].encode()) for m in re.finditer(r"[\s。！？]", text)} | {len(data)}
    for a, b in zip([None, *rows], rows):
        assert b.end_at - b.start_at <= 500 and b.end_at in cuts and (a is None or b.start_at == a.end_at - 40)
    assert P.read_bytes(f"file://{path}", 10, 20) == data[10:30]


def test_characters_of_two_widths(spark):
    text = "a😀 " * 60_000
    df = spark.createDataFrame([("a", text)], "item_key string, body string")
    rows = sorted(P.split_texts(df).collect(), key=lambda r: r.piece_no)
    assert rows[-1].end_at == len(text) and all(r.body == text[r.start_at : r.end_at] for r in rows)


def test_long_text_without_boundary(spark):
    df = spark.createDataFrame([("a", "x" * 300_000 + " end")], "item_key string, body string")
    rows = P.split_texts(df).collect()
    assert max(r.end_at for r in rows) == 300_004 and all(len(r.body) <= 2000 for r in rows)
    with pytest.raises(ValueError):
        P.split_texts(df, 10, 10)
