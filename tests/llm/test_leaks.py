import random
import re

import numpy as np

from threadloom.llm import leaks as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def found(spark, docs, items, ds=DOCS, is_=ITEMS):
    return sorted(map(tuple, L.found(spark.createDataFrame(docs, ds), spark.createDataFrame(items, is_)).collect()))


def brute(docs, items, run=13):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    known = {i: grams(words(t)) for i, t in items}
    return sorted({(d, i) for d, t in docs for i, g in known.items() if grams(words(t)) & g})


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)))) for i in range(25)]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(30)))]
        if rng.random() < 0.6:
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts.append(rng.choice([" ", " >> ", "\n* "]).join(w[a : a + rng.randrange(9, 20)]).upper())
        parts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(30))))
        docs.append((d, " ".join(parts)))
    assert found(spark, docs, items) == brute(docs, items) != []


def test_nulls_empty_ties_repeats(spark):
    p = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(1, p), (2, p), (3, None), (4, ""), (5, "one two"), (1, p), (None, p)]
    docs = [(1, p), (1, p), (2, p.upper() + "!"), (3, None), (4, ""), (5, " ".join(p.split()[:12])), (6, p.replace(" ", "_")), (None, p), (7, "x " * 5000 + p)]
    assert found(spark, docs, items) == [(d, i) for d in (1, 2, 6, 7) for i in (1, 2)]
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_clashing_columns(spark):
    p = " ".join(f"a{i}" for i in range(14))
    assert found(spark, [(1, p, "x", 3)], [(9, p, "y", 4)], DOCS + ", Text string, gram int", ITEMS + ", TEXT string, text_id int") == [(1, 9)]


def test_without_sending_grams(spark, monkeypatch):
    monkeypatch.setattr(L, "SENT_GRAMS", 0)
    p = " ".join(f"a{i}" for i in range(20))
    assert found(spark, [(1, p), (2, "b " * 30)], [(9, p)]) == [(1, 9)]


def test_alignment():
    ids = lambda s: np.array([hash(w) & 0xFFFF for w in s.split()], dtype=np.uint64)
    a = ids("a b c d e f g")
    assert L.align(a, a) == (14, 7)
    score, run = L.align(a, ids("x a b c X e f g y"))
    assert (score, run) == (11, 3)
    score, run = L.align(a, ids("a b c q d e f g"))
    assert (score, run) == (13, 4)
    assert L.align(a, ids("z z")) == (0, 0) and L.align(a, ids("")) == (0, 0)


def test_edited_copy_scores(spark):
    w = [f"k{i}" for i in range(40)]
    edited = w[:14] + ["new"] + w[15:]
    rows = L.leaks(spark.createDataFrame([(1, " ".join(edited))], DOCS), spark.createDataFrame([(1, " ".join(w))], ITEMS)).collect()
    assert [(r.score, r.run_words, r.item_words) for r in rows] == [(77, 25, 40)]


def test_copies_edited_all_over(spark):
    """An edit every 8 to 10 words leaves no run of RUN words; the copy is aligned, also beside a whole one that holds every n-gram."""
    w = [f"k{i}" for i in range(60)]
    docs = [(n, " ".join(f"new{i}" if i % n == n - 1 else x for i, x in enumerate(w))) for n in (8, 9, 10)]
    for more in ([], [(1, " ".join(w))]):
        rows = L.leaks(spark.createDataFrame(docs + more + [(2, " ".join(w[:7]))], DOCS), spark.createDataFrame([(1, " ".join(w))], ITEMS)).collect()
        got = {r.doc_id: (r.score, r.run_words) for r in rows}
        assert {n: got.get(n) for n in (8, 9, 10)} == {8: (99, 7), 9: (102, 8), 10: (103, 9)}
        assert (got.get(1) == (120, 60)) == bool(more)


def test_alignments_together_are_those_of_each():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 9, rng.integers(0, 40)).astype(np.uint64), rng.integers(0, 9, rng.integers(0, 70)).astype(np.uint64)) for _ in range(150)]

    def plain(a, b):
        h, run, best, longest = np.zeros((len(a) + 1, len(b) + 1), int), np.zeros((len(a) + 1, len(b) + 1), int), 0, 0
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
                run[i + 1, j + 1] = run[i, j] + 1 if a[i] == b[j] else 0
        return int(h.max()), int(run.max())

    assert L.align_all(pairs) == [plain(a, b) for a, b in pairs]


def test_windows():
    assert L.windows([], 100, 20) == [] and L.windows([50], 100, 10) == [(20, 85)]
    assert L.windows([5, 500, 510], 1000, 13) == [(0, 49), (461, 554)]


def edited(rng, words, share):
    """A copy with that share of its words replaced, left out or followed by another."""
    out = []
    for w in words:
        x = rng.random()
        out += [w] if x >= share else rng.choice([["new" + str(rng.randrange(10**6))], [], [w, "more" + str(rng.randrange(10**6))]])
    return out


def test_recall_of_edited_copies(spark):
    """Copies of items in other texts, an edit in every ten to four words, beside texts of the same words that hold none."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(1500) for _ in range(1 + 300 // (k + 1))]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30, 90)))) for i in range(40)]
    docs, planted, key = [], {}, 0
    for share in (0.1, 0.15, 0.2, 0.25):
        for i, text in items:
            words = [*rng.choices(vocabulary, k=rng.randrange(80)), *edited(rng, text.split(), share), *rng.choices(vocabulary, k=rng.randrange(80))]
            docs.append((key, " ".join(words)))
            planted.setdefault(share, set()).add((key, i))
            key += 1
    docs += [(key + n, " ".join(rng.choices(vocabulary, k=150))) for n in range(150)]
    got = {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    for share, want in planted.items():
        assert len(got & want) >= 0.9 * len(want), (share, len(got & want), len(want))
    assert len(got - set().union(*planted.values())) <= 2


def test_bloom_filter_holds_what_it_was_given(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(-(1 << 62), 1 << 62, 5000)
    bits = L.bloom(spark.createDataFrame([(int(x),) for x in g], "gram long").repartition(3), 1 << 23)
    one, other = L._bits(g, 1 << 23)
    assert (bits[one >> 3] >> (7 - (one & 7)) & bits[other >> 3] >> (7 - (other & 7)) & 1).all() and np.unpackbits(bits).sum() <= 10_000


def test_one_mould_with_other_names_is_no_leak(spark):
    mould = "during the winter trial at {} the crew of engine {} carried spare parts across the {} bridge before a train from {} arrived and went on"
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("bdfgklmnprst", k=9))
    items = [(i, " ".join(mould.format(name(), rng.randrange(900), name(), name()) for _ in range(3))) for i in range(30)]
    other = [(i, " ".join(mould.format(name(), rng.randrange(900), name(), name()) for _ in range(3))) for i in range(60)]
    copy = edited(rng, items[7][1].split(), 0.12)
    got = L.leaks(spark.createDataFrame([*other, (99, " ".join(copy))], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(99, 7)}
