import random

from threadloom.llm import quality as Q

DOCS, WORDS = "doc_id long, text string", "lang string, word string"
COMMON = [("en", w) for w in "the a an and or but if to of in on at by for with from is was are it this that i you we not my our when after has have so then there than about".split()]


def corpus(seed=1):
    """Documents of a known kind, from words of this test alone."""
    rng = random.Random(seed)
    nouns = "lamp river engine garden window market bottle ladder kitchen harbour".split()
    verbs = "sees opens finds moves keeps takes loses paints".split()
    out = []
    for i in range(60):
        sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} of my {rng.choice(nouns)} when it is on the {rng.choice(nouns)}."
        out.append((i, " ".join(sentence().capitalize() for _ in range(6)), "prose"))
        out.append((100 + i, "\n".join(f"- {rng.choice(verbs)[:-1]} {rng.choice(nouns)}" for _ in range(12)), "list"))
        out.append((200 + i, "\n".join("\t".join(rng.choice([rng.choice(nouns), str(rng.randrange(9999)), "n/a"]) for _ in range(5)) for _ in range(9)), "table"))
        out.append((300 + i, "\n".join("".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=76)) for _ in range(8)), "junk"))
    return out


def kinds(spark, rows, schema=DOCS, words=COMMON):
    return {r.doc_id: r.kind for r in Q.kinds(spark.createDataFrame(rows, schema), spark.createDataFrame(words, WORDS)).collect()}


def test_kinds_of_a_known_corpus(spark):
    docs = corpus()
    got = kinds(spark, [d[:2] for d in docs])
    right = sum(got[i] == kind for i, _, kind in docs)
    assert right >= 0.95 * len(docs)


def test_found_leaves_prose_out(spark):
    docs = corpus(2)
    got = Q.found(spark.createDataFrame([d[:2] for d in docs], DOCS), spark.createDataFrame(COMMON, WORDS))
    assert got.columns == ["doc_id", "kind"] and not [r for r in got.collect() if r.kind == "prose"]


def test_nulls_blank_empty_long_clashing(spark):
    long = " ".join(t for _, t, kind in corpus(4) if kind == "prose") * 20
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t　", "x"), (None, "a b", "x"), (4, long, "x"), (4, long, "x")]
    got = kinds(spark, rows, DOCS + ", Text string")
    assert set(got) == {4} and got[4] == "prose"
    assert kinds(spark, []) == {} and kinds(spark, [(1, "some text")], words=[]) is not None


def test_statistics(spark):
    rows = [(1, "The cat, sat.\n\n- on it!\nx"), (2, None), (3, ""), (4, "日本語 テスト。")]
    got = {r.doc_id: r for r in Q.statistics(spark.createDataFrame(rows, DOCS), spark.createDataFrame(COMMON, WORDS)).collect()}
    r = got[1]
    assert (r.word_count, r.common_share, r.punctuated_lines) == (6, 3 / 6, 2 / 3)
    assert r.mean_word_length == 14 / 6 and r.symbol_ratio == 4 / 18
    assert got[2].word_count in (None, -1) or got[2].mean_word_length is None
    assert got[3].word_count == 0 and got[3].mean_word_length is None and got[3].symbol_ratio is None
    assert got[4].punctuated_lines == 1


def test_odd_words():
    assert not Q._odd("engine") and not Q._odd("Biparenida") and Q._odd("prksdulpyg") and Q._odd("aQxBzWkp")


def kitchen(rng):
    """Texts of another vocabulary than the examples': doc kinds and texts about cooking."""
    foods = "onion flour butter pepper lentils saffron walnut barley cabbage yoghurt cinnamon parsley mackerel chestnut".split()
    verbs = ["was simmering for an hour", "tasted of smoke", "needs more salt than you think", "burnt because I forgot it", "came from my aunt in the mountains", "is better on the second day"]
    openers = ["The {} {}.", "I think the {} {}, so we ate it anyway.", "When the guests arrived, the {} {}.", "Nobody told me that the {} {}!", "Why is it that the {} {}?"]
    german = ["Die Suppe war viel zu heiß, aber meine Gäste haben sie trotzdem gegessen.", "Ich habe den Teig über Nacht im Keller stehen lassen.", "Warum ist das Brot heute nicht aufgegangen?"]
    out = []
    for _ in range(25):
        out.append(("prose", " ".join(rng.choice(openers).format(rng.choice(foods), rng.choice(verbs)) for _ in range(rng.randrange(3, 9)))))
        out.append(("prose", " ".join(rng.choices(german, k=4))))
        mark = rng.choice(["- ", "* ", "• "])
        out.append(("list", "\n".join(mark + rng.choice(["chopped ", "two ", "fresh ", ""]) + rng.choice(foods) for _ in range(rng.randrange(5, 12)))))
        sep = rng.choice([",", "\t", ";", " | "])
        out.append(("table", "\n".join(sep.join([rng.choice(foods), str(rng.randrange(900)), rng.choice(["g", "ml", "cup"]), f"{rng.random():.2f}"]) for _ in range(rng.randrange(5, 12)))))
        out.append(("junk", "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=rng.randrange(200, 500)))))
        out.append(("junk", "\n".join(f"{i * 16:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for i in range(6))))
    return out


def test_texts_of_another_vocabulary(spark, data):
    """Held-out accuracy on words that no example has, beside no text of the test tables."""
    rng = random.Random(8)
    texts = kitchen(rng)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in Q.kinds(docs, spark.read.parquet(f"{data}/common_words.parquet")).collect()}
    right = sum(got[i] == k for i, (k, _) in enumerate(texts))
    assert right >= 0.95 * len(texts), [(k, got[i], t[:60]) for i, (k, t) in enumerate(texts) if got[i] != k][:8]
