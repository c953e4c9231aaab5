import base64
import random

import pytest

from threadloom.llm import tokens as K

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a", "<|endoftext|> plain", "I'll don't WE'VE 's 'S", "\r\n\t  tab\x00", "１２ ½ ①  　", "😀👩‍🔧 flags 🇩🇪", "日本語のテキスト。", "a" * 5000, "́́e", "ÅÄÖ ﬁ", "x" + " " * 300 + "y", "퟿￿"]


def test_same_as_ranks(reference):
    e = K.encoder(K.DEFAULT_VOCABULARY)
    rng = random.Random(5)
    more = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x3040, 0x9FFF), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in ODD + more:
        ids = e.encode(t)
        assert ids == reference.encode_ordinary(t), t[:40]
        assert e.decode(ids) == t


def test_full_store_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(K, "STORE", 3)
    e = K.Encoder()
    text = "one two three four five six seven " * 3
    assert e.encode(text) == e.encode(text) == reference.encode_ordinary(text)


def test_ids(spark):
    rows = [(1, "hello world", "u"), (2, None, "u"), (3, "", "u"), (1, "hello world", "v"), (None, "x", "w")]
    df = K.encoded(spark.createDataFrame(rows, "doc_id long, text string, Text string"))
    assert df.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [87])], key=str)
    assert K.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bytes_and_letters():
    assert len(set(K.LETTERS)) == 256 and K.mapped(b" a\n") == "ĠaĊ"
