"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by a sentencepiece model made from that vocabulary.

The model is serialised here: each piece is the byte-mapped form of a vocabulary entry, its score is minus its rank, the
normaliser is the identity, and no piece is added in front, so that merging by score is merging by rank. A text is cut
into pre-tokens by the vocabulary's pattern; no merge crosses them. Pre-tokens are encoded once per worker and kept up
to a bound; how full that store is changes the speed alone.

Null and empty texts have no ids. Texts are encoded whole, whatever their length; special tokens' strings are ordinary
text. decode() is the inverse of encode() on every text.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import columns

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the byte-level vocabularies (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker keeps, and the longest one it keeps.
STORE, STORE_CHARS = 1 << 18, 64


def byte_letters() -> list[str]:
    """For each byte the printable letter that stands for it: itself where it is printable Latin-1 (and no blank or soft hyphen), else the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


LETTERS = byte_letters()
_TO_LETTERS = {b: c for b, c in enumerate(LETTERS)}
_TO_BYTES = {ord(c): b for b, c in enumerate(LETTERS)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One field of a protocol buffer: whole numbers as varints, bytes by length, fractions as 4 bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    """Bytes as letters, one each."""
    return data.decode("latin-1").translate(_TO_LETTERS)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary entries by rank, from lines of base64 and rank."""
    rows = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    entries: list[bytes] = [b""] * len(rows)
    for token, rank in rows:
        entries[int(rank)] = base64.b64decode(token)
    return entries


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last and never occurs, as every byte is an entry."""
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = b"".join(piece(mapped(e), -rank, 1) for rank, e in enumerate(entries)) + piece("<unk>", 0.0, 2)
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(24, 0) + _field(40, len(entries)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Text to ids and back for one vocabulary file."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        import regex
        import sentencepiece

        self.entries = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.entries))
        self.find = regex.compile(PATTERN).findall
        self.store: dict[str, list[int]] = {}

    def pieces(self, pre_tokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token, by the model."""
        return self.model.encode([mapped(x.encode("utf-8", "surrogatepass")) for x in pre_tokens], num_threads=1)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        found, store = self.find(text), self.store
        new = [x for x in {*found} if x not in store]
        own: dict[str, list[int]] = {}
        if new:
            known = dict(zip(new, self.pieces(new), strict=True))
            if len(store) + len(known) > STORE:
                own = known
            else:
                store.update((k, v) for k, v in known.items() if len(k) <= STORE_CHARS)
                own = {k: v for k, v in known.items() if len(k) > STORE_CHARS}
        ids: list[int] = []
        for x in found:
            ids += store[x] if x in store else own[x]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.entries[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once a worker."""
    return Encoder(path)


def located(path: str) -> str:
    """Where a worker has a vocabulary file: among the files sent along, else at its own path."""
    sent = Path(SparkFiles.get(Path(path).name))
    return str(sent) if sent.exists() else path


def send(spark: SparkSession, path: str) -> None:
    """Sends a vocabulary file to every executor, once a context."""
    sent = getattr(spark.sparkContext, "_threadloom_files", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        spark.sparkContext._threadloom_files = sent | {path}


def token_ids(text: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """Column of the ids of a text; an empty list where it is null or empty."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        encode = encoder(located(path)).encode
        return pd.Series([encode(x) if isinstance(x, str) else [] for x in texts], dtype=object)

    return ids(text)


def encoded(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """p6_ids: doc_id, ids."""
    send(documents.sparkSession, path)
    return columns(documents, "doc_id", "text").select("doc_id", token_ids("text", path).alias("ids"))


def decoded(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, text: each text encoded and decoded again; an empty text for a null one."""

    @F.pandas_udf(T.StringType())
    def texts(ids: pd.Series) -> pd.Series:
        decode = encoder(located(path)).decode
        return pd.Series([decode(x) for x in ids], dtype=object)

    return encoded(documents, path).select("doc_id", texts("ids").alias("text"))
