"""Scalar expressions on text, all inside the JVM but for html_text."""

from __future__ import annotations

import pandas as pd
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tags import stripped


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def html_to_text(markup: str | None) -> str | None:
    """Text nodes of markup, references decoded, script text kept, stripped; what the parser holds back at the end is lost."""
    if markup is None:
        return None
    p = _Collector()
    p.feed(markup)
    return "".join(p.found).strip()


@F.pandas_udf(T.StringType())
def _html_text(markup: pd.Series) -> pd.Series:
    return markup.map(html_to_text, na_action="ignore")


def html_text(markup: Column | str) -> Column:
    """html_to_text by Arrow batches."""
    return _html_text(markup)


def sanitized(text: Column) -> Column:
    """Text without control characters, surrogates and non-characters; tabs and line ends stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffe}\x{ffff}]", "")


def blobs_elided(text: Column, least: int = 200) -> Column:
    """Runs of `least` or more base64 characters replaced by a note of their length."""
    run = r"[A-Za-z0-9+/=]{%d,}" % least
    gaps, runs = F.split(text, run), F.regexp_extract_all(text, F.lit(run), F.lit(0))
    notes = F.transform(runs, lambda r: F.concat(F.lit("<"), F.length(r).cast("string"), F.lit("-char encoded blob elided>")))
    return F.when(text.isNotNull(), F.concat_ws("", F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), notes.alias("n")), lambda z: F.array(F.coalesce(z["g"], F.lit("")), F.coalesce(z["n"], F.lit("")))))))


def affixes_stripped(name: Column) -> Column:
    """`User X` and `X Person` as X, without any white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^User\s+", ""), r"\s+Person$", ""), r"\s+", "")


def separators_folded(tag: Column) -> Column:
    """The marks between the parts of a tag as hyphens."""
    return F.translate(tag, "․‧·._", "-----")


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    """The first n characters and a mark, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


# Words without weight in relation keywords.
STOP_WORDS = (
    "a", "an", "the", "of", "to", "in", "on", "for", "with", "by", "from", "and", "or", "as", "at", "is", "are", "be", "this", "that", "it", "its",
    "via", "into", "out", "up", "down", "over", "under", "between", "type", "thing", "stuff", "item",
)


def tokens(phrase: Column) -> Column:
    """The tokens of a phrase: small, from a letter on, two characters or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(phrase), F.lit(r"[a-z][a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def stem(token: Column) -> Column:
    """A token without the first of ing, ed, es, s that it ends with, if more than three characters stay."""
    found = token
    for suffix in ("s", "es", "ed", "ing"):
        n = len(suffix)
        found = F.when((F.length(token) > n + 3) & token.endswith(suffix), F.substr(token, F.lit(1), F.length(token) - n)).otherwise(found)
    return found


def month_bin(moment: Column) -> Column:
    """Months since January 2018, none before it."""
    return F.greatest(F.lit(0), (F.year(moment) - 2018) * 12 + F.month(moment) - 1)


def quarter_of_bin(b: Column) -> Column:
    """`2019-Q3` of a month bin."""
    return F.concat((F.floor(b / 12) + 2018).cast("string"), F.lit("-Q"), (F.floor((b % 12) / 3) + 1).cast("string"))


def first_sentence(text: Column, n: int = 160) -> Column:
    """Up to the first full stop, question or exclamation mark before white space or the end, no more than n characters."""
    whole = stripped(text)
    found = F.regexp_extract(whole, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return truncated(F.when(found == "", whole).otherwise(found), n, "…")


def markdown_cell(text: Column) -> Column:
    """Text that is safe in a table cell."""
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))


def blocklist_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The listed terms a text holds as whole words, case ignored: each once, sorted; longer terms go first where they overlap."""
    pattern = r"\b(" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + r")\b"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))))


def document_id(text: Column) -> Column:
    """`doc-` and the digest of the sanitised text."""
    return F.concat(F.lit("doc-"), F.md5(stripped(sanitized(text)).cast("binary")))


def display_name(username: Column) -> Column:
    """A username as a name: words between marks, each with a capital."""
    return F.initcap(F.regexp_replace(F.regexp_replace(username, r"[0-9]+$", ""), r"[_.\-]+", " "))


def file_slug(name: Column) -> Column:
    """A name that is safe in a file name."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-")
