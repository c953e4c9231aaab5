"""One consistent form for text that looks alike: a skeleton by decomposition and a look-alike table.

skeleton(text) decomposes, replaces every character by its prototype, decomposes again, and treats blanks and
invisible characters alike. Two texts look the same if and only if their skeletons are equal.

Nulls: the skeleton of null is null. Empty and blank texts have the empty skeleton. Texts are processed whole.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import columns

# Look-alike letters and marks and their prototypes, by script (Unicode TS 39, only pairs whose glyphs
# agree in case and shape; digits and letters such as 0 and O or 1 and l stay apart, and so do letters that only resemble
# one another, such as α and a or γ and y).
LOOK_ALIKES = {
    # Cyrillic, small and capital
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ѵ": "v", "ԍ": "G",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ԍ": "G", "Ԁ": "d", "Һ": "h",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j", "ρ": "p", "ι": "ı",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Armenian
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "Ս": "U", "Տ": "S", "Օ": "O",
    # Latin letters with the glyph of another one
    "ɡ": "g", "ɩ": "ı",
    # Small capitals that have the glyph of the small letter
    "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    # Cherokee
    "Ꭰ": "D", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Hyphens of one width
    "‐": "-", "‑": "-", "﹣": "-", "˗": "-",
    # Quotes, dots and other marks with one glyph
    "ʼ": "’", "＇": "'", "‚": ",", "٫": ",", "∶": ":", "ː": ":", "։": ":", "․": ".", "‧": "·", "∙": "·", "⋅": "·", "‖": "||", "ǀ": "|", "∣": "|", "⁄": "/", "∕": "/", "∖": "\\",
}

#: Kinds of compatibility decomposition that keep what a reader sees. Raised, lowered, circled, squared and fractional signs are signs of their own.
SAME_SIGHT = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters whose <compat> decomposition looks different: long s, lunate and symbol letters, numero and account signs, parenthesised digits.
OTHER_SIGHT = {*"ſﬅϐϑϒϕϖϰϱϲϴϵϹ№℀℁℅℆™", *map(chr, range(0x2474, 0x24B6))}


def _invisible(cp: int) -> bool:
    """Default-ignorable code points, other format characters and controls that are no blanks."""
    return cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE0FFF or unicodedata.category(chr(cp)) in ("Cf", "Cc")


def _prototype(cp: int) -> str:
    """What stands for one code point in a skeleton."""
    char = chr(cp)
    if char.isspace() or cp in (0x2800, 0x180E):
        return " "
    if _invisible(cp):
        return ""
    kind, *rest = unicodedata.decomposition(char).split() or [""]
    if kind.startswith("<"):
        if kind in SAME_SIGHT and char not in OTHER_SIGHT:
            return "".join(_prototype(int(x, 16)) for x in rest)
        return char
    if kind:
        return "".join(_prototype(int(x, 16)) for x in (kind, *rest))
    return LOOK_ALIKES.get(char, char)


class _Table(dict):
    """Prototypes by code point, computed once each; at most as many as Unicode has."""

    def __missing__(self, cp: int) -> str:
        self[cp] = found = _prototype(cp)
        return found


_TABLE = _Table()


def skeleton_of(text: str | None) -> str | None:
    """The skeleton of one text."""
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    return unicodedata.normalize("NFD", text.translate(_TABLE)).strip(" ")


@F.pandas_udf(T.StringType())
def _skeletons(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton_of, na_action="ignore")


def skeleton(text: Column | str) -> Column:
    """Column of skeletons; null where text is null."""
    return _skeletons(text)


def label_of(tag: Column) -> Column:
    """The label of one stored tag: of a JSON object its slug, or its name if the slug is missing, blank or `<digits>-tag`; else the text itself.

    Labels are not trimmed. A null tag, and an object without either, has a null label. Text that starts with a brace
    but is no JSON object is a bare label.
    """
    obj = F.when(F.ltrim(tag).startswith("{"), F.from_json(tag, "name string, slug string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    blank = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*$"
    placeholder = r"^[\s\p{Z}]*[0-9]+-tag[\s\p{Z}]*$"
    no_slug = obj["slug"].isNull() | obj["slug"].rlike(blank) | obj["slug"].rlike(placeholder)
    return F.when(obj.isNotNull() & obj["_bad"].isNull(), F.when(no_slug, obj["name"]).otherwise(obj["slug"])).otherwise(tag)


def look_alike_pairs(things: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a_id, b_id), a_id < b_id, of keys whose texts look the same but differ.

    Texts are compared once per different text: only skeletons that several different texts share enter the join, and it
    pairs texts, not keys; keys are attached afterwards, so that no pair of equal texts is ever formed. Null texts have no
    pairs; repeated rows count once; a key with several texts pairs with others by each of them, never with itself.
    """
    rows = columns(things, key, text).select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL").distinct()
    forms = rows.select("text").distinct().withColumn("skeleton", skeleton("text"))
    shared = forms.groupBy("skeleton").agg(F.count("*").alias("n")).where("n > 1").select("skeleton")
    variants = forms.join(shared, "skeleton")
    a, b = variants.select("skeleton", F.col("text").alias("a")), variants.select("skeleton", F.col("text").alias("b"))
    texts = a.join(b, "skeleton").where("a < b").select("a", "b")
    first, second = rows.select(F.col("id").alias("x"), F.col("text").alias("a")), rows.select(F.col("id").alias("y"), F.col("text").alias("b"))
    pairs = texts.join(first, "a").join(second, "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).distinct()


def labels(topics: DataFrame) -> DataFrame:
    """Distinct (topic_id, label) of topics; null arrays, null tags and null labels give no row."""
    tags = columns(topics, "id", "tags").select(F.col("id").alias("topic_id"), F.explode("tags").alias("tag")).where("tag IS NOT NULL")
    return tags.select("topic_id", label_of(F.col("tag")).alias("label")).where("label IS NOT NULL").distinct()


def misspelt_labels(topics: DataFrame, registry: DataFrame) -> DataFrame:
    """(a_id topic, b_id tag) such that the topic has a label that looks the same as the tag's registered label but isn't equal to it."""
    own = labels(topics)
    forms = own.select("label").distinct().withColumn("skeleton", skeleton("label"))
    official = columns(registry, "tag_id", "label").select("tag_id", F.col("label").alias("official")).where("official IS NOT NULL").distinct().withColumn("skeleton", skeleton("official"))
    wrong = forms.join(official, "skeleton").where("label <> official").select("label", "tag_id")
    return own.join(wrong, "label").select(F.col("topic_id").alias("a_id"), F.col("tag_id").alias("b_id")).distinct()


def found(topics: DataFrame, registry: DataFrame) -> DataFrame:
    """p1_found: field_name, a_id, b_id."""
    titles = look_alike_pairs(topics, "id", "title").select(F.lit("title").alias("field_name"), "a_id", "b_id")
    return titles.unionByName(misspelt_labels(topics, registry).select(F.lit("tags").alias("field_name"), "a_id", "b_id"))


def consistent(topics: DataFrame) -> DataFrame:
    """topic_id, field_name, text, skeleton: every title and label with its one consistent form."""
    titles = columns(topics, "id", "title").where("title IS NOT NULL").select(F.col("id").alias("topic_id"), F.lit("title").alias("field_name"), F.col("title").alias("text"))
    tags = labels(topics).select("topic_id", F.lit("tags").alias("field_name"), F.col("label").alias("text"))
    return titles.unionByName(tags).distinct().withColumn("skeleton", skeleton("text"))
