"""Tags of mixed shape: bare labels, JSON objects and null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Python strips, as a character class.
BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def stripped(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def tag_fields(tag: Column) -> Column:
    """struct(tag_id, tag_name, tag_slug, tag_label) of one stored tag.

    A bare label is name, slug and label. Of an object the label is the slug, or the name if the slug is empty or
    `<digits>-tag`; names and slugs are stripped, ids that are no whole number are null. A null tag has null fields.
    """
    obj = F.when(F.ltrim(tag).startswith("{"), F.from_json(tag, "id string, name string, slug string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    is_obj = F.coalesce(obj.isNotNull() & obj["_bad"].isNull(), F.lit(False))
    bare = stripped(tag)
    name, slug = F.when(is_obj, stripped(obj["name"])).otherwise(bare), F.when(is_obj, stripped(obj["slug"])).otherwise(bare)
    keep = (slug != "") & ~slug.rlike("^[0-9]+-tag$")
    label = F.when(~is_obj, F.nullif(bare, F.lit(""))).when(keep, slug).otherwise(F.nullif(name, F.lit("")))
    return F.struct(F.when(is_obj, obj["id"].try_cast("bigint")).alias("tag_id"), name.alias("tag_name"), slug.alias("tag_slug"), label.alias("tag_label"))


def tag_display(name: Column, slug: Column) -> Column:
    """The text shown for a tag: its name, else its slug, else nothing."""
    return F.coalesce(F.nullif(stripped(name), F.lit("")), F.nullif(stripped(slug), F.lit("")), F.lit(""))
