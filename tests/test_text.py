from pyspark.sql import functions as F

from threadloom.functions import tags
from threadloom.functions import text as X


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tags(spark):
    got = col(spark, ["  a ", '{"id": 3, "name": " N ", "slug": "s.x"}', '{"name": "1.2", "slug": "12-tag"}', '{"name": "n", "slug": "  "}', '{"name": "n", "slug": null}', None, "", "{bad", '{"name": "", "slug": ""}'], tags.tag_fields)
    assert [r.tag_label for r in got] == ["a", "s.x", "1.2", "n", "n", None, None, "{bad", None]
    assert got[1].tag_id == 3 and got[1].tag_name == "N"


def test_functions(spark):
    assert col(spark, ["x" + "A" * 250 + " y", "short", None, "", "B" * 200], X.blobs_elided) == ["<251-char encoded blob elided> y", "short", None, "", "<200-char encoded blob elided>"]
    assert col(spark, ["User Jdoe Person", "UserStory", "User", "J Doe", None], X.affixes_stripped) == ["Jdoe", "UserStory", "User", "JDoe", None]
    assert col(spark, ["reporting", "sing", "boxes", "used", "cats", None], X.stem) == ["report", "sing", "boxe", "used", "cats", None]
    assert col(spark, ["Hello there. More", "no end", "", None], X.first_sentence) == ["Hello there.", "no end", "", None]
    assert col(spark, ["a|b\nc", None], X.markdown_cell) == ["a\\|b c", ""]
    assert col(spark, ["a save file and a save", None, ""], lambda c: X.blocklist_hits(c, ("save", "save file"))) == [["save", "save file"], None, []]


def test_html():
    assert X.html_to_text("<p>ok</p> R&amp;D <b>x</b>") == "ok R&D x"
    assert X.html_to_text(None) is None and X.html_to_text("") == ""


def test_month_bins(spark):
    got = col(spark, ["2018-01-01", "2018-06-04", "2022-11-30", "2017-07-14"], lambda c: X.month_bin(c.cast("timestamp_ntz")))
    assert got == [0, 5, 58, 0]
