"""The relations read, shuffle and sort only what they show."""

import pytest

from threadloom.operators import reports as R
from threadloom.operators.views import POST_ORDER, POST_TIES, Corpus, newest


@pytest.mark.parametrize("name", ["users_top", "user_activity", "response_time_by_category", "topic_participants", "topic_threads", "topic_summary", "activity_monthly", "missing_posts", "structure_profile"])
def test_no_texts_in_counts(spark, data, name):
    c = Corpus(spark, data)
    df = getattr(R, name)(c) if hasattr(R, name) else getattr(c, name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "plain_text" not in plan and "cooked" not in plan


def test_one_version_in_both(spark, data):
    """Narrow posts and those with texts are the same versions."""
    c = Corpus(spark, data)
    assert c.posts_text.drop("plain_text").exceptAll(c.posts).isEmpty() and c.posts.exceptAll(c.posts_text.drop("plain_text")).isEmpty()


def test_ties_have_one_order(spark):
    schema = "id long, " + ", ".join(f"{n} string" for n in POST_ORDER + POST_TIES)
    a, b = ("x",) * 11, ("x",) * 10 + ("y",)
    df = spark.createDataFrame([(1, *a), (1, *b), (1, *a)], schema)
    assert [r.reply_to_post_number for r in newest(df, "id", POST_ORDER + POST_TIES).collect()] == ["y"]
