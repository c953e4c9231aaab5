from pyspark.sql import functions as F

from threadloom.operators import incremental as I
from threadloom.operators import synth
from threadloom.operators.views import Corpus


class Changed(Corpus):
    """The corpus without its topic of the least id, and with another title for the next one."""

    @property
    def topics_raw(self):
        low = [r.id for r in super().topics_raw.orderBy("id").limit(2).collect()]
        return super().topics_raw.where(F.col("id") != low[0]).withColumn("title", F.when(F.col("id") == low[1], "Quite another title").otherwise(F.col("title")))


def test_sync(spark, data, tmp_path):
    state = f"file://{tmp_path}/state"
    count = lambda df: {r.action: r["count"] for r in df.groupBy("action").count().collect()}
    c = Corpus(spark, data)
    n = c.topics_raw.count()
    assert count(I.sync(c, state)) == {"INSERT": n}
    first = I.current(spark, state)
    assert count(I.sync(Corpus(spark, data), state)) == {"SKIP": n} and I.current(spark, state) == first
    before = I.recorded(spark, state)
    assert count(I.sync(Changed(spark, data), state)) == {"SKIP": n - 2, "RESEED": 1, "GONE": 1} and I.current(spark, state) != first
    after = I.recorded(spark, state)
    assert after.where("src = 'Quite another title'").count() > 0 and I.retracted(before, after).count() > 0
    assert I.ledger(spark, state).count() == n - 1


def test_made_up_forum(spark):
    t, p = synth.topics(spark, "medium").cache(), synth.posts(spark, "medium").cache()
    assert t.count() == 500 and t.exceptAll(synth.topics(spark, "medium").repartition(7)).isEmpty()
    assert synth.topics(spark, "medium", 1).exceptAll(t).count() > 400
    assert 0.05 < t.where("replies = 0").count() / 500 < 0.16
    assert p.groupBy("topic_id").agg(F.max("post_number").alias("m")).join(t, "topic_id").where("m <> replies + 1").isEmpty()
    assert p.where("post_number > 1 AND reply_to >= post_number").isEmpty()
    u = synth.users(spark, "small")
    assert u.select("username").distinct().count() == 30 and [r.role for r in u.orderBy("user_id").limit(3).collect()] == ["admin", "moderator", "member"]
