import re

from xsecta.llm import resample


def test_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    """A table's files may be small enough for Spark's threshold while its rows don't fit into the driver."""
    plans, saved = [], resample.saved

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(resample, "saved", kept)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(30))) for i in range(200)], "doc_id long, text string")
        target = spark.createDataFrame([(1, "w1 w2 w3 new")], "item_id long, text string")
        for grams in (1, 2):
            out = resample.importance(docs, target, grams=grams)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            assert out.filter("rank is not null").count() == 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    keys = {k for p in plans for k in re.findall(r"BroadcastHashJoin \[(?:coalesce\()?(\w+)#", p)}
    assert keys == {"bucket", "score"}, keys
