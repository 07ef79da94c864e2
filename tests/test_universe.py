import datetime as dt

import pytest
from pyspark.sql import functions as F

from xsecta.operators import outputs as O
from xsecta.operators import reports as R
from xsecta.operators import signals as S
from xsecta.plans import config
from xsecta.sources import universe as U

DAYS = [dt.date(2024, 1, d) for d in range(1, 7)]


def prices(spark, tickers, days=DAYS):
    return spark.createDataFrame([(d, t, float(10 * i + d.day)) for i, t in enumerate(tickers, 1) for d in days], U.SHAPE)


def test_only_missing_windows_are_fetched(spark, tmp_path):
    path = str(tmp_path / "cache")
    O.write_cache(prices(spark, ["A", "B"], DAYS[:3]), path)
    asked = []

    def fetch(spark, tickers, start, end):
        asked.append((tickers, start, end))
        return prices(spark, tickers, [d for d in DAYS if start <= str(d) <= end])

    got, merged = U.cached_prices(spark, path, ["B", "A", "C", "A"], "2024-01-01", "2024-01-05", fetch)
    assert sorted(asked) == [(["B", "A"], "2024-01-04", "2024-01-05"), (["C"], "2024-01-01", "2024-01-05")]
    assert got.groupBy("ticker").count().sort("ticker").collect() == [("A", 5), ("B", 5), ("C", 5)] and merged.count() == 15
    assert U.read_cache(spark, str(tmp_path / "none"), ["A"]).isEmpty()


def test_universe_keeps_the_order_asked_for(spark):
    stocks, market, there = U.universe(prices(spark, ["A", "B", "M"]), ["B", "X", "A"], "M")
    assert there == ["B", "A"] and market.columns == ["date", "px"] and stocks.count() == 12
    with pytest.raises(ValueError):
        U.universe(prices(spark, ["A"]), ["A"], "M")
    assert {r.ticker: r.sector for r in U.sector_table(spark, ["XOM", "?", "XOM"]).collect()} == {"XOM": "Energy", "?": "Other"}
    assert len(U.SECTORS) == 50


def test_a_run_is_read_as_it_was_written(spark, tmp_path):
    pnl = spark.createDataFrame([(DAYS[0], 0.1), (DAYS[1], -0.2)], "period_end date, pnl double")
    weights = prices(spark, ["A", "B.C"]).withColumnRenamed("close", "weight")
    cfg = config.settings("MOM_MONTHLY")
    O.write_run(str(tmp_path), pnl, weights, cfg, start="2024-01-01")
    a, b, chosen, context = O.read_run(spark, str(tmp_path))
    assert sorted(a.collect()) == sorted(pnl.collect()) and sorted(b.collect()) == sorted(weights.collect())
    assert chosen == cfg and context == {"start": "2024-01-01"}
    O.write_tables(str(tmp_path), {"t": (pnl, ["period_end"])})
    assert spark.read.csv(f"{tmp_path}/t.csv", header=True).count() == 2


def test_overlay_and_equity(spark):
    one = prices(spark, ["A"]).withColumnRenamed("close", "score")
    got = S.overlay(one, one.filter(F.col("date") < "2024-01-03").withColumn("score", F.lit(1.0)), 0.5).orderBy("date").collect()
    assert [r.score for r in got[:3]] == [6.0, 6.5, 6.5]
    pnl = spark.createDataFrame([(DAYS[0], 0.1), (DAYS[1], None), (DAYS[2], -0.1)], "period_end date, pnl double")
    assert [round(r.pnl, 9) for r in R.to_equity(pnl, "pnl", "period_end").collect()] == [1.1, 1.1, 0.99]
    down = pnl.withColumn("pnl", -F.abs("pnl"))
    assert R.to_equity(down, "pnl", "period_end").collect() == down.collect()
    flat = S.reversion_from_prices(prices(spark, ["A", "B", "C"]))
    assert flat.count() == 18 and not flat.filter("score is null").count()


def test_a_written_cache_keeps_other_tickers_and_survives_a_failure(spark, tmp_path):
    path = str(tmp_path / "cache")
    O.write_cache(prices(spark, ["A", "B", "Z"], DAYS[:3]), path)
    fetch = lambda spark, tickers, start, end: prices(spark, tickers, [d for d in DAYS if start <= str(d) <= end])
    _, merged = U.cached_prices(spark, path, ["A", "B"], "2024-01-01", "2024-01-05", fetch)
    O.write_cache(merged, path)  # reads the cache that it writes
    every = lambda: {r.ticker: r["count"] for r in U.read_cache(spark, path, ["A", "B", "Z"]).groupBy("ticker").count().collect()}
    assert every() == {"A": 5, "B": 5, "Z": 3}
    broken = prices(spark, ["A", "Z"]).withColumn("close", F.when(F.col("ticker") == "Z", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="broken"):
        O.write_cache(broken, path)
    assert every() == {"A": 5, "B": 5, "Z": 3}
