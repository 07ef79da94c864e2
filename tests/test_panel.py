import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from xsecta.functions import kernels as K
from xsecta.operators import metrics as M
from xsecta.operators import signals as S
from xsecta.operators import solve
from xsecta.sources import panel as P

SF = "/root/testdata/sf0.001"


def panel(spark, columns, start=dt.date(2020, 1, 1)):
    rows = [(start + dt.timedelta(days=i), t, v) for t, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, ticker string, close double")


def test_a_gap_costs_the_date_for_all(spark):
    got = S.returns(panel(spark, {"a": [1.0, 2.0, 4.0, 8.0], "b": [1.0, None, 2.0, 3.0]})).orderBy("date", "ticker").collect()
    assert [(r.ticker, r.ret) for r in got] == [("a", 1.0), ("b", 0.5)]


def test_percent_rank_averages_ties(spark):
    df = panel(spark, {"a": [1.0], "b": [1.0], "c": [2.0], "d": [3.0]})
    assert sorted(r[0] for r in df.select(K.percent_rank("close")).collect()) == [0.375, 0.375, 0.75, 1.0]


def test_few_names_give_zero(spark):
    assert {r.z for r in K.z_pop(panel(spark, {"a": [1.0], "b": [5.0]}), "close", "z").collect()} == {0.0}


def test_missing_name_gets_less_than_mean(spark):
    got = K.robust_z(panel(spark, {"a": [1.0], "b": [2.0], "c": [4.0], "d": [9.0], "e": [None]}), "close", "z").collect()
    assert abs(sum(r.z for r in got)) < 1e-9 and [r.z for r in got if r.ticker == "e"][0] != 0


def test_flat_market_has_no_beta(spark):
    rets = panel(spark, {"a": [0.1, 0.2, 0.1, 0.3, 0.2, 0.1]}).withColumnRenamed("close", "ret")
    market = rets.select("date", F.lit(0.01).alias("mkt_ret"))
    assert M.static_betas(rets, market).first().beta == 0.0


def test_total_loss_keeps_a_product(spark):
    pnl = spark.createDataFrame([(dt.date(2020, 1, 31), -1.0), (dt.date(2020, 2, 29), 0.5)], "period_end date, pnl double")
    assert [r.equity for r in M.equity(pnl).orderBy("period_end").collect()] == [0.0, 0.0]


def test_new_rows_win_in_the_cache(spark):
    old, new = panel(spark, {"a": [1.0, 2.0]}), panel(spark, {"a": [9.0]})
    assert sorted(r.close for r in P.merge_cache(old, new).collect()) == [2.0, 9.0]


def test_unknown_side_raises(spark):
    with pytest.raises(Exception, match="unknown side"):
        spark.range(1).select(K.trade_pnl(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit("x"))).collect()


def test_solver_is_feasible():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 12)) / 100
    mu, beta = rng.normal(size=12), rng.normal(1, 0.2, 12)
    w = solve.mean_variance(mu, solve.shrunk(x), beta, bound=0.2)
    assert abs(w.sum()) < 1e-4 and np.abs(w).sum() <= 2 + 1e-4 and np.abs(w).max() <= 0.2 + 1e-4 and abs(beta @ w) <= 0.02 + 1e-4 and mu @ w > 0


def test_eigen_floor():
    s = solve.eigen_floor(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert np.linalg.eigvalsh(s).min() > 0 and np.allclose(s, s.T)


def rows_read(spark, name):
    """Rows that all stages read from files while the query is made and run."""
    from xsecta.plans import registry

    sc = spark.sparkContext._jsc.sc()
    store, none = sc.statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    sc.listenerBus().waitUntilEmpty(30_000)
    last = max([-1, *(s.stageId() for s in stages())])
    registry.QUERIES[name](spark, SF).collect()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(s.inputRecords() for s in stages() if s.stageId() > last)


@pytest.mark.parametrize("name", ["op3_sector_rows", "op4_unit_rows", "op5_principal_axes"])
def test_lines_are_read_once(spark, name):
    lines = P.read(spark, SF, "lineitem").count()
    assert lines <= rows_read(spark, name) < 2 * lines
