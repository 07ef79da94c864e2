import os

import duckdb
import pytest

from xsecta.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "part", "orders")
#: One query of each family at least; all of them are compared at a larger scale outside the tests.
CHECKED = """src1_prices src14_hygiene src16_missing_window st1_merge_cache ts1_returns ts2_forward_returns ts10_rolling_betas sg1_momentum_engine sg2_momentum_signal
sg6_mean_reversion sg9_overlay k1_zscore k3_robust_z k9_percent_rank cal1_rebalance_grid cal3_riskfree_periods cal4_panel_periods ag2_ic_spearman ag12_binding
ag13_binding_summary ag15_rolling_exposure ag18_window_betas ag19_sectors ag23_cooldowns rm1_psd_repair rm3_ewma_cov rm4_ledoit_wolf rm6_kernel_cov_demeaned rm10_plug_in_shrinkage
ml1_features ml2_training_rows bt2_alpha bt3_ready_dates op4_unit_rows pl3_equity_vs_market snk7_weekly_deciles""".split()


def rows(df):
    plain = lambda v: None if v is None or v != v else str(v)[:10] if hasattr(v, "year") else v
    return [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]


def key(row):
    return tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


def alike(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6 * max(1.0, abs(a)))


def compared(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLE_SQL[name]).df()
    assert set(a.columns) == set(b.columns) and len(a) == len(b)
    words = lambda r: tuple(v for v in r if not isinstance(v, float))
    x, y = (sorted(rows(df), key=lambda r: (str(words(r)), key(r))) for df in (a, b))
    wrong = [(p, q) for p, q in zip(x, y) if not all(map(alike, p, q))]
    assert not wrong, wrong[:2]


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, name):
    compared(spark, name)


def test_same_rows_with_code_generation(spark):
    held = {c: spark.conf.get(c) for c in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.wholeStage", "true")
        spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
        for name in ("sg7_blend", "ag1_performance", "rm2_sample_cov"):
            compared(spark, name)
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_every_query_has_a_name():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and os.path.exists(SF)
    assert set(CHECKED) <= set(registry.ORACLE_SQL)
