import numpy as np
import pytest
from pyspark.sql import functions as F

from xsecta.operators import learn, reports, solve, walk
from xsecta.plans import config


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    days = [d for d in np.arange("2020-01-01", "2021-12-31", dtype="datetime64[D]") if np.is_busday(d)]
    market = rng.normal(0, 0.01, len(days))
    names = [f"T{i:02d}" for i in range(8)]
    x = market[:, None] * rng.uniform(0.5, 1.5, 8) + rng.normal(0, 0.01, (len(days), 8))
    days = [d.item() for d in days]
    rets = spark.createDataFrame([(d, n, float(v)) for d, row in zip(days, x) for n, v in zip(names, row)], "date date, ticker string, ret double").cache()
    mkt = spark.createDataFrame([(d, float(v)) for d, v in zip(days, market)], "date date, mkt_ret double").cache()
    px = spark.createDataFrame([(d, float(v)) for d, v in zip(days, np.cumprod(1 + market))], "date date, px double").cache()
    sectors = spark.createDataFrame([(n, f"S{i % 2}") for i, n in enumerate(names)], "ticker string, sector string")
    return rets, mkt, px, sectors


WIDE = {"position_bound": 0.4, "train_window_days": 300}


def test_profit_is_weights_times_returns_less_cost(tables):
    rets = tables[0]
    run = walk.backtest(*tables, {"a": config.settings("MR_WEEKLY", WIDE | {"rebalance_freq": "ME", "min_name_change": 0.0})}).cache()
    nxt = walk.next_returns(rets, walk.rebalance_grid(rets, "ME"), "ME")
    gain = walk.book(run).join(nxt, ["date", "ticker"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("next_ret")).alias("gain"))
    rows = run.filter("pnl is not null").join(gain, "date").collect()
    assert len(rows) > 12 and all(abs(r.gain - r.cost - r.pnl) < 1e-9 for r in rows)
    assert any(r.executed for r in rows) and not any(r.failed for r in rows)
    for r in rows:  # all names trade here, so books are neutral; volatility scaling may widen the bounds by up to 1.3
        assert abs(sum(r.weights)) < 1e-5 and max(map(abs, r.weights)) < 0.4 * 1.3 + 1e-4


def test_the_future_changes_nothing_before_it(tables):
    rets, mkt, px, sectors = tables
    cut = "2021-06-30"
    shocked = rets.withColumn("ret", F.when(F.col("date") > cut, -F.col("ret")).otherwise(F.col("ret")))
    cfg = {"a": config.settings("COMBO_MONTHLY", WIDE)}
    a, b = (walk.book(walk.backtest(r, mkt, px, sectors, cfg)).filter(F.col("date") <= cut).toPandas().sort_values(["date", "ticker"]) for r in (rets, shocked))
    assert np.abs(a.weight.to_numpy() - b.weight.to_numpy()).max() < 1e-9


@pytest.mark.parametrize("mode", ["GP_MONTHLY", "NYSTROM_MONTHLY"])
def test_models_trade(tables, mode):
    cfg = config.settings(mode, WIDE | {"gp_per_date_name_frac": None, "gp_train_lookback_days": 250, "gp_refit_every": 2})
    grid = walk.rebalance_grid(tables[0], "ME")
    feats = walk.features(tables[0], tables[1], grid, cfg)
    train = walk.training_rows(feats, tables[0], grid, cfg)
    assert train.filter("date >= t").isEmpty() and train.filter(F.date_diff("t", "date") > 250).isEmpty()
    scores = walk.model_scores(feats, train, cfg).toPandas()
    assert len(scores) and np.isfinite(scores.mu).all()


def test_cooldown_needs_losses_and_a_fall():
    assert not walk.is_cool([-0.2]) and not walk.is_cool([0.01] * 5)
    assert walk.is_cool([0.02, 0.01, -0.08, -0.09]) and not walk.is_cool([0.02, 0.01, -0.03, -0.02])


def test_gates_keep_small_trades_out():
    cfg = config.settings("MOM_MONTHLY", {"vol_target_ex_ante": False})
    before, sigma = np.array([0.1, -0.1]), np.eye(2) * 1e-4
    for target, mu in (([0.101, -0.101], [1.0, -1.0]), ([0.3, -0.3], [-1.0, 1.0])):
        held, _, cost, done = walk.trade(np.array(target), before, np.array(mu), solve.Axes.of(sigma).quad, cfg, False, False)
        assert not done and cost == 0 and (held == before).all()
    held, turnover, cost, done = walk.trade(np.array([0.3, -0.3]), before, np.array([1.0, -1.0]), solve.Axes.of(sigma).quad, cfg, False, False)
    assert done and abs(turnover - 0.4) < 1e-12 and abs(cost - 0.4 * 5e-4) < 1e-12


def test_solver_holds_every_constraint():
    rng = np.random.default_rng(1)
    n = 12
    a = rng.normal(size=(n, n)) * 0.01
    sigma, mu, beta = a @ a.T + np.eye(n) * 1e-5, rng.normal(size=n), rng.uniform(0.5, 1.5, n)
    rows, soft = solve.sector_rows(["a", "b", "c"] * 4), solve.principal_rows(sigma, 2)
    w, off = solve.mean_variance_status(mu, sigma, beta, bound=0.3, gross=1.5, budget=0.01, hard=list(rows), soft=[(r, 0.03) for r in soft])
    assert off < 1e-4 and abs(rows @ w).max() < 1e-4 and np.abs(soft @ w).max() < 0.0301 and np.abs(w).sum() < 1.501
    assert w @ sigma @ w < 0.01**2 * 1.02 and abs(beta @ w) < 0.0201 and np.abs(w).max() < 0.3001
    w, off = solve.mean_variance_status(mu, sigma, None, bound=0.3, long_only=True)
    assert off < 1e-4 and abs(w.sum() - 1) < 1e-6 and w.min() > -1e-5
    assert solve.mean_variance_status(mu, sigma, None, bound=0.01, long_only=True, rounds=200)[1] > walk.FAILED


def problem(seed, n=14):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) * 0.01
    return rng.normal(size=n), a @ a.T + np.eye(n) * 1e-5, rng.uniform(0.5, 1.5, n)


def test_axes_stand_for_the_matrix():
    x = np.random.default_rng(4).normal(size=(9, 15)) / 100
    v = np.random.default_rng(5).normal(size=15)
    for model in ("sample", "ewma", "lw", "gp_kernel", "gp_kernel:matern52"):
        s = solve.covariance_of(x, model)
        d = s.dense()
        assert len(s.g) <= 9 and np.linalg.eigvalsh(d).min() > 9e-7
        assert np.allclose(d @ v, s.times(v)) and np.isclose(v @ d @ v, s.quad(v)) and np.allclose(np.linalg.solve(3 * d + 2 * np.eye(15), v), s.solve(3, 2, v))
    w = solve.kernel_ages(9, "rbf", max(1.0, -1 / np.log(0.97)))
    plain = (x * w[:, None]).T @ x
    assert np.allclose(solve.covariance_of(x, "gp_kernel", 0.97).dense(), solve.eigen_floor(solve.eigen_floor(plain), 0.0, 1e-6))
    with pytest.raises(ValueError):
        solve.covariance_of(x, "none")


@pytest.mark.parametrize("seed", range(4))
def test_both_solvers_find_the_same_worth(seed):
    mu, sigma, beta = problem(seed)
    options = {"bound": 0.3, "gross": 1.5, "budget": 0.01 if seed % 2 else None, "soft": [(r, 0.03) for r in solve.principal_rows(sigma, 2)] if seed > 1 else []}
    worth = lambda w: mu @ w - 5 * w @ sigma @ w
    a, off = solve.mean_variance_status(mu, sigma, beta, **options)
    b = solve.interior_point(mu, sigma, beta, **options)
    assert off < 1e-5 and abs(worth(a) - worth(b)) < 1e-3 and solve.violation(b, sigma, beta, **options) < 1e-9


def test_the_second_solver_takes_over_and_tells_what_is_infeasible():
    mu, sigma, beta = problem(9)
    w, status, off, first = solve.cascade(mu, sigma, beta, bound=0.3, rounds=3)
    assert status == "fallback" and first > solve.FAILED and off < 1e-9 and abs(w.sum()) < 1e-9
    _, status, off, first = solve.cascade(mu, sigma, None, bound=0.01, long_only=True, rounds=200)
    assert status == "failed" and off > walk.FAILED
    narrow = solve.interior_point(mu, sigma, beta, bound=0.6, long_only=True, beta_limit=beta.min() + 0.2)
    assert abs(narrow.sum() - 1) < 1e-9 and beta @ narrow <= beta.min() + 0.2 and narrow.min() >= 0
    assert solve.interior_point(mu, sigma, beta, bound=0.6, long_only=True, beta_limit=beta.min() - 0.2) is None


def test_cooldowns_by_windows_equal_the_fold_s(spark):
    import datetime as dt

    rng = np.random.default_rng(6)
    pnl = [float(v) for v in rng.normal(-0.02, 0.06, 60)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    got = walk.cooldowns(spark.createDataFrame(list(zip(days, pnl)), "period_end date, pnl double")).orderBy("period_end").collect()
    want = [walk.is_cool(pnl[: i + 1]) for i in range(60)]
    assert [r.cool for r in got] == want and any(want) and not all(want)


@pytest.mark.parametrize("unit", [False, True])
def test_constraint_rows_by_group_equal_the_dense_ones(spark, unit):
    labels = {"2020-01-31": ["a", "b", "a", None, "Other", "c"], "2020-02-29": ["a", "a", "b", "c", "d", "e"]}
    names = spark.createDataFrame([(d, f"N{i}", s) for d, row in labels.items() for i, s in enumerate(row)], "date string, ticker string, sector string")
    got = {}
    for r in walk.sector_constraints(names, unit).collect():
        got.setdefault((r.date, r.row), np.zeros(6))[int(r.ticker[1])] = r.coefficient
    want = solve.sector_rows(["a", "b", "a", "Other", "Other", "c"], unit)
    assert set(got) == {("2020-01-31", "a"), ("2020-01-31", "Other")} and np.allclose(sorted(map(tuple, got.values())), sorted(map(tuple, want)))


def test_models_learn_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = x @ [1.0, -0.5, 0.2] + rng.normal(0, 0.05, 120)
    new = rng.normal(size=(40, 3))
    for model in (learn.GaussianProcess(x, y, 1e-4), learn.Nystrom(x, y, alpha=1e-4, gamma=0.05)):
        mean, spread = model.predict(new)
        assert np.corrcoef(mean, new @ [1.0, -0.5, 0.2])[0, 1] > 0.95 and (spread >= 0).all()
    rows = learn.balanced_rows(y, 40)
    assert len(rows) == 40 and set(np.argsort(-np.abs(y))[:20]) <= set(rows.tolist())


def test_settings_round_trip():
    cfg = config.settings("GP_MONTHLY", {"risk_aversion": 7.0})
    assert config.loads(config.dumps(cfg, tickers=["A"])) == (cfg, {"tickers": ["A"]})
    assert [config.annual_factor(f) for f in ("W-FRI", "ME", "D")] == [52, 12, 252]
    for wrong in (lambda: config.settings("NONE"), lambda: config.settings(overrides={"x": 1})):
        with pytest.raises(ValueError):
            wrong()


def test_riskfree_periods_start_at_zero(spark):
    daily = spark.sql("select explode(sequence(date'2020-01-10', date'2020-03-31')) date").withColumn("rf_ret", F.lit(0.001))
    ends = spark.sql("select explode(array(date'2019-12-31', date'2020-01-31', date'2020-02-29')) period_end")
    got = [r.rf for r in walk.riskfree_periods(daily, ends).orderBy("period_end").collect()]
    assert got[:2] == [0.0, 0.0] and abs(got[2] - (1.001**29 - 1)) < 1e-12


def test_reports_on_empty_tables(spark):
    none = spark.createDataFrame([], "period_end date, pnl double")
    turn = spark.createDataFrame([], "period_end date, turnover double")
    assert reports.repriced(none, turn).isEmpty() and reports.realized_vol(none).isEmpty() and reports.histogram(none, "pnl").isEmpty()
