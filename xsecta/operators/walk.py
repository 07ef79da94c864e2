"""Walk-forward runs: everything that depends on a date alone is planned for all dates at once, and only the trading fold,
which needs the weights before, runs in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import T, X, clip, demean_by_sector, percent_rank, rolling, winsorize, z_samp
from ..plans.config import Settings
from . import learn, solve
from .signals import mean_reversion, momentum_engine, residuals

FEATURES = ["z_mom", "z_mr", "z_idvol", "z_beta", "tau"]
#: Rows that momentum needs, returns that a date needs, and training rows that a model needs.
WARM, LEAST, LEAST_TRAIN = 274, 60, 50


def period_end(day: Column, freq: str) -> Column:
    """The calendar label of a day's period: Friday of its week, or the last day of its month."""
    return F.next_day(F.date_sub(day, 1), "FRI") if freq.upper().startswith("W") else F.last_day(day)


def ordinals(rets: DataFrame) -> DataFrame:
    """(date, ord): one row a day, numbered from 1, so its window without key is small."""
    return rets.select("date").distinct().withColumn("ord", F.row_number().over(Window.orderBy("date")))


def rebalance_grid(rets: DataFrame, freq: str = "ME") -> DataFrame:
    """(date, next_date, k, asof, ord): labels of all periods from first to last return, empty ones too; asof is the last
    day of returns up to the label and ord its number. One row a period."""
    known = ordinals(rets).groupBy(period_end(F.col("date"), freq).alias("date")).agg(F.max("date").alias("asof"), F.max("ord").alias("ord"))
    span = known.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a is not null")
    if freq.upper().startswith("W"):
        labels = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("date"))
    else:
        labels = span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("date"))
    order = Window.orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return labels.join(known, "date", "left").select("date", F.lead("date").over(order).alias("next_date"), (F.row_number().over(order) - 1).alias("k"), F.last("asof", True).over(upto).alias("asof"), F.last("ord", True).over(upto).alias("ord"))


def next_returns(rets: DataFrame, grid: DataFrame, freq: str) -> DataFrame:
    """(date, ticker, next_ret): compounded return over (date, next_date]: periods are an equi-key, so no range join."""
    periods = rets.groupBy(period_end(F.col("date"), freq).alias("next_date"), "ticker").agg((F.product(1 + F.col("ret")) - 1).alias("next_ret"))
    return grid.select("date", "next_date").join(periods, "next_date").select("date", "ticker", "next_ret")


def at_grid(daily: DataFrame, grid: DataFrame, value: str, out: str) -> DataFrame:
    """The value of each grid date's last day of returns."""
    return F.broadcast(grid.select(F.col("date").alias("t"), F.col("asof").alias("date"))).join(daily, "date").select(F.col("t").alias("date"), "ticker", F.col(value).alias(out))


def window_betas(rets: DataFrame, market: DataFrame, grid: DataFrame, days: int) -> DataFrame:
    """(date, ticker, beta) over the calendar days in (date - days, date]; 0 under five returns or without variance."""
    within = grid.select(F.col("date").alias("t"), F.explode(F.sequence(F.date_sub("date", days - 1), "date")).alias("date"))
    j = rets.join(F.broadcast(market), "date").join(F.broadcast(within), "date")
    slope = F.covar_samp("ret", "mkt_ret") / F.nullif(F.var_samp("mkt_ret"), F.lit(0.0))
    return j.groupBy(F.col("t").alias("date"), "ticker").agg(F.when(F.count("*") >= 5, F.coalesce(slope, F.lit(0.0))).otherwise(0.0).alias("beta"))


def features(rets: DataFrame, market: DataFrame, grid: DataFrame, cfg: Settings) -> DataFrame:
    """(date, ticker, z_mom, z_mr, z_idvol, z_beta, tau) of all grid dates at once; missing parts are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    resid = residuals(rets, market, max(cfg.beta_lookback, 63))
    idvol = rets.select("date", "ticker", F.stddev_samp("ret").over(T().rowsBetween(-20, 0)).alias("idvol"))
    names = at_grid(rets, grid, "ret", "ret").drop("ret")
    f = names.join(at_grid(momentum_engine(rets), grid, "mom", "mom"), ["date", "ticker"], "left").join(at_grid(mean_reversion(resid, cfg.mr_lookback), grid, "score", "mr"), ["date", "ticker"], "left")
    f = f.join(at_grid(idvol, grid, "idvol", "idvol"), ["date", "ticker"], "left").join(window_betas(rets, market, grid, cfg.beta_lookback), ["date", "ticker"], "left")
    f = f.withColumns({c: zero(F.col(c)) for c in ("mom", "mr", "idvol", "beta")})
    for c in ("mom", "mr", "idvol", "beta"):
        f = z_samp(f, c, f"z_{c}")
    first = rets.agg(F.min("date").alias("first"))
    return f.crossJoin(F.broadcast(first)).withColumn("tau", F.datediff("date", "first") / 252.0).select("date", "ticker", *FEATURES)


def labelled(y: DataFrame, mode: str) -> DataFrame:
    """y(date, ticker, y) with y as it is (none), as percent rank less a half (rank), or by median and MAD, clipped (zmad)."""
    if mode == "rank":
        return y.withColumn("y", percent_rank("y") - 0.5)
    if mode == "zmad":
        y = y.withColumn("m", F.median("y").over(X()))
        y = y.withColumn("s", 1.4826 * (F.median(F.abs(F.col("y") - F.col("m"))).over(X()) + 1e-12))
        return y.withColumn("y", clip((F.col("y") - F.col("m")) / F.col("s"), 3.0)).drop("m", "s")
    if mode != "none":
        raise ValueError(f"unknown label mode {mode}")
    return y


def training_rows(feats: DataFrame, rets: DataFrame, grid: DataFrame, cfg: Settings) -> DataFrame:
    """(t, date, ticker, features, y): for each grid date t the rows of grid dates in [t - lookback, t) but the last of
    them, whose label would end at t; none if there are fewer than three such dates. Names are drawn by hash."""
    y = next_returns(rets, grid, cfg.rebalance_freq).withColumnRenamed("next_ret", "y").filter("y is not null")
    share = cfg.gp_per_date_name_frac
    if share is not None and 0 < share < 1:
        turn = F.row_number().over(X().orderBy(F.md5(F.concat_ws(" ", "date", "ticker"))))
        y = y.withColumn("turn", turn).withColumn("n", F.count("*").over(X())).filter(F.col("turn") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).drop("turn", "n")
    rows = feats.join(labelled(y, cfg.gp_label_mode), ["date", "ticker"])
    step = 7 if cfg.rebalance_freq.upper().startswith("W") else 28
    reach = cfg.gp_train_lookback_days // step + 1
    past = grid.select(F.col("date").alias("t"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("k") - reach), F.col("k"))).alias("k"), F.col("k").alias("own")).filter("k < own")
    past = past.join(grid.select("k", "date"), "k").filter(F.col("date") >= F.date_sub("t", cfg.gp_train_lookback_days))
    per = Window.partitionBy("t")
    used = past.withColumn("dates", F.count("*").over(per)).withColumn("last", F.max("k").over(per)).filter("dates >= 3 and k < last")
    return rows.join(F.broadcast(used.select("t", "date")), "date").select("t", "date", "ticker", *FEATURES, "y")


def model_scores(feats: DataFrame, train: DataFrame, cfg: Settings) -> DataFrame:
    """(date, ticker, mu): predictions over their spread, by the model last fitted; dates of few training rows have none."""
    counted = train.groupBy("t").count().filter(F.col("count") >= LEAST_TRAIN).select("t")
    turn = (F.row_number().over(Window.orderBy("t")) - 1) / max(1, cfg.gp_refit_every)
    fits = counted.withColumn("turn", F.floor(turn)).withColumn("fit", F.min("t").over(Window.partitionBy("turn"))).select("t", "fit")
    now = feats.join(F.broadcast(fits.withColumnRenamed("t", "date")), "date")
    then = train.join(F.broadcast(fits.select(F.col("fit").alias("t")).distinct()), "t")
    # new attributes, as both sides come from the same features
    then = then.select([F.col(c).alias(c) for c in then.columns])
    kind = np.float32 if cfg.gp_float32 else np.float64

    def run(rows, current):
        import pandas as pd

        if rows.empty or current.empty:
            return pd.DataFrame({"date": [], "ticker": [], "mu": []})
        rows = rows.sort_values(["date", "ticker"])
        y = rows.y.to_numpy()
        y = (y - y.mean()) / (y.std() + 1e-12)
        use = learn.balanced_rows(y, cfg.gp_max_train_points)
        x, y = rows[FEATURES].to_numpy(kind)[use].astype(float), y[use].astype(kind).astype(float)
        if cfg.gp_backend.lower() == "nystrom_krr":
            age = (pd.Timestamp(rows.t.iloc[0]) - pd.to_datetime(rows.date)).dt.days.to_numpy(float)[use]
            model = learn.Nystrom(x, y, age, cfg.ny_kernel, cfg.ny_components, cfg.ny_alpha, cfg.ny_gamma, cfg.ny_random_state, cfg.ny_time_half_life_days)
        else:
            model = learn.GaussianProcess(x, y, cfg.gp_alpha, cfg.gp_n_restarts)
        mean, spread = model.predict(current[FEATURES].to_numpy(kind).astype(float))
        if cfg.gp_uncertainty_sizing:
            mean = mean / np.sqrt(np.maximum(spread, cfg.gp_sigma_floor) ** 2 + 1e-12)
        return pd.DataFrame({"date": current.date, "ticker": current.ticker, "mu": mean})

    return then.groupBy("t").cogroup(now.groupBy("fit")).applyInPandas(run, "date date, ticker string, mu double")


def raw_alpha(rets: DataFrame, market: DataFrame, grid: DataFrame, cfg: Settings) -> DataFrame:
    """(date, ticker, mu) of the chosen signal at every grid date; a missing value is 0."""
    kind = cfg.signal_type.lower()
    names = at_grid(rets, grid, "ret", "ret").drop("ret")
    warm = grid.filter((F.col("ord") >= WARM) & (cfg.train_window_days >= WARM))
    momentum = at_grid(momentum_engine(rets), warm, "mom", "mu")

    def reversion(rows):
        return at_grid(mean_reversion(residuals(rets, market, cfg.mr_beta_lookback), rows), grid, "score", "mu")

    if kind == "mom_12_1":
        mu = momentum
    elif kind.startswith("mr"):
        rows = kind.split("_")[1] if "_" in kind else ""
        mu = reversion(int(rows) if rows.isdigit() else cfg.mr_lookback)
    elif kind == "combo_mom_mr":
        both = momentum.filter("mu is not null").join(reversion(cfg.mr_lookback).withColumnRenamed("mu", "mr"), ["date", "ticker"])
        mu = z_samp(z_samp(both, "mu", "a"), "mr", "b").select("date", "ticker", (F.col("a") + cfg.combo_mr_weight * F.col("b")).alias("mu"))
    elif kind in ("gp_xs", "gpflow_xs"):
        feats = features(rets, market, grid, cfg)
        scored = model_scores(feats, training_rows(feats, rets, grid, cfg), cfg)
        mu = momentum.join(scored.select("date").distinct(), "date", "left_anti").unionByName(scored)
    else:
        raise ValueError(f"unknown signal type {cfg.signal_type}")
    mu = names.join(mu, ["date", "ticker"], "left").withColumn("mu", F.coalesce("mu", F.lit(0.0)))
    if cfg.overlay_mr and kind == "mom_12_1":
        mu = disagreement(mu, reversion(cfg.mr_lookback).withColumnRenamed("mu", "mr"), cfg.overlay_weight, cfg.standardize_mu)
    return mu


def disagreement(mu: DataFrame, mr: DataFrame, weight: float, standardize: bool = True) -> DataFrame:
    """mu less up to weight of itself where the sign of mr differs, by the size of mr."""
    j = mu.join(mr, ["date", "ticker"], "left").withColumn("mr", F.coalesce("mr", F.lit(0.0)))
    j = z_samp(j, "mu", "mu") if standardize else j
    apart = F.when(F.signum("mu") != F.signum("mr"), F.least(F.abs("mr"), F.lit(1.0))).otherwise(0.0)
    j = j.withColumn("mu", F.col("mu") * (1 - weight * apart))
    return (z_samp(j, "mu", "mu") if standardize else j).select("date", "ticker", "mu")


def finalized(mu: DataFrame, sectors: DataFrame | None, cfg: Settings) -> DataFrame:
    """Sector means out if asked, then standardised and winsorised."""
    if cfg.sector_neutral_signal and sectors is not None:
        mu = demean_by_sector(mu.join(F.broadcast(sectors), "ticker", "left"), "mu", "mu")
    if cfg.standardize_mu:
        mu = z_samp(mu, "mu", "mu")
    return winsorize(mu, "mu", "mu", cfg.winsor_mu_k).select("date", "ticker", F.coalesce("mu", F.lit(0.0)).alias("mu"))


def market_state(px: DataFrame, grid: DataFrame, cfg: Settings) -> DataFrame:
    """(date, risk_off, melt_up) as of each grid date from market prices(date, px): averages crossed, and both returns high."""
    order = Window.orderBy("date")
    mean = lambda rows: F.avg("px").over(order.rowsBetween(1 - rows, 0))
    gain = lambda rows: F.col("px") / F.lag("px", rows).over(order) - 1
    daily = px.filter("px is not null").select("date", (mean(cfg.mkt_fast_win) > mean(cfg.mkt_slow_win)).alias("up"), ((gain(cfg.crash_fast_win) >= cfg.crash_fast_th) & (gain(cfg.crash_slow_win) >= cfg.crash_slow_th)).alias("melt"))
    last = daily.groupBy(period_end(F.col("date"), cfg.rebalance_freq).alias("date")).agg(F.max_by(F.struct("up", "melt"), "date").alias("s"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # periods of the market before and after those of the grid count too, so the as-of looks over their union
    both = grid.select("date", F.lit(True).alias("own")).join(last, "date", "full").withColumn("s", F.last("s", True).over(upto)).filter("own")
    return both.select("date", ~F.coalesce("s.up", F.lit(False)) & F.lit(cfg.market_filter), F.coalesce("s.melt", F.lit(False)) & F.lit(cfg.crash_protect)).toDF("date", "risk_off", "melt_up")


def alpha(rets: DataFrame, market: DataFrame, px: DataFrame, sectors: DataFrame | None, grid: DataFrame, cfg: Settings) -> DataFrame:
    """(date, ticker, mu) as the solver takes it."""
    state = F.broadcast(market_state(px, grid, cfg))
    mu = raw_alpha(rets, market, grid, cfg).join(state, "date", "left")
    mu = mu.withColumn("mu", F.when(F.col("risk_off"), F.col("mu") * cfg.risk_off_shrink).otherwise(F.col("mu"))).select("date", "ticker", "mu")
    mu = finalized(mu, sectors, cfg).join(state, "date", "left")
    return mu.select("date", "ticker", F.when(F.col("melt_up") & (F.col("mu") < 0), F.col("mu") * cfg.crash_shrink_neg).otherwise(F.col("mu")).alias("mu"))


# What a cooldown multiplies.
COOL = {"mu": 0.90, "bound": 0.90, "gross": 0.90, "aversion": 1.15, "step": 0.5, "port_change": 1.5, "buffer": 1.5, "budget": 0.8}


def factor(name: str, cool: bool) -> float:
    return COOL[name] if cool else 1.0


def is_cool(pnl: list[float], recent: int = 2, span: int = 4, loss: float = -0.002, fall: float = 0.10, near: float = 0.01) -> bool:
    """Whether the last periods lost, and equity stands well below its highest of the last span periods."""
    if len(pnl) < max(recent, span):
        return False
    equity = np.cumprod(np.concatenate([[1.0], 1 + np.array(pnl)]))[-(span + 1) :]
    down = 1 - equity[-1] / equity.max()
    last = np.array(pnl[-recent:])
    return bool((np.nansum(last) < loss or (last < 0).sum() >= 2) and down > fall and down > near)


def cooldowns(pnl: DataFrame, recent: int = 2, span: int = 4, loss: float = -0.002, fall: float = 0.10) -> DataFrame:
    """(period_end, sum_recent, losses, drawdown, cool) of pnl(period_end, pnl): is_cool() after each period, by windows.

    drawdown is from the highest of the last span + 1 points of equity, of which the first is 1 before the first period.
    """
    order = Window.orderBy("period_end")  # one row a period
    near, n = order.rowsBetween(1 - recent, 0), F.row_number().over(order)
    equity = pnl.withColumn("n", n).withColumn("equity", F.product(1 + F.col("pnl")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.greatest(F.max("equity").over(order.rowsBetween(-span, 0)), F.when(F.col("n") <= span, 1.0))
    out = equity.select("period_end", "n", F.sum("pnl").over(near).alias("sum_recent"), F.sum((F.col("pnl") < 0).cast("long")).over(near).alias("losses"), (1 - F.col("equity") / F.nullif(top, F.lit(0.0))).alias("drawdown"))
    cool = (F.col("n") >= max(recent, span)) & ((F.col("sum_recent") < loss) | (F.col("losses") >= 2)) & (F.col("drawdown") > fall)
    return out.select("period_end", "sum_recent", "losses", "drawdown", F.coalesce(cool, F.lit(False)).alias("cool"))


def ready_dates(rets: DataFrame, grid: DataFrame, rows: int, least: int = LEAST) -> DataFrame:
    """Grid dates whose training window of up to rows days holds enough returns."""
    return grid.filter(F.least("ord", F.lit(rows)) >= least)


def sector_constraints(names: DataFrame, unit: bool = False) -> DataFrame:
    """(date, row, ticker, coefficient) of names(date, ticker, sector): a sparse row of ones for each sector of two names or
    more, of unit length if asked; none for a date with fewer than two such sectors. A missing sector is Other."""
    named = names.withColumn("sector", F.coalesce("sector", F.lit("Other")))
    counts = named.groupBy("date", "sector").agg(F.count("*").alias("n")).filter("n >= 2")
    kept = counts.withColumn("rows", F.count("*").over(Window.partitionBy("date"))).filter("rows >= 2")
    size = 1 / F.sqrt("n") if unit else F.lit(1.0)
    return named.join(kept, ["date", "sector"]).select("date", F.col("sector").alias("row"), "ticker", size.alias("coefficient"))


def histories(rets: DataFrame, ready: DataFrame, rows: int) -> DataFrame:
    """(date, tickers, history) of grid dates: the last rows days of returns of all names, which reach each date by an
    equi-join on day numbers."""
    packed = F.sort_array(F.collect_list(F.struct("ticker", "ret")))
    wide = rets.groupBy("date").agg(packed.alias("r")).join(F.broadcast(ordinals(rets)), "date").select("ord", F.col("r.ret").alias("x"), F.col("r.ticker").alias("tickers"))
    used = ready.select("date", F.explode(F.sequence(F.greatest(F.lit(1), F.col("ord") - rows + 1), "ord")).alias("ord"))
    return used.join(wide, "ord").groupBy("date").agg(F.sort_array(F.collect_list(F.struct("ord", "x"))).alias("h"), F.max_by("tickers", "ord").alias("tickers")).select("date", "tickers", F.col("h.x").alias("history"))


def covariances(rets: DataFrame, grid: DataFrame, model: str, decay: float, rows: int) -> DataFrame:
    """(date, ticker_i, ticker_j, c): the risk model of each ready grid date, floored twice as the solver takes it."""

    def run(parts):
        import pandas as pd

        for part in parts:
            for p in part.itertuples(index=False):
                s = solve.covariance_of(np.array([list(r) for r in p.history], float), model, decay).dense()
                i, j = np.triu_indices(len(s))
                names = np.array(p.tickers, dtype=object)
                yield pd.DataFrame({"date": p.date, "ticker_i": names[i], "ticker_j": names[j], "c": s[i, j]})

    found = histories(rets, ready_dates(rets, grid, rows), rows)
    return found.repartition("date").mapInPandas(run, "date date, ticker_i string, ticker_j string, c double")


SOLVED = "date date, next_date date, k int, cool boolean, tickers array<string>, mu array<double>, next_ret array<double>, target array<double>, status string, residual double, first_residual double, base double, loads array<double>"


def solved(rets: DataFrame, market: DataFrame, px: DataFrame, sectors: DataFrame | None, cfg: Settings) -> DataFrame:
    """One row for each grid date with enough returns and each state of the cooldown: the solver's weights and its inputs.

    Each row is a problem of its own. The covariance goes on as axes, names times the lesser of names and days; a sector's
    constraint row comes with the names as its coefficients.
    """
    grid = rebalance_grid(rets, cfg.rebalance_freq)
    ready = ready_dates(rets, grid, cfg.train_window_days)
    history = histories(rets, ready, cfg.train_window_days).select("date", "history")
    names = alpha(rets, market, px, sectors, grid, cfg).join(window_betas(rets, market, grid, cfg.beta_lookback), ["date", "ticker"], "left").join(next_returns(rets, grid, cfg.rebalance_freq), ["date", "ticker"], "left")
    row, coefficient = F.lit(None).cast("string").alias("row"), F.lit(None).cast("double").alias("coefficient")
    if sectors is not None and cfg.sector_neutral and not cfg.long_only:
        own = names.select("date", "ticker").join(F.broadcast(sectors), "ticker", "left")
        names = names.join(sector_constraints(own, cfg.sector_neutral_tol is not None and cfg.sector_soft_row_norm), ["date", "ticker"], "left")
        row, coefficient = F.col("row"), F.col("coefficient")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    names = names.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("ticker", zero("mu"), zero("beta"), zero("next_ret"), row, coefficient))).alias("names"))
    problems = ready.select("date", "next_date", "k").join(names, "date").join(history, "date").withColumn("cool", F.explode(F.array(F.lit(False), F.lit(True))))

    def run(parts):
        import pandas as pd

        for part in parts:
            out = []
            for p in part.itertuples(index=False):
                mu, beta, ret = (np.array([n[c] for n in p.names], float) for c in ("mu", "beta", "next_ret"))
                sigma = solve.covariance_of(np.array([list(r) for r in p.history], float), cfg.risk_model, cfg.ewma_lambda)
                labels = [n["row"] for n in p.names]
                rows = [np.array([n["coefficient"] if n["row"] == label else 0.0 for n in p.names]) for label in sorted(set(labels) - {None})]
                w, status, off, first = solve_one(mu * factor("mu", p.cool), sigma, beta, rows, cfg, p.cool)
                loads = (None, None) if p.cool else (sigma.base, sigma.rows().ravel())
                out.append((p.date, p.next_date, p.k, p.cool, [n["ticker"] for n in p.names], mu, ret, w, status, off, first, *loads))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SOLVED.split(", ")])

    return problems.repartition("date", "cool").mapInPandas(run, SOLVED)


def solve_one(mu, sigma, beta, rows, cfg: Settings, cool: bool):
    hard, soft = [], []
    for on, made, cap in (
        (cfg.sector_neutral, lambda: rows, cfg.sector_neutral_tol),
        (cfg.pca_neutralize and cfg.pca_k > 0, lambda: solve.principal_rows(sigma, cfg.pca_k, cfg.pca_equalize_risk), cfg.pca_neutral_tol),
    ):
        for row in made() if on and not cfg.long_only else []:
            hard.append(row) if cap is None else soft.append((row, cap))
    budget = None if cfg.risk_budget_annual is None else cfg.risk_budget_annual * factor("budget", cool) / np.sqrt(252.0)
    gross = None if cfg.gross_limit is None else cfg.gross_limit * factor("gross", cool)
    return solve.cascade(
        mu, sigma, beta if cfg.beta_neutralize else None, cfg.risk_aversion * factor("aversion", cool), cfg.position_bound * factor("bound", cool), gross, cfg.beta_limit, 1500,
        neutral=cfg.dollar_neutral, long_only=cfg.long_only, budget=budget, hard=hard, soft=soft,
    )


TRADED = "variant string, date date, next_date date, cool boolean, failed boolean, status string, residual double, first_residual double, executed boolean, turnover double, cost double, pnl double, tickers array<string>, weights array<double>"
#: The largest violation of a solve that counts; if both solvers leave more, the weights before stay.
FAILED = solve.FAILED


def traded(solutions: DataFrame, variants: dict[str, Settings]) -> DataFrame:
    """One row a variant and date: what was decided, its cost, the profit to the next date and the weights held.

    The fold needs the weights before, so a variant's dates run in order in one task; they stream through it batch by
    batch, sorted, and only the last weights and the profits so far are kept.
    """

    def run(parts):
        import pandas as pd

        name, w, pnl, plain = None, {}, [], None
        for part in parts:
            out = []
            for p in part.itertuples(index=False):
                if p.variant != name:
                    name, w, pnl, plain = p.variant, {}, [], None
                if not p.cool:
                    plain = p
                    continue
                cfg, cool = variants[name], is_cool(pnl)
                chosen = p if cool else plain
                tickers, n = list(p.tickers), len(p.tickers)
                before, loads = np.array([w.get(t, 0.0) for t in tickers]), np.array(plain.loads, float).reshape(-1, n)
                variance = lambda v: plain.base * (v @ v) + ((loads @ v) ** 2).sum()  # noqa: E731, B023
                mu, failed = np.array(p.mu, float) * factor("mu", cool), chosen.status == "failed"
                target = before.copy() if failed else np.array(chosen.target, float)
                new, turnover, cost, executed = trade(target, before, mu, variance, cfg, cool, first=p.k == 0)
                gain = None
                if p.next_date is not None and not pd.isna(p.next_date):
                    gain = float(new @ np.array(p.next_ret, float)) - cost
                    pnl.append(gain)
                w = dict(zip(tickers, new))
                out.append((name, p.date, p.next_date, cool, failed, chosen.status, chosen.residual, chosen.first_residual, executed, turnover, cost, gain, tickers, new))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRADED.split(", ")])

    return solutions.repartition("variant").sortWithinPartitions("variant", "k", "cool").mapInPandas(run, TRADED)


def trade(target, before, mu, variance, cfg: Settings, cool: bool, first: bool):
    """(weights, proposed turnover, cost, executed): volatility target, the gates of names, book and utility, then a step.

    variance gives the variance of weights.
    """
    if cfg.vol_target_ex_ante and cfg.risk_budget_annual is not None:
        wanted = cfg.risk_budget_annual * factor("budget", cool) / np.sqrt(252.0)
        target = target * np.clip(wanted / np.sqrt(max(1e-12, variance(target))), *cfg.vol_scale_bounds)
    proposed = np.where(np.abs(target - before) < cfg.min_name_change, before, target)
    turnover, rate = float(np.abs(proposed - before).sum()), cfg.transaction_cost_bps / 1e4
    utility = lambda v: mu @ v - cfg.risk_aversion * variance(v)
    worth = utility(proposed) - utility(before) > cfg.benefit_cost_buffer * factor("buffer", cool) * rate * turnover
    if not (first or (turnover >= cfg.min_port_change * factor("port_change", cool) and worth)):
        return before, turnover, 0.0, False
    step = cfg.step_fraction * factor("step", cool) * (proposed - before)
    return before + step, turnover, rate * float(np.abs(step).sum()), True


def backtest(rets: DataFrame, market: DataFrame, px: DataFrame, sectors: DataFrame | None, variants: dict[str, Settings]) -> DataFrame:
    """All variants in one job: their problems side by side, then one fold a variant."""
    every = None
    for name, cfg in variants.items():
        own = solved(rets, market, px, sectors, cfg).select(F.lit(name).alias("variant"), "*")
        every = own if every is None else every.unionByName(own)
    return traded(every, variants)


def book(run: DataFrame) -> DataFrame:
    """(variant, date, ticker, weight) of a run."""
    return run.select("variant", "date", F.explode(F.arrays_zip("tickers", "weights")).alias("z")).select("variant", "date", F.col("z.tickers").alias("ticker"), F.col("z.weights").alias("weight"))


def riskfree_periods(daily: DataFrame, ends: DataFrame) -> DataFrame:
    """(period_end, rf) of daily(date, rf_ret) at ends(period_end): growth as of each end over the one before; the first is 0."""
    order = Window.orderBy("day", "last")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.select(F.col("date").alias("day"), F.lit(0).alias("last"), F.product(1 + F.col("rf_ret")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    both = grown.unionByName(ends.select(F.col("period_end").alias("day"), F.lit(1).alias("last"), F.lit(None).cast("double").alias("c"))).withColumn("c", F.last("c", True).over(upto))
    by_end = Window.orderBy("day")
    return both.filter("last = 1").select(F.col("day").alias("period_end"), F.coalesce(F.col("c") / F.nullif(F.lag("c").over(by_end), F.lit(0.0)) - 1, F.lit(0.0)).alias("rf"))


def summary(run: DataFrame, rf_daily: DataFrame, variants: dict[str, Settings]) -> DataFrame:
    """One row a variant: performance of its profits, raw and (excess_) over the risk-free rate of its periods."""
    from .metrics import performance, turnover

    rows = None
    for name, cfg in variants.items():
        own = run.filter(F.col("variant") == name)
        pnl = own.filter("pnl is not null").select(F.col("next_date").alias("period_end"), "pnl")
        turn = turnover(book(own))
        raw = performance(pnl, turn, cfg.ann_factor)
        over = pnl.join(riskfree_periods(rf_daily, pnl.select("period_end")), "period_end").select("period_end", (F.col("pnl") - F.col("rf")).alias("pnl"))
        excess = performance(over, turn, cfg.ann_factor)
        one = raw.select(F.lit(name).alias("label"), "*").crossJoin(excess.select([F.col(c).alias(f"excess_{c}") for c in excess.columns]))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def curves(run: DataFrame) -> DataFrame:
    """(variant, date, nav): equity of each variant on the union of all dates, carried forward, 1 at its first known one."""
    from .reports import aligned

    upto = Window.partitionBy("variant").orderBy("next_date").rowsBetween(Window.unboundedPreceding, 0)
    own = run.filter("pnl is not null").select(F.col("variant").alias("name"), F.col("next_date").alias("date"), F.product(1 + F.col("pnl")).over(upto).alias("value"))
    return aligned(own, back=False).toDF("variant", "date", "nav")


def invariants(run: DataFrame, rets: DataFrame, cfg: Settings) -> DataFrame:
    """One row for each date of a one-variant run: whether what must hold of its decision holds.

    profit_holds: the profit is the weights' return over the next period less the cost, or absent at the last date;
    cost_holds: the cost is the rate times the weights' change; still_holds: weights that weren't traded are those before;
    solve_holds: a solve that isn't called failed leaves no larger violation than it may.
    """
    held = book(run).select("date", "ticker", "weight")
    before = F.coalesce(F.lag("weight").over(Window.partitionBy("ticker").orderBy("date")), F.lit(0.0))
    nxt = next_returns(rets, rebalance_grid(rets, cfg.rebalance_freq), cfg.rebalance_freq)
    sums = held.withColumn("before", before).join(nxt, ["date", "ticker"], "left").groupBy("date").agg(
        F.sum(F.col("weight") * F.coalesce("next_ret", F.lit(0.0))).alias("gain"), F.sum(F.abs(F.col("weight") - F.col("before"))).alias("change")
    )
    j = run.join(sums, "date")
    near = lambda a, b: F.abs(a - b) < 1e-9
    profit = F.when(F.col("next_date").isNull(), F.col("pnl").isNull()).otherwise(near(F.col("pnl"), F.col("gain") - F.col("cost")))
    return j.select(
        "date", F.coalesce(profit, F.lit(False)).alias("profit_holds"), near(F.col("cost"), F.col("change") * cfg.transaction_cost_bps / 1e4).alias("cost_holds"),
        (F.col("executed") | near(F.col("change"), F.lit(0.0))).alias("still_holds"), (F.col("failed") == (F.col("residual") > FAILED)).alias("solve_holds"),
    )
