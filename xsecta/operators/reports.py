"""Parameter grids, cost sweeps, exposures over time, kernel covariances and the tables behind plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import X
from .gram import pair_sums
from .metrics import decile_long_short, ic_summary, information_coefficient
from .signals import ahead, blend, mean_reversion, momentum_signal


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def momentum_grid(prices: DataFrame, fwd: DataFrame, gaps=(10, 21, 30), lookbacks=(126, 189, 252), top: float = 0.9) -> DataFrame:
    """IC summary of each gap and lookback: branches over one panel, which Spark reads once by reusing its exchanges."""
    cells = [(g, n, information_coefficient(momentum_signal(prices, g, n), fwd)) for g in gaps for n in lookbacks]
    return union([ic_summary(ic).select(F.lit(g).alias("gap"), F.lit(n).alias("lookback"), "*") for g, n, ic in cells])


def reversion_grid(resid: DataFrame, rets: DataFrame, lookbacks=(3, 5, 10), horizons=(1, 3, 5)) -> DataFrame:
    cells = [(n, h, information_coefficient(mean_reversion(resid, n), ahead(rets, h))) for n in lookbacks for h in horizons]
    return union([ic_summary(ic).select(F.lit(n).alias("mr_lookback"), F.lit(h).alias("fwd_days"), "*") for n, h, ic in cells])


def blend_grid(momentum: DataFrame, reversion: DataFrame, fwd: DataFrame, weights=(0.0, 0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    cells = [(w, information_coefficient(blend(momentum, reversion, w), fwd)) for w in weights]
    return union([ic_summary(ic).select(F.lit(float(w)).alias("mr_weight"), "ic_ir_ann") for w, ic in cells])


def best(grid: DataFrame, by=("ic_ir_ann", "ic_mean"), rows: int = 1) -> DataFrame:
    return grid.orderBy(*[F.desc(c) for c in by]).limit(rows)


def repriced(pnl: DataFrame, turn: DataFrame, now: float = 5.0, tests=(0.0, 5.0, 10.0, 20.0), factor: float = 12.0) -> DataFrame:
    """Statistics of pnl(period_end, pnl) with the present cost added back and each test's taken; turn(period_end, turnover)."""
    bps = F.explode(F.array(*[F.lit(float(b)) for b in tests]))
    j = pnl.join(turn, "period_end", "left").withColumn("bps", bps)
    j = j.withColumn("p", F.col("pnl") + (now - F.col("bps")) * 1e-4 * F.coalesce("turnover", F.lit(0.0)))
    mean, sd = F.avg("p") * factor, F.stddev_samp("p") * F.sqrt(F.lit(factor))
    return j.groupBy("bps").agg(mean.alias("ann_return"), sd.alias("ann_vol"), F.coalesce(mean / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("sharpe"))


def binding_summary(binding: DataFrame) -> DataFrame:
    """(constraint, bind_pct): mean of each numeric column in per cent; its file is sorted downwards by share."""
    names = [c for c in binding.columns if c != "date"]
    means = binding.agg(*[(F.avg(c) * 100).alias(c) for c in names])
    return means.unpivot([], names, "constraint", "bind_pct")


def exposure(weights: DataFrame, loads: DataFrame, load: str = "beta", inner: bool = False) -> DataFrame:
    """(date, exposure): sum of weight times load(ticker[, date]) of each date, unknown loads as 0; inner leaves out what
    the one or the other lacks, as two aligned tables do."""
    on = ["date", "ticker"] if "date" in loads.columns else ["ticker"]
    return weights.join(loads, on, "inner" if inner else "left").groupBy("date").agg(F.sum(F.col("weight") * F.coalesce(load, F.lit(0.0))).alias("exposure"))


def alignment(signal: DataFrame, weights: DataFrame, method: str = "spearman") -> DataFrame:
    """Correlation of signal and weight of each date."""
    return information_coefficient(signal, weights.withColumnRenamed("weight", "fwd_ret"), method)


def realized_vol(pnl: DataFrame, rows: int = 12, factor: float = 12.0) -> DataFrame:
    w = Window.orderBy("period_end").rowsBetween(1 - rows, 0)
    return pnl.select("period_end", F.when(F.count("pnl").over(w) >= rows, F.stddev_samp("pnl").over(w) * F.sqrt(F.lit(factor))).alias("vol"))


def neutral_to_beta(mu: DataFrame, betas: DataFrame) -> DataFrame:
    """mu less its cross-sectional fit on beta; mu itself, missing as 0, where under two names or no variance is known."""
    j = mu.join(betas, "ticker", "left")
    known = F.when(F.col("beta").isNotNull(), F.col("mu"))
    b = F.when(F.col("mu").isNotNull(), F.col("beta"))
    slope = F.covar_pop(known, b).over(X()) / F.nullif(F.var_pop(b).over(X()), F.lit(0.0))
    level = F.avg(known).over(X()) - slope * F.avg(b).over(X())
    left = F.when(F.count(F.when(known.isNotNull(), b)).over(X()) >= 2, F.col("mu") - level - slope * F.col("beta"))
    return j.select("date", "ticker", F.coalesce(left, F.col("mu"), F.lit(0.0)).alias("mu"))


def time_kernel(age: Column, kind: str = "matern32", scale: float = 32.0) -> Column:
    """Weight of an observation age rows before the last one, not normalised."""
    x = age / max(1e-6, scale)
    r3, r5 = 3.0**0.5 * x, 5.0**0.5 * x
    known = {
        "rbf": lambda: F.exp(-x * x / 2),
        "exp": lambda: F.exp(-x),
        "matern32": lambda: (1 + r3) * F.exp(-r3),
        "matern52": lambda: (1 + r5 + r5 * r5 / 3) * F.exp(-r5),
    }
    kind = {"m32": "matern32", "m52": "matern52"}.get(kind.lower(), kind.lower())
    if kind not in known:
        raise ValueError(f"unknown kernel {kind}")
    return known[kind]()


def kernel_weights(rets: DataFrame, kind: str = "matern32", scale: float = 32.0) -> DataFrame:
    """(date, w): normalised weights of all dates, highest at the last; one row a day."""
    age = F.row_number().over(Window.orderBy(F.desc("date"))) - 1
    w = rets.select("date").distinct().withColumn("w", time_kernel(age, kind, scale))
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))


def kernel_covariance(rets: DataFrame, kind: str = "matern32", scale: float = 32.0, zero_mean: bool = True, shrink: float | None = None) -> DataFrame:
    """Covariance weighed by kernel_weights in coordinate form, around zero or the weighted mean, with some of its mean
    variance blended into the diagonal if asked."""
    r = rets.join(F.broadcast(kernel_weights(rets, kind, scale)), "date")
    if not zero_mean:
        r = r.withColumn("ret", F.col("ret") - F.sum(F.col("w") * F.col("ret")).over(Window.partitionBy("ticker")))
    c = pair_sums(r, "ret", "w").select("ticker_i", "ticker_j", F.col("sij").alias("c"))
    return c if not shrink else blended(c, F.lit(float(shrink)))


def blended(cov: DataFrame, share: Column) -> DataFrame:
    """(1 - share) of cov plus share of its mean variance times the identity."""
    own = F.col("ticker_i") == F.col("ticker_j")
    mean = cov.filter(own).agg(F.avg("c").alias("v"))
    return cov.crossJoin(F.broadcast(mean)).select("ticker_i", "ticker_j", ((1 - share) * F.col("c") + F.when(own, share * F.col("v")).otherwise(0.0)).alias("c"))


def plug_in_shrinkage(cov: DataFrame) -> DataFrame:
    """cov blended with its scaled identity F by |S - F|^2 / |S - mean S|^2, at most 1: sums over the lower half, twice."""
    own = F.col("ticker_i") == F.col("ticker_j")
    times = F.when(own, 1.0).otherwise(2.0)
    means = cov.agg(F.avg(F.when(own, F.col("c"))).alias("v"), (F.sum(times * F.col("c")) / F.sum(times)).alias("m"))
    j = cov.crossJoin(F.broadcast(means))
    off = F.col("c") - F.when(own, F.col("v")).otherwise(0.0)
    share = j.agg(F.least(F.lit(1.0), F.sum(times * off * off) / (F.sum(times * F.pow(F.col("c") - F.col("m"), 2)) + 1e-12)).alias("share"))
    return blended(cov.crossJoin(F.broadcast(share)), F.col("share"))


def ex_ante_vol(weights: DataFrame, rets: DataFrame, rows: int = 252, factor: float = 252.0) -> DataFrame:
    """(date, vol): root of w' S w a year, S the sample covariance of the rows returns up to the last but one at each date.

    w' S w is the variance of the held weights' past returns, so one sum a date and day stands for all pairs of names.
    """
    days = rets.select("date").distinct().withColumn("ord", F.row_number().over(Window.orderBy("date")))
    marks = weights.select("date").distinct().withColumnRenamed("date", "t").join(days, F.col("date") <= F.col("t")).groupBy("t").agg((F.max("ord") - 1).alias("last"))
    used = marks.select("t", F.explode(F.sequence(F.greatest(F.lit(1), F.col("last") - rows + 1), F.greatest(F.lit(1), "last"))).alias("ord")).join(days, "ord").select("t", "date")
    past = rets.join(F.broadcast(used), "date").join(F.broadcast(weights.select(F.col("date").alias("t"), "ticker", "weight")), ["t", "ticker"])
    held = past.groupBy("t", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    return held.groupBy(F.col("t").alias("date")).agg(F.when(F.count("*") >= max(21, rows // 6), F.stddev_samp("r") * F.sqrt(F.lit(factor))).alias("vol"))


def normalised(curve: DataFrame, x: str, by: str, key: list[str] | None = None) -> DataFrame:
    """x over its first known value."""
    w = Window.partitionBy(*(key or [])).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(x, True).over(w)
    return curve.withColumn(x, F.col(x) / F.coalesce(F.nullif(first, F.lit(0.0)), F.lit(1.0)))


def histogram(df: DataFrame, x: str, bins: int = 40) -> DataFrame:
    """(bin, n): counts of equal-width bins from least to largest x, the largest in the last bin; empty bins have no row."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.least(F.lit(bins), F.floor((F.col(x) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins) + 1)
    return df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, row: str, col: str, value: str, columns: list) -> DataFrame:
    return df.groupBy(row).pivot(col, columns).agg(F.avg(value))


def decile_grid(prices: DataFrame, fwd: DataFrame, gaps=(10, 21, 30), lookbacks=(126, 189, 252)) -> DataFrame:
    """Long-short returns of each gap and lookback."""
    return union([decile_long_short(momentum_signal(prices, g, n), fwd).select(F.lit(g).alias("gap"), F.lit(n).alias("lookback"), "*") for g in gaps for n in lookbacks])


def last_of_period(signal: DataFrame, label: Column) -> DataFrame:
    """(period_end, ticker, score): the last known score of each period."""
    return signal.groupBy(label.alias("period_end"), "ticker").agg(F.max_by("score", F.when(F.col("score").isNotNull(), F.col("date"))).alias("score"))


def panel_periods(daily: DataFrame, ends: DataFrame) -> DataFrame:
    """(period_end, ticker, ret) of daily(date, ticker, ret) at ends(period_end): growth as of each end over the one before;
    0 at the first end and before a name's first return."""
    by = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.select("ticker", "date", F.lit(0).alias("last"), F.product(1 + F.col("ret")).over(by).alias("c"))
    marks = daily.select("ticker").distinct().crossJoin(F.broadcast(ends.select(F.col("period_end").alias("date")).distinct()))
    marks = marks.select("ticker", "date", F.lit(1).alias("last"), F.lit(None).cast("double").alias("c"))
    upto = Window.partitionBy("ticker").orderBy("date", "last").rowsBetween(Window.unboundedPreceding, 0)
    held = grown.unionByName(marks).withColumn("c", F.last("c", True).over(upto)).filter("last = 1")
    before = F.lag("c").over(Window.partitionBy("ticker").orderBy("date"))
    return held.select(F.col("date").alias("period_end"), "ticker", F.coalesce(F.col("c") / F.nullif(before, F.lit(0.0)) - 1, F.lit(0.0)).alias("ret"))


def period_betas(rets: DataFrame, market: DataFrame, ends: DataFrame, rows: int) -> DataFrame:
    """(date, ticker, beta) at ends(period_end): rolling betas on the calendar of a portfolio's periods.

    Returns of names and market between the ends are compounded first; the beta of the last rows periods is the mean product
    less the product of means over the market's sample variance, and missing where fewer are known.
    """
    names = panel_periods(rets, ends)
    whole = panel_periods(market.select("date", F.lit("market").alias("ticker"), F.col("mkt_ret").alias("ret")), ends)
    j = names.join(F.broadcast(whole.select("period_end", F.col("ret").alias("mkt_ret"))), "period_end")
    w = Window.partitionBy("ticker").orderBy("period_end").rowsBetween(1 - rows, 0)
    cov = F.avg(F.col("ret") * F.col("mkt_ret")).over(w) - F.avg("ret").over(w) * F.avg("mkt_ret").over(w)
    beta = F.when(F.count("*").over(w) >= rows, cov / F.nullif(F.var_samp("mkt_ret").over(w), F.lit(0.0)))
    return j.select(F.col("period_end").alias("date"), "ticker", beta.alias("beta"))


def period_lookback(periods: int, annual: int) -> int:
    """Rows of rolling betas for a run of so many periods."""
    return max(6, min(annual, periods))


def to_growth(rets: DataFrame) -> DataFrame:
    """(date, growth) of rets(date, ret): compounded from the first date."""
    return rets.select("date", F.product(1 + F.col("ret")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("growth"))


def aligned(curves: DataFrame, back: bool = True) -> DataFrame:
    """(name, date, value) of curves(name, date, value) on the union of all their dates, 1 at each one's first known value.

    Values are carried forward, and the first one backward if asked. Dates and names meet as two short lists, and each
    curve is filled by itself.
    """
    every = curves.select("date").distinct().crossJoin(F.broadcast(curves.select("name").distinct()))
    order = Window.partitionBy("name").orderBy("date")
    first = F.first("value", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = F.last("value", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    value = (F.coalesce(carried, first) if back else carried) / F.coalesce(F.nullif(first, F.lit(0.0)), F.lit(1.0))
    return every.join(curves, ["name", "date"], "left").select("name", "date", value.alias("value"))


def monthly_exposure(exposure: DataFrame) -> DataFrame:
    """(month, sector, exposure): means by month, as a heatmap shows them."""
    return exposure.groupBy(F.date_format("date", "yyyy-MM").alias("month"), "sector").agg(F.avg("exposure").alias("exposure"))


def to_equity(series: DataFrame, x: str, by: str) -> DataFrame:
    """series with x as equity: compounded if its values look like returns, as it is if they are an equity or a drawdown.

    They look like returns if some are positive, the 5 and 95 % quantiles are within half of 0 and the mean within 0.2; a
    missing return is 0.
    """
    s = series.agg(F.max(x).alias("top"), F.percentile(x, F.lit(0.05)).alias("low"), F.percentile(x, F.lit(0.95)).alias("high"), F.avg(x).alias("mean")).first()
    if s.top is None or s.top <= 1e-12 or not (s.high < 0.5 and s.low > -0.5 and abs(s.mean) < 0.2):
        return series
    return series.withColumn(x, F.product(1 + F.coalesce(F.col(x), F.lit(0.0))).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
