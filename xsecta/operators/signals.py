"""Returns, residuals, momentum, mean reversion and blends on long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import T, X, clip, demean_by_sector, robust_z, rolling, z_pop


def returns(prices: DataFrame) -> DataFrame:
    """Simple returns of all tickers on dates where every ticker has one. Densified first, so a gap costs the date."""
    tickers = prices.select("ticker").distinct()
    grid = prices.select("date").distinct().crossJoin(F.broadcast(tickers))
    dense = grid.join(prices, ["date", "ticker"], "left")
    r = dense.select("date", "ticker", F.try_divide("close", F.lag("close").over(T())).alias("q")).withColumn("ret", F.col("q") - 1)
    whole = r.withColumn("known", F.count("ret").over(X())).withColumn("all", F.count(F.lit(1)).over(X()))
    return whole.filter("known = all").select("date", "ticker", "ret")


def forward_returns(prices: DataFrame) -> DataFrame:
    """Next row's return, of prices carried forward."""
    filled = prices.withColumn("px", F.last("close", True).over(T().rowsBetween(Window.unboundedPreceding, 0)))
    r = filled.withColumn("ret", F.try_divide(F.col("px"), F.lag("px").over(T())) - 1)
    return r.select("date", "ticker", F.lead("ret", 1).over(T()).alias("fwd_ret"))


def ahead(rets: DataFrame, horizon: int) -> DataFrame:
    """The single-day return horizon rows ahead."""
    return rets.select("date", "ticker", F.lead("ret", horizon).over(T()).alias("fwd_ret"))


def trailing_mean(rets: DataFrame, rows: int = 21) -> DataFrame:
    t = rets.withColumn("m", rolling(F.col("ret"), F.avg, rows, rows))
    return t.groupBy("ticker").agg(F.max_by("m", "date").alias("mean_ret"))


def momentum_engine(rets: DataFrame, gap: int = 21, rows: int = 252) -> DataFrame:
    """Product of rows returns, gap rows ago."""
    p = rets.withColumn("p", rolling(1 + F.col("ret"), F.product, rows, rows) - 1)
    return p.select("date", "ticker", F.lag("p", gap).over(T()).alias("mom"))


def momentum_ratio(prices: DataFrame, gap: int = 21, rows: int = 252) -> DataFrame:
    return prices.select("date", "ticker", (F.lag("close", gap).over(T()) / F.nullif(F.lag("close", rows).over(T()), F.lit(0.0)) - 1).alias("mom"))


def momentum_signal(prices: DataFrame, gap: int = 21, rows: int = 252, sectors: DataFrame | None = None, robust: bool = True, k: float = 3.0) -> DataFrame:
    m = momentum_ratio(prices, gap, rows)
    if sectors is not None:
        m = demean_by_sector(m.join(F.broadcast(sectors), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Other"))), "mom", "mom", 3)
    if robust:
        return robust_z(m, "mom", "score", k).select("date", "ticker", "score")
    return z_pop(m, "mom", "z").select("date", "ticker", clip(F.col("z"), k).alias("score"))


def residuals(rets: DataFrame, market: DataFrame, rows: int = 252) -> DataFrame:
    """Returns less rolling beta times the market's: population covariance over sample variance, 0 while unknown."""
    j = rets.join(F.broadcast(market), "date")
    w, least = T().rowsBetween(-(rows - 1), 0), max(5, rows // 5)
    beta = F.when(F.count("ret").over(w) >= least, F.covar_pop("ret", "mkt_ret").over(w) / F.nullif(F.var_samp("mkt_ret").over(w), F.lit(0.0)))
    return j.withColumn("beta", F.coalesce(beta, F.lit(0.0))).select("date", "ticker", (F.col("ret") - F.col("beta") * F.col("mkt_ret")).alias("resid"))


def rolling_betas(rets: DataFrame, market: DataFrame, rows: int = 252) -> DataFrame:
    """As in residuals, but only over full windows, and missing else."""
    j = rets.join(F.broadcast(market), "date")
    w = T().rowsBetween(-(rows - 1), 0)
    return j.select("date", "ticker", F.when(F.count("ret").over(w) >= rows, F.covar_pop("ret", "mkt_ret").over(w) / F.nullif(F.var_samp("mkt_ret").over(w), F.lit(0.0))).alias("beta"))


def mean_reversion(resid: DataFrame, rows: int = 5, vol_rows: int = 60, k: float = 3.0) -> DataFrame:
    vol = rolling(F.col("resid"), F.stddev_samp, vol_rows, max(5, vol_rows // 5))
    v = resid.withColumn("v", F.col("resid") / F.nullif(vol, F.lit(0.0)))
    raw = v.withColumn("raw", -rolling(F.col("v"), F.sum, rows, max(2, rows // 2)))
    return robust_z(raw, "raw", "score", k).select("date", "ticker", "score")


def blend(primary: DataFrame, secondary: DataFrame, weight: float = 0.3, k: float = 3.0) -> DataFrame:
    """z(primary) + weight * z(secondary), standardised again and clipped; 0 where either is missing."""
    both = primary.select("date", "ticker", F.col("score").alias("p")).join(secondary.select("date", "ticker", F.col("score").alias("s")), ["date", "ticker"])
    b = z_pop(z_pop(both, "p", "zp"), "s", "zs").withColumn("b", F.col("zp") + weight * F.col("zs"))
    b = z_pop(b, "b", "zb").select("date", "ticker", clip(F.col("zb"), k).alias("score"))
    return primary.select("date", "ticker").join(b, ["date", "ticker"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def reversion_from_prices(prices: DataFrame, market: DataFrame | None = None, rows: int = 3, vol_rows: int = 60, beta_rows: int = 252) -> DataFrame:
    """(date, ticker, score): mean reversion of returns, less their market part if market(date, mkt_ret) is given, on all
    dates of prices; 0 where there is none."""
    rets = returns(prices)
    resid = rets.select("date", "ticker", F.col("ret").alias("resid")) if market is None else residuals(rets, market, beta_rows)
    scores = mean_reversion(resid, rows, vol_rows)
    return prices.select("date", "ticker").join(scores, ["date", "ticker"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def overlay(alpha: DataFrame, reversion: DataFrame, weight: float = 0.1) -> DataFrame:
    """(1 - weight) * alpha + weight * reversion on the dates and names of alpha(date, ticker, score); missing ones are 0."""
    both = alpha.select("date", "ticker", "score").join(reversion.select("date", "ticker", F.col("score").alias("other")), ["date", "ticker"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("date", "ticker", ((1 - weight) * zero("score") + weight * zero("other")).alias("score"))
