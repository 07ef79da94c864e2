"""Information coefficients, deciles, performance, exposures, betas and covariances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import average_rank, percent_rank
from .gram import covariance, pair_sums  # noqa: F401


def corr(x, y):
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def information_coefficient(signal: DataFrame, fwd: DataFrame, method: str = "spearman") -> DataFrame:
    both = signal.join(fwd, ["date", "ticker"]).filter("score is not null and fwd_ret is not null")
    if method == "spearman":
        both = both.withColumn("x", average_rank("score")).withColumn("y", average_rank("fwd_ret"))
    else:
        both = both.withColumnsRenamed({"score": "x", "fwd_ret": "y"})
    return both.groupBy("date").agg(F.when(F.count("*") >= 3, corr("x", "y")).alias("ic")).filter("ic is not null")


def ic_summary(ic: DataFrame, factor: float = 252.0, count: str = "n_days") -> DataFrame:
    sd = F.stddev_samp("ic")
    # ranks often correlate by exactly 0, whose sign after rounding is chance
    return ic.agg(
        F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), F.coalesce(F.avg("ic") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(factor)), F.lit(0.0)).alias("ic_ir_ann"),
        (F.avg((F.round("ic", 9) > 0).cast("double")) * 100).alias("hit_rate_pct"), F.count("*").alias(count),
    )


def decile_long_short(signal: DataFrame, fwd: DataFrame, top: float = 0.9, bottom: float = 0.1, least: int = 20) -> DataFrame:
    both = signal.join(fwd, ["date", "ticker"]).filter("score is not null and fwd_ret is not null").withColumn("q", percent_rank("score"))
    long, short = F.avg(F.when(F.col("q") >= top, F.col("fwd_ret"))), F.avg(F.when(F.col("q") <= bottom, F.col("fwd_ret")))
    return both.groupBy("date").agg(F.when(F.count("*") >= least, long - short).alias("ls_ret")).filter("ls_ret is not null")


def return_stats(daily: DataFrame, x: str, factor: float = 252.0) -> DataFrame:
    mean, sd = F.avg(x) * factor, F.stddev_samp(x) * F.sqrt(F.lit(factor))
    return daily.agg(mean.alias("ann_ret"), sd.alias("ann_vol"), F.coalesce(mean / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("sharpe"), F.count(x).alias("n_days"))


def period_returns(rets: DataFrame) -> DataFrame:
    """Compounded monthly return of each ticker: months are an equi-key, so no range join."""
    return rets.groupBy(F.last_day("date").alias("period_end"), "ticker").agg((F.product(1 + F.col("ret")) - 1).alias("period_ret"))


def score_weights(signal: DataFrame, gross: float = 2.0) -> DataFrame:
    """Month-end weights in proportion to the last score of the month, scaled to a gross exposure."""
    last = signal.groupBy(F.last_day("date").alias("date"), "ticker").agg(F.max_by("score", F.when(F.col("score").isNotNull(), F.col("date"))).alias("score"))
    total = F.sum(F.abs("score")).over(Window.partitionBy("date"))
    return last.select("date", "ticker", F.coalesce(gross * F.col("score") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("weight"))


def turnover(weights: DataFrame) -> DataFrame:
    t = Window.partitionBy("ticker").orderBy("date")
    return weights.withColumn("change", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(t), F.lit(0.0)))).groupBy("date").agg(F.sum("change").alias("turnover"))


def portfolio_pnl(weights: DataFrame, periods: DataFrame, bps: float = 5.0) -> DataFrame:
    """Each period's profit of the weights set at the end of the period before, less the cost of setting them."""
    held = weights.select(F.last_day(F.add_months("date", 1)).alias("period_end"), "ticker", "weight")
    gain = held.join(periods, ["period_end", "ticker"]).groupBy("period_end").agg(F.sum(F.col("weight") * F.col("period_ret")).alias("gain"))
    cost = turnover(weights).select(F.last_day(F.add_months("date", 1)).alias("period_end"), (F.col("turnover") * bps / 1e4).alias("cost"))
    return gain.join(cost, "period_end").select("period_end", (F.col("gain") - F.col("cost")).alias("pnl"))


def equity(pnl: DataFrame) -> DataFrame:
    """Equity and drawdown; one row a period, so the window without key is small."""
    upto = Window.orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    e = pnl.withColumn("equity", F.product(1 + F.col("pnl")).over(upto))
    return e.withColumn("drawdown", F.col("equity") / F.nullif(F.max("equity").over(upto), F.lit(0.0)) - 1)


def performance(pnl: DataFrame, turn: DataFrame, factor: float = 12.0) -> DataFrame:
    mean, sd = F.avg("pnl") * factor, F.stddev_samp("pnl") * F.sqrt(F.lit(factor))
    main = equity(pnl).agg(mean.alias("ann_return"), sd.alias("ann_vol"), F.coalesce(mean / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("sharpe"), F.count("*").alias("periods"), (-F.min("drawdown")).alias("max_drawdown"))
    return main.crossJoin(turn.agg(F.avg("turnover").alias("avg_turnover_per_rebalance"), (F.avg("turnover") * factor).alias("ann_turnover")))


def rolling_sharpe(pnl: DataFrame, rows: int = 12, factor: float = 12.0) -> DataFrame:
    w = Window.orderBy("period_end").rowsBetween(-(rows - 1), 0)
    s = F.avg("pnl").over(w) / F.nullif(F.stddev_samp("pnl").over(w), F.lit(0.0)) * F.sqrt(F.lit(factor))
    return pnl.select("period_end", F.when(F.count("pnl").over(w) >= rows, s).alias("rolling_sharpe"))


def by_regime(pnl: DataFrame, market_periods: DataFrame, factor: float = 12.0) -> DataFrame:
    j = pnl.join(market_periods, "period_end", "left").withColumn("regime", F.when(F.coalesce("mkt_period", F.lit(0.0)) >= 0, "UP").otherwise("DOWN"))
    mean, sd = F.avg("pnl") * factor, F.stddev_samp("pnl") * F.sqrt(F.lit(factor))
    return j.groupBy("regime").agg(mean.alias("ann_return"), sd.alias("ann_vol"), F.coalesce(mean / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("sharpe"), F.count("*").alias("periods"))


def static_betas(rets: DataFrame, market: DataFrame, least: int = 5) -> DataFrame:
    b = F.covar_samp("ret", "mkt_ret") / F.nullif(F.var_samp("mkt_ret"), F.lit(0.0))
    return rets.join(F.broadcast(market), "date").groupBy("ticker").agg(F.when(F.count("*") >= least, F.coalesce(b, F.lit(0.0))).otherwise(0.0).alias("beta"))


def binding(weights: DataFrame, betas: DataFrame, bound: float = 0.1, gross: float = 2.0, limit: float = 0.02, eps: float = 1e-6) -> DataFrame:
    j = weights.join(betas, ["date", "ticker"], "left") if "date" in betas.columns else weights.join(F.broadcast(betas), "ticker", "left")
    beta = F.sum(F.col("weight") * F.coalesce("beta", F.lit(0.0)))
    g = j.groupBy("date").agg(F.avg((F.abs("weight") >= bound - eps).cast("double")).alias("pos_bind_rate"), (F.sum(F.abs("weight")) >= gross - eps).cast("double").alias("gross_bind"), beta.alias("beta_exposure"))
    return g.withColumn("beta_bind", (F.abs("beta_exposure") >= limit - eps).cast("double"))


def sector_exposure(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    j = weights.join(F.broadcast(sectors), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))
    return j.groupBy("date", "sector").agg(F.sum("weight").alias("exposure"))


def ewma_covariance(rets: DataFrame, decay: float = 0.94, normalised: bool = False) -> DataFrame:
    """The recursion S <- decay S + (1 - decay) r r' in closed form, from zero, as sums of weighed products by blocks."""
    days = rets.select("date").distinct().withColumn("ord", F.row_number().over(Window.orderBy("date")))
    last = days.agg(F.max("ord").alias("last"))
    r = rets.join(F.broadcast(days.crossJoin(last)), "date").withColumn("w", F.lit(1 - decay) * F.pow(F.lit(decay), F.col("last") - F.col("ord")))
    return pair_sums(r, "ret", "w").select("ticker_i", "ticker_j", (F.col("sij") / F.col("sw") if normalised else F.col("sij")).alias("c"))
