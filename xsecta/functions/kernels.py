"""Cross-sectional and rolling kernels as column builders; windows of one key share one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def X():  # noqa: N802
    """All names of a date."""
    return Window.partitionBy("date")


def T():  # noqa: N802
    """A ticker's rows in order; made on use, as windows need a session."""
    return Window.partitionBy("ticker").orderBy("date")


def clip(x: Column, k: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-float(k)), F.least(F.lit(float(k)), x)))


def by_confidence(mu: Column, spread: Column, floor: float = 0.25) -> Column:
    """mu over its spread, which counts as floor at least."""
    return mu / F.sqrt(F.pow(F.greatest(spread, F.lit(float(floor))), 2) + EPS)


def rolling(x: Column, aggregate, rows: int, least: int) -> Column:
    """aggregate over the last rows rows of a ticker, null where fewer than least of them are known."""
    w = T().rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(w) >= least, aggregate(x).over(w))


def z_pop(df: DataFrame, x: str, out: str, least: int = 3) -> DataFrame:
    """Population z-score by date; 0 if fewer than least are known or they don't vary; a missing value is 0."""
    c = F.col(x)
    sd = F.stddev_pop(c).over(X())
    z = (c - F.avg(c).over(X())) / (sd + EPS)
    return df.withColumn(out, F.when((F.count(c).over(X()) < least) | (sd <= 0), 0.0).otherwise(F.coalesce(z, F.lit(0.0))))


def z_samp(df: DataFrame, x: str, out: str) -> DataFrame:
    """Sample z-score by date; 0 where it doesn't vary."""
    c = F.col(x)
    sd = F.stddev_samp(c).over(X())
    return df.withColumn(out, F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((c - F.avg(c).over(X())) / (sd + EPS)))


def winsorize(df: DataFrame, x: str, out: str, k: float = 3.0) -> DataFrame:
    """Sample z-score, then clipped to k; values without variation stay, missing as 0."""
    c = F.col(x)
    sd = F.stddev_samp(c).over(X())
    return df.withColumn(out, F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.coalesce(c, F.lit(0.0))).otherwise(clip((c - F.avg(c).over(X())) / F.nullif(sd, F.lit(0.0)), k)))


def robust_z(df: DataFrame, x: str, out: str, k: float = 3.0, least: int = 3, method: str = "mad") -> DataFrame:
    """Robust z-score by date, clipped to k, missing as 0, then centred over all names, missing ones included."""
    c = F.col(x)
    if method == "mad":
        df = df.withColumn("__m", F.median(c).over(X()))
        df = df.withColumn("__s", 1.4826 * F.median(F.abs(c - F.col("__m"))).over(X()))
    else:
        df = df.withColumn("__m", F.avg(c).over(X())).withColumn("__s", F.stddev_pop(c).over(X()))
    df = df.withColumn("__z", F.coalesce(clip((c - F.col("__m")) / (F.col("__s") + EPS), k), F.lit(0.0)))
    z = F.when(F.count(c).over(X()) < least, 0.0).otherwise(F.col("__z") - F.avg("__z").over(X()))
    return df.withColumn(out, z).drop("__m", "__s", "__z")


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """Rank with ties averaged; missing values have none."""
    by = by or ["date"]
    known = F.col(x).isNull()
    low = F.rank().over(Window.partitionBy(*by, known).orderBy(x))
    return F.when(F.col(x).isNotNull(), low + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0)


def percent_rank(x: str, by: list[str] | None = None) -> Column:
    return average_rank(x, by) / F.count(x).over(Window.partitionBy(*(by or ["date"])))


def demean_by_sector(df: DataFrame, x: str, out: str, least: int = 1) -> DataFrame:
    """x less its mean by date and sector; a missing sector gives a missing value, too few known values leave x."""
    within = Window.partitionBy("date", "sector")
    d = F.when(F.col("sector").isNotNull(), F.col(x) - F.avg(x).over(within))
    return df.withColumn(out, F.when(F.count(x).over(X()) < least, F.col(x)).otherwise(d))


def trade_pnl(entry: Column, exit_: Column, notional: Column, side: Column) -> Column:
    ret = exit_ / F.nullif(entry, F.lit(0.0)) - 1
    return F.when(side == "long", notional * ret).when(side == "short", -notional * ret).otherwise(F.raise_error(F.concat(F.lit("unknown side "), side)))
