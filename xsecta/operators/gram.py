"""Sums of products over dates for all pairs of names, and the axes of such a matrix, by blocks of names and of dates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names and dates of a block, about.
NAMES, DATES = 256, 256
#: Rows of the largest matrix whose axes are found in one task: the lesser of names and dates.
SIDE = 4096

SUMS = "ticker_i string, ticker_j string, n long, sw double, si double, sj double, sij double"


def _block(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dates, names, values and weights of a packed block."""
    flat = column.values if hasattr(column, "values") else column
    parts = [flat.field(c) for c in ("date", "ticker", "x", "w")]
    return tuple(np.asarray(p.to_pylist(), dtype=object) if k == 1 else p.to_numpy(zero_copy_only=False) for k, p in enumerate(parts))


def _dense(dates, tickers, x, w, days):
    names, column = np.unique(tickers, return_inverse=True)
    row = np.searchsorted(days, dates)
    values, known, weights = np.zeros((len(days), len(names))), np.zeros((len(days), len(names))), np.zeros((len(days), 1))
    values[row, column], known[row, column], weights[row, 0] = x, 1.0, w
    return names, values, known, weights


def _pair_sums(batches):
    """All sums of two blocks of names over one block of dates."""
    import pyarrow as pa

    names = [c.split()[0] for c in SUMS.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            left, right = _block(batch.column("rows_a")[k]), _block(batch.column("rows_b")[k])
            days = np.union1d(left[0], right[0])
            na, xa, ma, wa = _dense(*left, days)
            nb, xb, mb, wb = _dense(*right, days)
            w = np.maximum(wa, wb)
            sums = [ma.T @ mb, (ma * w).T @ mb, (xa * w).T @ mb, (ma * w).T @ xb, (xa * w).T @ xb]
            i, j = np.nonzero((sums[0] > 0) & ((na[:, None] <= nb[None, :]) | (batch.column("a")[k] != batch.column("b")[k])))
            turn = na[i] > nb[j]
            first, second = np.where(turn, nb[j], na[i]), np.where(turn, na[i], nb[j])
            n, sw, si, sj, sij = (s[i, j] for s in sums)
            columns = [pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(n.astype(np.int64)), *[pa.array(c) for c in (sw, np.where(turn, sj, si), np.where(turn, si, sj), sij)]]
            yield pa.RecordBatch.from_arrays(columns, names)


def sizes_of(panel: DataFrame) -> tuple[int, int]:
    """Numbers of names and dates, about."""
    found = panel.agg(F.approx_count_distinct("ticker").alias("p"), F.approx_count_distinct("date").alias("t")).first()
    return found.p or 0, found.t or 0


def pair_sums(panel: DataFrame, value: str = "ret", weight: str | None = None, by: list[str] = [], sizes: tuple[int, int] | None = None) -> DataFrame:  # noqa: B006
    """(by, ticker_i, ticker_j, n, sw, si, sj, sij) of panel(by, date, ticker, value[, weight]) for ticker_i <= ticker_j.

    n counts the dates on which both are known, sw sums their weights, and si, sj and sij weigh the one value, the other,
    and their product there. The weight belongs to the date. Pairs without a common date have no row. sizes are the numbers of
    names and dates, where they are known.

    Names and dates are dealt into blocks by hash. A block of names meets each other one at the same block of dates once, as
    two small matrices whose product holds all their pairs: what is shuffled is the panel times half the number of blocks of
    names, then one row a pair and block of dates, while a join of the panel with itself makes one a pair and date.
    """
    known = panel.filter(F.col(value).isNotNull())
    p, t = sizes or sizes_of(known)
    part = lambda c, n, most: F.pmod(F.xxhash64(c), F.lit(max(1, math.ceil(n / most))))
    row = F.struct(F.unix_date("date").alias("date") if dict(panel.dtypes)["date"] == "date" else F.col("date"), "ticker", F.col(value).cast("double").alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    packed = known.groupBy(*by, part("date", t, DATES).alias("days"), part("ticker", p, NAMES).alias("names")).agg(F.collect_list(row).alias("rows"))
    a = packed.select(*by, "days", F.col("names").alias("a"), F.col("rows").alias("rows_a"))
    b = packed.select(*by, "days", F.col("names").alias("b"), F.col("rows").alias("rows_b"))
    met = a.join(b, [*by, "days"]).filter(F.col("a") <= F.col("b"))
    if by:  # Arrow functions see the columns they are given only, so keys travel as one
        met = met.withColumn("__by", F.struct(*by))
        sums = met.select("__by", "a", "b", "rows_a", "rows_b").mapInArrow(_with_key(met.schema["__by"].dataType), f"__by {met.schema['__by'].dataType.simpleString()}, {SUMS}").select(*[F.col(f"__by.{c}").alias(c) for c in by], "*").drop("__by")
    else:
        sums = met.select("a", "b", "rows_a", "rows_b").mapInArrow(_pair_sums, SUMS)
    return sums.groupBy(*by, "ticker_i", "ticker_j").agg(*[F.sum(c).alias(c) for c in ("n", "sw", "si", "sj", "sij")])


def _with_key(_):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                for out in _pair_sums([one]):
                    key = one.column("__by").take(pa.array(np.zeros(out.num_rows, np.int64)))
                    yield pa.RecordBatch.from_arrays([key, *out.columns], ["__by", *out.schema.names])

    return run


def covariance(panel: DataFrame, value: str = "ret", by: list[str] = []) -> DataFrame:  # noqa: B006
    """Sample covariance of all pairs over their common dates; null for a single one."""
    n = F.col("n")
    return pair_sums(panel, value, None, by).select(*by, "ticker_i", "ticker_j", F.when(n > 1, (F.col("sij") - F.col("si") * F.col("sj") / n) / (n - 1)).alias("c"))


def squared_norm(pairs: DataFrame) -> DataFrame:
    """(trace, norm2, names) of the symmetric matrix whose lower half is pairs(ticker_i, ticker_j, c)."""
    own = F.col("ticker_i") == F.col("ticker_j")
    return pairs.agg(F.sum(F.when(own, F.col("c"))).alias("trace"), F.sum(F.col("c") * F.col("c") * F.when(own, 1.0).otherwise(2.0)).alias("norm2"), F.count(F.when(own, 1)).alias("names"))


def centred(rets: DataFrame) -> DataFrame:
    """(date, ticker, x, n): returns of all names on all n dates, missing ones as 0, less the name's mean."""
    dates = rets.select("date").distinct()
    dense = dates.crossJoin(F.broadcast(rets.select("ticker").distinct())).join(rets, ["date", "ticker"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    own = Window.partitionBy("ticker")
    return dense.select("date", "ticker", (F.col("ret") - F.avg("ret").over(own)).alias("x"), F.count("*").over(own).alias("n"))


def ledoit_wolf(rets: DataFrame) -> DataFrame:
    """(ticker_i, ticker_j, c): covariance shrunk towards a multiple of the identity by the published optimal intensity.

    All of the intensity is sums: the squared norm of the covariance over its pairs, and over the dates the squared sum of
    squares of the centred returns, which stands for the sum over all pairs of their products' squares. Missing returns are
    0. The result has no eigenvalue below intensity * mean. One date gives 1e-8 times the identity.
    """
    x = centred(rets)
    s = pair_sums(x, "x", sizes=sizes_of(rets)).select("ticker_i", "ticker_j", (F.col("sij") / F.col("n")).alias("c"))
    by_date = x.groupBy("date").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    quads = by_date.agg(F.sum(F.col("q") * F.col("q")).alias("quads"), F.count("*").alias("dates"))
    mean, p, n = F.col("trace") / F.col("names"), F.col("names"), F.col("dates")
    spread = F.col("norm2") / p - mean * mean
    noise = F.least(spread, (F.col("quads") / n - F.col("norm2")) / (n * p))
    scalars = squared_norm(s).crossJoin(quads).select("dates", mean.alias("mean"), F.coalesce(noise / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("share"))
    own = F.col("ticker_i") == F.col("ticker_j")
    c = (1 - F.col("share")) * F.col("c") + F.when(own, F.col("share") * F.col("mean")).otherwise(0.0)
    tiny = F.when(own, 1e-8).otherwise(0.0)
    return s.crossJoin(F.broadcast(scalars)).select("ticker_i", "ticker_j", F.when(F.col("dates") < 2, tiny).otherwise(c).alias("c"))


def _leading(count: int | None):
    """(k, g, name, u) of the symmetric matrix of one group: its axes from the largest eigenvalue down."""

    def run(g):
        import pandas as pd

        names = sorted(set(g.ticker_i) | set(g.ticker_j))
        at = {t: k for k, t in enumerate(names)}
        i, j = g.ticker_i.map(at).to_numpy(), g.ticker_j.map(at).to_numpy()
        s = np.zeros((len(names), len(names)))
        s[i, j] = s[j, i] = g.sij.to_numpy()
        values, vectors = np.linalg.eigh(s)
        keep = np.arange(len(values))[::-1][:count]
        keep = keep[values[keep] > 1e-12 * max(values.max(initial=0.0), 0.0)]
        return pd.DataFrame({"k": np.repeat(np.arange(len(keep)), len(names)), "g": np.repeat(values[keep], len(names)), "name": names * len(keep), "u": vectors[:, keep].T.ravel()})

    return run


def axes(panel: DataFrame, value: str = "x", count: int | None = None) -> DataFrame:
    """(k, g, ticker, v): eigenvalues g and unit vectors v of the sum over dates of x x' in falling order; zero ones left out.

    Only the lesser of both sides is decomposed, in one task: the names' products if there are fewer names, else the dates',
    whose matrix has the same eigenvalues, and whose vectors give the names' by one more product. Dates are those of a
    window, so SIDE bounds that task for any number of names; beyond it an error says so.
    """
    sizes = panel.agg(F.countDistinct("ticker").alias("p"), F.countDistinct("date").alias("t")).first()
    if min(sizes.p, sizes.t) > SIDE:
        raise ValueError(f"axes of {sizes.p} names over {sizes.t} dates: one side must be at most {SIDE}")
    shape = "k int, g double, name string, u double"
    if sizes.p <= sizes.t:
        return pair_sums(panel, value, sizes=(sizes.p, sizes.t)).groupBy(F.lit(1).alias("one")).applyInPandas(_leading(count), shape).withColumnRenamed("name", "ticker").withColumnRenamed("u", "v")
    turned = panel.select(F.col("ticker").alias("date"), F.col("date").cast("string").alias("ticker"), F.col(value).alias("x"))
    dual = pair_sums(turned.withColumn("date", F.xxhash64("date")), "x", sizes=(sizes.t, sizes.p)).groupBy(F.lit(1).alias("one")).applyInPandas(_leading(count), shape)
    met = panel.withColumn("name", F.col("date").cast("string")).join(dual, "name")
    return met.groupBy("k", "g", "ticker").agg((F.sum(F.col(value) * F.col("u")) / F.sqrt("g")).alias("v"))


def sample_axes(rets: DataFrame, count: int | None = None) -> DataFrame:
    """axes() of the sample covariance of returns."""
    return axes(centred(rets).withColumn("x", F.col("x") / F.sqrt(F.greatest(F.lit(1), F.col("n") - 1))), "x", count)


def repaired_covariance(rets: DataFrame, share: float = 1e-6, least: float = 1e-12) -> DataFrame:
    """(ticker_i, ticker_j, c): the sample covariance with its eigenvalues raised to max(share * mean, least).

    The floor times the identity, and for each axis above it the rest of its eigenvalue: products of scaled axes, made by
    blocks as those of returns are. Only axes() works in one task, on the lesser side.
    """
    found = sample_axes(rets)
    per_axis = found.groupBy("k").agg(F.first("g").alias("g"))
    names = rets.select("ticker").distinct()
    floor = per_axis.agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("trace")).crossJoin(names.agg(F.count("*").alias("p"))).select(F.greatest(share * F.col("trace") / F.col("p"), F.lit(least)).alias("floor"))
    scaled = found.crossJoin(F.broadcast(floor)).filter(F.col("g") > F.col("floor")).select(F.col("k").cast("long").alias("date"), "ticker", (F.col("v") * F.sqrt(F.col("g") - F.col("floor"))).alias("x"))
    own = names.select(F.col("ticker").alias("ticker_i"), F.col("ticker").alias("ticker_j")).crossJoin(F.broadcast(floor)).select("ticker_i", "ticker_j", F.col("floor").alias("c"))
    p, t = sizes_of(rets)
    return pair_sums(scaled, "x", sizes=(p, min(p, t))).select("ticker_i", "ticker_j", F.col("sij").alias("c")).unionByName(own).groupBy("ticker_i", "ticker_j").agg(F.sum("c").alias("c"))
