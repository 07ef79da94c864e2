"""Universes: cached vendor prices and sectors of known tickers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import load, merge_cache, missing_window
from .vendor import vendor_prices

SHAPE = "date date, ticker string, close double"
# The sector of each ticker of the default universe; any other one is in OTHER.
SECTORS = {
    "AAPL": "Information Technology",
    "MSFT": "Information Technology",
    "NVDA": "Information Technology",
    "AVGO": "Information Technology",
    "AMD": "Information Technology",
    "QCOM": "Information Technology",
    "CSCO": "Information Technology",
    "ORCL": "Information Technology",
    "ACN": "Information Technology",
    "ADBE": "Information Technology",
    "CRM": "Information Technology",
    "TXN": "Information Technology",
    "IBM": "Information Technology",
    "INTC": "Information Technology",
    "AMAT": "Information Technology",
    "GOOGL": "Communication Services",
    "META": "Communication Services",
    "NFLX": "Communication Services",
    "CMCSA": "Communication Services",
    "VZ": "Communication Services",
    "AMZN": "Consumer Discretionary",
    "TSLA": "Consumer Discretionary",
    "HD": "Consumer Discretionary",
    "NKE": "Consumer Discretionary",
    "MCD": "Consumer Discretionary",
    "SBUX": "Consumer Discretionary",
    "BKNG": "Consumer Discretionary",
    "LOW": "Consumer Discretionary",
    "KO": "Consumer Staples",
    "PEP": "Consumer Staples",
    "COST": "Consumer Staples",
    "PM": "Consumer Staples",
    "WMT": "Consumer Staples",
    "UNH": "Health Care",
    "MRK": "Health Care",
    "ABBV": "Health Care",
    "PFE": "Health Care",
    "TMO": "Health Care",
    "ABT": "Health Care",
    "DHR": "Health Care",
    "GILD": "Health Care",
    "CVX": "Energy",
    "XOM": "Energy",
    "JPM": "Financials",
    "V": "Financials",
    "MA": "Financials",
    "UPS": "Industrials",
    "CAT": "Industrials",
    "HON": "Industrials",
    "LIN": "Materials",
}
OTHER = "Other"


def sector_table(spark: SparkSession, tickers: list[str]) -> DataFrame:
    """(ticker, sector) of the tickers, in OTHER where the sector isn't known."""
    return spark.createDataFrame([(t, SECTORS.get(t, OTHER)) for t in dict.fromkeys(tickers)], "ticker string, sector string")


def read_cache(spark: SparkSession, path: str, tickers: list[str]) -> DataFrame:
    """Cached (date, ticker, close) of the tickers, by partition; empty if there is no cache that can be read."""
    try:
        held = spark.read.schema(SHAPE).option("basePath", path).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SHAPE)
    return held.filter(F.col("ticker").isin(tickers)).select("date", "ticker", "close")


def cached_prices(spark: SparkSession, path: str, tickers: list[str], start: str, end: str, fetch=vendor_prices) -> tuple[DataFrame, DataFrame]:
    """(prices within [start, end], the merged cache to write): only what the cache lacks is fetched.

    fetch(spark, tickers, start, end) is called once for each distinct missing window, of which there are few.
    """
    tickers = list(dict.fromkeys(tickers))
    cache = read_cache(spark, path, tickers)
    gaps = {r.ticker: (r.need_from, r.need_to) for r in missing_window(cache, start, end).collect()}
    wanted: dict[tuple, list[str]] = {}
    for t in tickers:
        a, b = gaps.get(t, (start, end))
        if a is not None and b is not None:
            wanted.setdefault((str(a), str(b)), []).append(t)
    merged = cache
    for (a, b), names in wanted.items():
        merged = merge_cache(merged, fetch(spark, names, a, b).select("date", "ticker", "close")).select("date", "ticker", "close")
    return load(merged, start, end), merged


def universe(prices: DataFrame, tickers: list[str], market: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(prices of the stocks that have any, market prices(date, px), those stocks in the order asked for)."""
    known = {r.ticker for r in prices.filter(F.col("close").isNotNull()).select("ticker").distinct().collect()}
    if market not in known:
        raise ValueError(f"no prices of the market {market}")
    there = [t for t in dict.fromkeys(tickers) if t in known and t != market]
    return prices.filter(F.col("ticker").isin(there)), prices.filter(F.col("ticker") == market).select("date", F.col("close").alias("px")), there
