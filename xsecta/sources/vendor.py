"""Vendor prices as a Spark data source: one partition a batch of tickers, fetched on the executors."""

from __future__ import annotations

import importlib
import time
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Tickers of a batch call, tries of a call, first pause in seconds and its growth, address of the CSV vendor.
BATCH, TRIES, PAUSE, GROWTH = 20, 3, 0.7, 1.5
CSV_URL = "https://stooq.com/q/d/l/?s={symbol}&i=d"

SHAPE = "date date, ticker string, close double"
HERE = __name__


def closing(frame: pd.DataFrame | None, ticker: str) -> pd.Series:
    """The closing prices of a vendor's frame by naive date: column Close or else the last one; first row of a date wins.

    Two header levels may be (ticker, field) or (field, ticker). None and empty frames give an empty series, and rows
    without a date or a price go.
    """
    if frame is None or frame.empty:
        return pd.Series(dtype=float)
    if isinstance(frame.columns, pd.MultiIndex):
        for level in (0, 1):
            if ticker in frame.columns.get_level_values(level):
                frame = frame.xs(ticker, axis=1, level=level)
                break
    picked = frame["Close"] if "Close" in frame.columns else frame.iloc[:, -1]
    when = pd.to_datetime(picked.index, utc=True, errors="coerce").tz_localize(None).normalize()
    one = pd.Series(pd.to_numeric(picked.to_numpy(), errors="coerce"), when)
    return one[one.index.notna() & ~one.index.duplicated()].dropna().sort_index()


def persistent(fetch: Callable, empty: Callable[[object], bool] | None = None, tries: int = TRIES, pause: float = PAUSE):
    """fetch() again after growing pauses while it raises, or while empty(result); the last error is raised in the end."""
    result = error = None
    for k in range(tries):
        if k:
            time.sleep(pause * GROWTH ** (k - 1))
        try:
            result = fetch()
        except Exception as e:  # vendors raise anything
            error = e
        else:
            if empty is None or not empty(result):
                return result
    if error is not None:
        raise error
    return result


def _vendor():
    return importlib.import_module("yfinance")  # optional


def many(tickers: list[str], start: str, end: str) -> pd.DataFrame:
    return _vendor().download(tickers, start=start, end=end, auto_adjust=True, progress=False, threads=True, group_by="ticker")


def download(ticker: str, start: str, end: str) -> pd.Series:
    call = lambda: closing(_vendor().download(ticker, start=start, end=end, auto_adjust=True, progress=False, threads=False), ticker)
    return persistent(call, lambda s: s.empty)


def history(ticker: str, start: str, end: str) -> pd.Series:
    return closing(_vendor().Ticker(ticker).history(start=start, end=end, auto_adjust=True, actions=False, interval="1d"), ticker)


def whole_history(ticker: str, start: str, end: str) -> pd.Series:
    return closing(_vendor().Ticker(ticker).history(period="max", auto_adjust=True, actions=False, interval="1d"), ticker)[start:end]


def csv(ticker: str, start: str, end: str) -> pd.Series:
    symbol = ticker.lower() if "." in ticker else f"{ticker.lower()}.us"
    frame = pd.read_csv(CSV_URL.format(symbol=symbol))
    return closing(frame.set_index("Date")[["Close"]], ticker)[start:end] if "Close" in frame else pd.Series(dtype=float)


#: Tried in this order; one that raises gives way to the next, one that finds nothing doesn't.
CHAIN = [f"{HERE}:download", f"{HERE}:history", f"{HERE}:whole_history", f"{HERE}:csv"]


def named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def first_working(chain: list[Callable], ticker: str, start: str, end: str) -> pd.Series:
    for fetch in chain:
        try:
            return fetch(ticker, start, end)
        except Exception as e:  # vendors raise anything
            error = e
    warnings.warn(f"no prices of {ticker}: {error!r}", stacklevel=2)
    return pd.Series(dtype=float)


class Batch(InputPartition):
    def __init__(self, tickers: list[str]):
        self.tickers = tickers


class VendorReader(DataSourceReader):
    def __init__(self, options):
        self.tickers = list(dict.fromkeys(t for t in options.get("tickers", "").split(",") if t))
        self.start, self.end = options["start"], options["end"]
        self.batch = options.get("batch", f"{HERE}:many")
        self.chain = options.get("chain", ",".join(CHAIN)).split(",")

    def partitions(self):
        return [Batch(self.tickers[i : i + BATCH]) for i in range(0, len(self.tickers), BATCH)] or [Batch([])]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.tickers:
            return
        try:
            frame = persistent(lambda: named(self.batch)(partition.tickers, self.start, self.end))
        except Exception:  # then each ticker goes down the chain
            frame = None
        several = frame is not None and isinstance(frame.columns, pd.MultiIndex)
        there = set(frame.columns.get_level_values(0)) if several else set(partition.tickers[:1]) if frame is not None else set()
        chain = [named(c) for c in self.chain]
        for ticker in partition.tickers:
            found = closing(frame, ticker) if ticker in there else pd.Series(dtype=float)
            if found.empty:
                found = first_working(chain, ticker, self.start, self.end)
            for day, close in found.items():
                yield day.date(), ticker, float(close)


class VendorSource(DataSource):
    """Format vendor_prices. Options: tickers (comma-joined), start, end; batch and chain name other fetchers as module:function."""

    @classmethod
    def name(cls):
        return "vendor_prices"

    def schema(self):
        return SHAPE

    def reader(self, schema):
        return VendorReader(self.options)


def vendor_prices(spark: SparkSession, tickers: list[str], start: str, end: str, **options: str) -> DataFrame:
    """(date, ticker, close) of all tickers that any vendor knows, within [start, end]."""
    spark.dataSource.register(VendorSource)
    found = spark.read.format("vendor_prices").options(tickers=",".join(tickers), start=start, end=end, **options).load()
    return found.filter(found.date.between(start, end))
