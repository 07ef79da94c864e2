import pandas as pd
import pytest

from xsecta.sources import vendor

DAYS = pd.to_datetime(["2024-01-03", "2024-01-02", "2024-01-02"])


def batch(tickers, start, end):
    return pd.concat({t: pd.DataFrame({"Open": [0.0, 0, 0], "Close": [2.0, 1, 9]}, DAYS) for t in tickers if t.startswith("A")}, axis=1)


def fails(ticker, start, end):
    raise OSError("down")


def finds(ticker, start, end):
    return pd.Series([5.0] if ticker == "B" else [], pd.to_datetime(["2024-01-02"] if ticker == "B" else []))


def test_closing_takes_any_header():
    plain = pd.DataFrame({"Open": [0.0, 0, 0], "Close": [2.0, 1, None]}, DAYS)
    assert vendor.closing(plain, "A").tolist() == [1, 2]
    assert vendor.closing(pd.concat({"A": plain}, axis=1), "A").tolist() == [1, 2]
    assert vendor.closing(pd.concat({"A": plain}, axis=1).swaplevel(axis=1), "A").tolist() == [1, 2]
    assert vendor.closing(plain[["Open"]], "A").tolist() == [0, 0] and vendor.closing(None, "A").empty


def test_persistent_pauses_and_raises(monkeypatch):
    slept = []
    monkeypatch.setattr(vendor.time, "sleep", slept.append)
    with pytest.raises(OSError):
        vendor.persistent(lambda: fails("A", "", ""))
    assert slept == [0.7, pytest.approx(1.05)]
    assert vendor.persistent(list, lambda x: not x) == []


def test_empty_answers_end_the_chain():
    assert vendor.first_working([finds, fails], "C", "", "").empty
    assert vendor.first_working([fails, finds], "B", "", "").tolist() == [5]
    with pytest.warns(UserWarning):
        assert vendor.first_working([fails], "B", "", "").empty


def test_batches_then_chain(spark):
    tickers = [f"A{i}" for i in range(21)] + ["B", "C"]
    got = vendor.vendor_prices(spark, tickers, "2024-01-01", "2024-01-02", batch="tests.test_vendor:batch", chain="tests.test_vendor:fails,tests.test_vendor:finds")
    rows = {(str(r.date), r.ticker, r.close) for r in got.collect()}
    assert rows == {("2024-01-02", t, 1.0) for t in tickers[:21]} | {("2024-01-02", "B", 5.0)}
    assert got.rdd.getNumPartitions() == 2
