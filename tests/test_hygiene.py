import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from xsecta.plans import registry
from xsecta.sources import panel as P

DAY, NEXT = dt.datetime(1996, 1, 2), dt.datetime(1996, 1, 3)


def test_hygiene_equals_sql_on_missing_keys_and_dates(spark, tmp_path):
    lines = [
        (None, 1, 1, 10.0, DAY), (5, 1, 1, 20.0, DAY), (4, None, 1, 30.0, DAY), (3, 1, 1, None, DAY),  # only order 5 has a key and a price
        (7, 1, 1, 40.0, None), (6, 1, 1, 50.0, None),  # without a date: a key of its own
        (None, 1, 2, 60.0, NEXT),  # no row of this key can be the first
        (2, 1, 2, 70.0, DAY), (2, 1, 2, 80.0, DAY), (2, 1, 2, 65.0, DAY),  # as loaded
    ]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.timestamp("us")]
    pq.write_table(pa.table([pa.array(x, k) for x, k in zip(zip(*lines), kinds)], names), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": [1, 2], "p_brand": ["Brand#1", None]}), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.sql("set threads=1")
    for t in ("lineitem", "part"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    con.sql("create view orders as select * from '/root/testdata/sf0.001/orders.parquet'")
    want = con.sql(f"select date, ticker, close from ({registry.ORACLE_SQL['src14_hygiene']})").fetchall()
    got = [(r.date, r.ticker, r.close) for r in registry.QUERIES["src14_hygiene"](spark, str(tmp_path)).collect()]
    assert len(want) == 4 and sorted(got, key=str) == sorted(want, key=str)


def test_first_row_as_loaded_wins_ties_over_files(spark, tmp_path):
    where = tmp_path / "t.parquet"
    where.mkdir()
    for file, closes in (("a", [3.0, 1.0]), ("b", [2.0, 9.0])):
        pq.write_table(pa.table({"date": [DAY.date()] * 2, "ticker": ["x"] * 2, "close": closes, "k": [1, 1]}), where / f"{file}.parquet")
    rows = spark.read.parquet(str(where))
    raw = rows.select("date", "ticker", "close", P.load_order(rows.k).alias("load_seq"))
    assert [r.close for r in P.hygiene(raw.repartition(7)).collect()] == [3.0]


def test_hygiene_drops_rows_without_a_date_unless_asked(spark):
    raw = spark.createDataFrame([("2020-01-01", "a", 1.0, 2, "u"), ("2020-01-01", "a", 2.0, 1, "v"), ("no date", "a", 3.0, 0, "w"), (None, "a", 4.0, 0, "z")], "date string, ticker string, close double, load_seq int, more string")
    assert [tuple(r) for r in P.hygiene(raw).collect()] == [(dt.date(2020, 1, 1), "a", 2.0, "v")]
    assert sorted((r.close, r.more) for r in P.hygiene(raw, undated=True).collect()) == [(2.0, "v"), (4.0, "z")]
