"""Shared helpers: scratch tables, input columns, span digests and batched word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: \x20 and \x09-\x0D.
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that saved() has written, each with a weak reference to the file list in the JVM that plans read it by.
_written: list[tuple[str, object]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver's JVM ends.

    Where the setting is missing, a local session gets a temporary folder; on a cluster, where executors wouldn't see the
    driver's, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="xsecta-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/xsecta-{uuid.uuid4().hex}"
    where, files = _place(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends here, and any executor can reread it."""
    spark = df.sparkSession
    path = scratch_dir(spark) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location()
    _written.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(files)))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _place(spark, path)
    files.delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete what saved() wrote for the tables; nothing may read it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete the scratch tables that nothing can read any more: those whose file lists the JVM has collected.

    Every plan that reads a table, of whatever DataFrame was derived from it, holds its file list, as does a job that runs.
    So what a caller still holds stays, and no order of calls is assumed.
    """
    for _ in range(3):  # Python's proxies let go of their objects a little after they are collected themselves
        gc.collect()
        spark.range(1).collect()  # the session keeps the plan of its last query
        spark.sparkContext._jvm.System.gc()
    for path, files in list(_written):
        if files.get() is None:
            _delete(spark, path)
            _written.remove((path, files))


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; a join with more rows of it is left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shuffled(df: DataFrame) -> DataFrame:
    """df, which grows with the corpus, for joins by shuffle only.

    Spark would broadcast a scratch table by the size of its files, which is many times less than its rows take in memory.
    """
    return df.hint("merge")


def texts_of_pairs(pairs: DataFrame, texts: DataFrame, members: int = 2_000, most: int = 1_000_000) -> DataFrame:
    """(a, b, text_a, text_b) of pairs(a, b) from texts(e, text), one row a text; rows of one b follow each other.

    A b with many partners is dealt out: so many of them each meet a copy of its text, and no task gets all. Up to most
    pairs are sent to the texts, which aren't shuffled to be picked.
    """
    fans = pairs.groupBy("b").agg(F.ceil(F.count("*") / members).alias("salts"))
    salted = pairs.join(fans, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    hubs = fans.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    if pairs.count() <= most:
        salted, hubs = F.broadcast(salted), F.broadcast(hubs)
    left = texts.select(F.col("e").alias("a"), F.col("text").alias("text_a")).join(salted, "a")
    right = texts.select(F.col("e").alias("b"), F.col("text").alias("text_b")).join(hubs, "b")
    return left.hint("merge").join(right.hint("merge"), ["b", "salt"]).select("a", "b", "text_a", "text_b")


def in_sample(column, share: float):
    """Whether a row is in a sample of that share, by the 63-bit hash of column: a share of any size keeps its meaning."""
    return F.xxhash64(column).bitwiseAND(2**63 - 1) < F.lit(min(2**63 - 1, int(share * 2**63)))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the contracts' white space."""
    flat = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def text_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the n + 1 offsets of its rows; a null row is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows, in order, and the n + 1 offsets of each row's words.

    A word is a run of bytes other than the contracts' white space; its hash depends on its bytes only.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][(offsets[:-1] < n)]
    begins[edge] = solid[edge]  # a row's first word starts there even if the row before ends in a word
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(begins, dtype=np.int64) - 1
    low = lower_ascii(data) if lower else data
    where = np.arange(n, dtype=np.int64)
    place = (where - starts[np.maximum(word, 0)]).astype(np.uint64)
    salted = mix64((place << np.uint64(8)) + low.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    salted[~solid] = 0
    sums = np.add.reduceat(salted, starts)
    return mix64(sums), np.searchsorted(starts, offsets)


def whole_groups(batches, key: str):
    """Tables of whole groups from batches that are sorted by key: a group never spans two tables."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key)
        last = keys[-1]
        cut = pc.sum(pc.not_equal(keys, last)).as_py() or 0
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def ranges(keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal neighbours in keys, with the end."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column, each row of dims values, as rows of float64."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def row_chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20):
    """(data, offsets) of consecutive rows of at most most bytes together, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
