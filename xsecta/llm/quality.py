"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_sample, mix64, row_chunks, small, text_batch, text_of, word_hashes

#: Bits of the feature hash; the weights are 2**BITS floats (4 MB), whatever the corpus.
BITS = 20
#: Labelled rows to train on at most (in expectation: rows are chosen by hash).
SAMPLE = 8_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 0.0005, 0.01


def _families(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of each word position, by family, and the offsets of each row's words.

    Families: one, two and three neighbouring words; and, as further features, one, two and three neighbouring forms. A
    word's form is its capitals, its last two bytes if they aren't letters, and whether it repeats the word before.
    """
    words, at = word_hashes(data, offsets)
    if len(words) == 0:
        return [words] * 6, at
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    length = np.add.reduceat(solid, starts, dtype=np.int64)
    upper = np.add.reduceat((data >= 65) & (data <= 90), starts, dtype=np.int64)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    tail = np.where(letter, 0, data).astype(np.uint64)
    last = starts + length - 1
    end = tail[last] | (np.where(length > 1, tail[np.maximum(last - 1, 0)], 0).astype(np.uint64) << np.uint64(8))
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[at[:-1][at[:-1] < len(words)]] = False
    caps = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper >= length, 3, 2))).astype(np.uint64)
    form = mix64(end | (caps << np.uint64(16)) | (again.astype(np.uint64) << np.uint64(20)))
    row_end = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(words))
    out = []
    for unit in (words, form + np.uint64(11)):
        following = np.where(place + 1 < row_end, np.roll(unit, -1), np.uint64(1))
        third = np.where(place + 2 < row_end, np.roll(unit, -2), np.uint64(2))
        two = mix64(unit * np.uint64(3) + following)
        out += [unit, two, mix64(two * np.uint64(5) + third)]
    return out, at


def _slots(family: np.ndarray, k: int) -> np.ndarray:
    return (mix64(family + np.uint64(7919 * (k + 1))) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray):
    """Sparse rows: for each row its distinct slots and each one's share of the row's n-grams of that family."""
    families, at = _families(data, offsets)
    slots = [_slots(f, k) for k, f in enumerate(families)]
    for a, b in zip(at[:-1], at[1:]):
        if a == b:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        index, count = np.unique(np.concatenate([s[a:b] for s in slots]), return_counts=True)
        yield index, count / (b - a)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: sparse dot products as sums over the rows' n-grams."""
        families, at = _families(data, offsets)
        total = np.zeros(len(at) - 1)
        size = np.diff(at)
        full = size > 0
        if full.any():
            values = sum(self.weights[_slots(f, k)] for k, f in enumerate(families))
            total[full] = np.add.reduceat(values, at[:-1][full]) / size[full]
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def ftrl(rows, labels, epochs: int = EPOCHS) -> Model:
    """Per-coordinate FTRL-proximal with L1 and L2 on rows of (slots, values)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for (index, value), y in zip(rows, labels):
            i, x = np.append(index, size), np.append(value, 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weight(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _sparse(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [x for part in row_chunks(*text_batch(batch.column("text"))) for x in features(*part)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
            ["doc_id", "y", "slots", "shares"],
        )


def _views(got) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order of the rows, and (slots, shares) of each in it: views of the table's buffers, as copies would be several times its size."""
    import pyarrow.compute as pc

    ends = np.cumsum([0, *(len(c) for c in got.column("slots").chunks)])
    rows = pc.sort_indices(got, sort_keys=[("order", "ascending")]).to_numpy().astype(np.int64)
    chunks = np.searchsorted(ends, rows, side="right") - 1
    view = lambda name, kind, c, i: np.frombuffer(got.column(name).chunk(c)[i].as_buffer(), kind)
    return rows, [(view("slots", "<i4", c, i), view("shares", "<f4", c, i)) for c, i in zip(chunks.tolist(), (rows - ends[chunks]).tolist())]


def _fit(got):
    import pyarrow as pa

    order, rows = _views(got)
    model = ftrl(rows, got.column("y").to_numpy()[order].tolist())
    return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias]})


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows outside the held-out fold, chosen by the hash of doc_id so that about sample of them stay.

    The chosen labels are broadcast to the documents, so no text is shuffled, unless repeated doc_ids make them more than 20
    times sample; one task fits the model on sparse rows. Labels that are null or not 0 or 1, and rows without doc_id,
    are left out; a repeated doc_id counts as often as its labels and texts meet. Without any labelled row, or with empty
    tables, all scores are 0.5.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out()).select("doc_id", F.col(label).cast("double").alias("y"))
    chosen = known.filter(in_sample("doc_id", min(1.0, sample / max(1, known.count()))))
    texts = docs.select("doc_id", text_of().alias("text")).join(small(chosen, 20 * sample), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sparse = texts.mapInArrow(_sparse, f"doc_id {kind}, y double, slots binary, shares binary")
    ordered = sparse.withColumn("order", F.xxhash64("doc_id", F.lit(5)))
    fitted = ordered.groupBy(F.lit(1).alias("one")).applyInArrow(_fit, "weights binary, bias double").collect()
    if not fitted:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(fitted[0].weights, np.float32), fitted[0].bias)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add score to the columns keep (doc_id alone by default) of every document; only the text is looked at.

    A null or empty text scores as its bias alone; repeated rows score alike; other columns are dropped.
    """
    keep = keep or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    inner = docs.select(*keep, text_of().alias("__text"))

    def run(batches):
        import pyarrow as pa

        own = Model(*held.value)
        for batch in batches:
            got = np.concatenate([np.zeros(0), *(own.scores(*part) for part in row_chunks(*text_batch(batch.column("__text"))))])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(got)], [*keep, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return inner.mapInArrow(run, StructType([*inner.schema.fields[:-1], StructField("score", DoubleType())]))


def op10_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
