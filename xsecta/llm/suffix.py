"""Repeated byte strings by a sparse suffix array: anchored suffixes, range-partitioned by their leading bytes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import GRAM, SPAN, WIDTH, runs
from .common import mix64, ranges, row_chunks, saved, text_batch, text_of

#: Bytes that are hashed at once; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Contexts of one gram above which its strings are dealt out one by one.
HOT = 4_000
#: Bytes of the list of suffixes to compare that are broadcast at most; above that texts and list meet by a shuffle.
BROADCAST = 64 << 20
LAST = 2**63 - 1
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 2**64)


def context_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from prefix sums of byte * BASE ** place."""
    n = len(data)
    power = np.cumprod(np.full(n, BASE, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(data.astype(np.uint64) + np.uint64(0xABCD)) * power, out=sums[1:])
    back = np.cumprod(np.full(n, _INVERSE, np.uint64))
    return mix64((sums[end] - sums[start]) * back[start]) ^ mix64((end - start).astype(np.uint64))


def _packed(places: np.ndarray) -> bytes:
    return np.ascontiguousarray(places, "<u4").tobytes()


def _united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the intervals, in order; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _by_document(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(doc, mark, packed unions of intervals) for each document."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    if len(doc) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    edges = np.unique(np.concatenate([ranges(doc), ranges(mark)]))
    cut = [_united(start[a:b], end[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return doc[edges[:-1]], mark[edges[:-1]], [_packed(np.column_stack(c)) for c in cut]


SUFFIXES = "doc long, mark long, gone binary, bucket int, payload binary"


def _suffixes(buckets: int):
    """For each batch: strings repeated within it (gone), and its distinct anchored suffixes, packed by gram bucket.

    Of equal contexts in a batch, the earliest stays; the strings of the others start earlier elsewhere.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            doc, mark = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            order = np.lexsort((mark, doc))
            same = np.ones(len(order), bool)
            same[1:] = (doc[order][1:] != doc[order][:-1]) | (mark[order][1:] != mark[order][:-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(same) - 1
            doc, mark = doc[order][same], mark[order][same]
            found, done = [], 0
            for data, offsets in row_chunks(*text_batch(batch.column("text")), CHUNK):
                row, anchor, first, last, gram = runs(data, offsets)
                context = context_hashes(data, offsets[row] + first, offsets[row] + last + SPAN) ^ mix64((anchor - first).astype(np.uint64) + np.uint64(991))
                found.append((rank[row + done], anchor, first, last, gram, context))
                done += len(offsets) - 1
            row, anchor, first, last, gram, context = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort(((row << 32) | anchor, context, gram))
            row, anchor, first, last, gram, context = (x[order] for x in (row, anchor, first, last, gram, context))
            head = np.ones(len(row), bool)
            head[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            other = ~head
            other[1:] &= (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
            # a repeated row's suffixes equal those of the row itself, which must stay: compare with the head of the context
            lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
            other &= (row != row[lead]) | (anchor != anchor[lead])
            d, m, gone = _by_document(doc[row[other]], mark[row[other]], first[other], last[other] + SPAN)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(m), pa.array(gone, pa.binary()), pa.nulls(len(d), pa.int32()), pa.nulls(len(d), pa.binary())], ["doc", "mark", "gone", "bucket", "payload"])
            row, anchor, first, last, gram, context = (x[head] for x in (row, anchor, first, last, gram, context))
            bucket = (gram >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            numbers, payloads = [], []
            for b in range(buckets):
                o = order[edges[b] : edges[b + 1]]
                if len(o):
                    own, local = np.unique(row[o], return_inverse=True)
                    head_ = np.array([len(o), len(own)], np.int64)
                    parts = (head_, context[o], doc[own], mark[own], gram[o].astype(np.uint32), local.astype(np.uint32), anchor[o].astype(np.uint32), (anchor - first)[o].astype(np.uint8), (last - first)[o].astype(np.uint8))
                    payloads.append(b"".join(x.tobytes() for x in parts))
                    numbers.append(b)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(numbers), pa.int64()), pa.nulls(len(numbers), pa.int64()), pa.nulls(len(numbers), pa.binary()), pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], ["doc", "mark", "gone", "bucket", "payload"])

    return run


def _unpacked(payloads):
    out = [[] for _ in range(7)]
    for raw in payloads:
        m, k = np.frombuffer(raw, np.int64, 2)
        at, got = 16, []
        for kind, n in (("u8", m), ("i8", k), ("i8", k), ("u4", m), ("u4", m), ("u4", m), ("u1", m), ("u1", m)):
            got.append(np.frombuffer(raw, kind, n, at))
            at += int(kind[1]) * int(n)
        context, doc, mark, gram, local, anchor, left, wide = got
        for x, y in zip(out, (context, gram, doc[local], mark[local], anchor, left, wide)):
            x.append(y)
    return [np.concatenate(x) for x in out]


def _bucket(got):
    """For each document of a bucket: strings that start earlier in an equal context (gone), and suffixes to compare.

    A gram with several contexts needs the earliest suffix of each compared: packed anchor, first, last and whether the
    gram is hot.
    """
    import pyarrow as pa

    context, gram, doc, mark, anchor, left, wide = _unpacked(got.column("payload").to_pylist())
    order = np.lexsort((anchor, mark, doc, context, gram))
    context, gram, doc, mark, anchor, left, wide = (x[order] for x in (context, gram, doc, mark, anchor, left, wide))
    anchor = anchor.astype(np.int64)
    first = anchor - left
    last = first + wide
    head = np.ones(len(gram), bool)
    head[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    other = (doc != doc[lead]) | (mark != mark[lead]) | (anchor != anchor[lead])
    d, m, gone = _by_document(doc[other], mark[other], first[other], last[other] + SPAN)
    gram, doc, mark, anchor, first, last = (x[head] for x in (gram, doc, mark, anchor, first, last))
    edges = ranges(gram)
    count = np.repeat(np.diff(edges), np.diff(edges))
    keep = count > 1
    doc, mark, hot = doc[keep], mark[keep], count[keep] > HOT
    rows = np.column_stack([anchor[keep], first[keep], last[keep], hot])
    order = np.lexsort((mark, doc))
    doc, mark, rows = doc[order], mark[order], rows[order]
    edges = np.unique(np.concatenate([ranges(doc), ranges(mark)])) if len(doc) else np.zeros(1, np.int64)
    n = len(edges) - 1
    blank = lambda k: pa.nulls(k, pa.binary())
    return pa.table(
        {
            "doc": np.concatenate([d, doc[edges[:-1]] if n else np.zeros(0, np.int64)]),
            "mark": np.concatenate([m, mark[edges[:-1]] if n else np.zeros(0, np.int64)]),
            "gone": pa.concat_arrays([pa.array(gone, pa.binary()), blank(n)]),
            "compare": pa.concat_arrays([blank(len(d)), pa.array([_packed(rows[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())]),
        }
    )


def _contexts(batches):
    """(lead, context, doc, mark, anchor, first) of each suffix to compare; a hot gram gives each string by itself."""
    import pyarrow as pa

    for batch in batches:
        lead, context, out = [], [], []
        for text, doc, mark, lists in zip(*(batch.column(c).to_pylist() for c in ("text", "doc", "mark", "lists"))):
            data = text.encode()
            for anchor, first, last, hot in np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 4) for x in lists]).astype(np.int64).tolist():
                if hot:
                    for p in range(first, last + 1):
                        lead.append(data[p : p + SPAN]), context.append(data[p : p + SPAN]), out.append((doc, mark, anchor, p))
                else:
                    lead.append(data[anchor : anchor + GRAM]), context.append(data[first : last + SPAN]), out.append((doc, mark, anchor, first))
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(lead, pa.binary()), pa.array(context, pa.binary()), *[pa.array(c, pa.int64()) for c in columns]], ["lead", "context", "doc", "mark", "anchor", "first"])


def multikey_order(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order of rows by key, then by words left to right: each word is looked at for rows that are still tied only."""
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if len(order) else order
    tied = np.arange(len(order))
    for k in range(words.shape[1]):
        size = np.bincount(group, minlength=len(order) + 1)
        tied = tied[size[group[tied]] > 1]
        if len(tied) == 0:
            break
        rows = order[tied]
        inner = np.lexsort((words[rows, k], group[tied]))
        order[tied] = rows[inner]
        value, g = words[order[tied], k], group[tied]
        step = np.zeros(len(tied), np.int64)
        step[1:] = (g[1:] == g[:-1]) & (value[1:] != value[:-1])
        new = np.zeros(len(order), np.int64)
        new[tied] = step
        starts = np.ones(len(order), np.int64)
        starts[0] = 0
        starts[1:] = (group[1:] != group[:-1]) | (new[1:] > 0)
        group = np.cumsum(starts)
    return order


def _classes(matrix: np.ndarray, key: np.ndarray):
    """For byte rows within equal keys: a function from a length to the class of each row's prefix of that length."""
    wide = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), wide), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    order = multikey_order(padded.view(">u8"), key)
    same = key[order][1:] == key[order][:-1]
    differ = matrix[order][1:] != matrix[order][:-1]
    common = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    common = np.where(same, common, -1)

    def at(length: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(common < length)])
        return out

    return at


def later_strings(lead: list[bytes], context: list[bytes], doc, mark, anchor, first):
    """(doc, mark, start, end) of all strings in the contexts that start earlier in another one with the same lead.

    Suffixes are sorted from the anchor on, and what precedes it is sorted backwards; two strings with the anchor at
    offset o are equal if they share the class of o bytes back and of SPAN - o bytes on.
    """
    n = len(lead)
    _, key = np.unique(np.array(lead, object), return_inverse=True)
    left = anchor - first
    right = np.array([len(c) for c in context]) - left
    ahead, back = np.zeros((n, SPAN), np.uint8), np.zeros((n, WIDTH - 1), np.uint8)
    raw = np.frombuffer(b"".join(context), np.uint8)
    start = np.concatenate([[0], np.cumsum(left + right)])[:-1] + left
    for j in range(SPAN):
        on = right > j
        ahead[on, j] = raw[start[on] + j]
    for j in range(WIDTH - 1):
        on = left > j
        back[on, j] = raw[start[on] - 1 - j]
    ahead_class, back_class = _classes(ahead, key), _classes(back, key)
    order = np.lexsort((anchor, mark, doc))
    flags = np.zeros((n, WIDTH + 2), np.int8)
    for o in range(WIDTH):
        rows = order[(left[order] >= o) & (right[order] >= SPAN - o)]
        if len(rows) > 1:
            both = ahead_class(SPAN - o)[rows] * (n + 1) + back_class(o)[rows]
            by = np.argsort(both, kind="stable")
            later = np.zeros(len(rows), bool)
            later[1:] = both[by][1:] == both[by][:-1]
            flags[rows[by[later]], o + 1] = 1
    edge = np.diff(flags, axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return doc[row], mark[row], anchor[row] - high + 1, anchor[row] - low + SPAN


def _compared(batches):
    import pyarrow as pa

    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if tables:
        got = pa.concat_tables(tables)
        where = np.column_stack([got.column(c).to_numpy() for c in ("doc", "mark", "anchor", "first")])
        got = got.take(np.sort(np.unique(where, axis=0, return_index=True)[1]))  # repeated rows bring their suffixes again
        d, m, gone = _by_document(*later_strings(got.column("lead").to_pylist(), got.column("context").to_pylist(), *(got.column(c).to_numpy() for c in ("doc", "mark", "anchor", "first"))))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(m), pa.array(gone, pa.binary())], ["doc", "mark", "gone"])


def _kept(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for text, lists in zip(batch.column("text").to_pylist(), batch.column("lists").to_pylist()):
            data = text.encode()
            if lists:
                cut = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in lists]).astype(np.int64)
                start, end = _united(cut[:, 0], cut[:, 1])
                at, kept = 0, []
                for a, b in zip(start.tolist(), end.tolist()):
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), len(start), hashlib.sha256(rest).hexdigest()))
            else:
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), batch.column("mark"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["doc_id", "doc", "mark", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc, mark, lists: packed byte intervals of each document that are covered by strings which also start earlier.

    docs(doc, mark, text) has the order of documents as (doc, mark). Equal strings choose the same anchor, so comparing
    the anchored suffixes of one gram (with what precedes them) finds all repeats: about one suffix in 35 bytes.
    1. Each batch hashes its anchors' contexts; the earliest of equal contexts stays, other strings of them are repeats.
    2. Suffixes meet in buckets by gram, as hashes and places: the same between batches. Grams with one context go.
    3. The contexts of the others are range-partitioned by their leading bytes (splitters sampled by Spark), sorted in
       each range by a multikey sort forwards and backwards, and compared. Equal leading bytes never straddle a boundary;
       strings of a gram with more than HOT contexts are dealt out one by one, by all their bytes.
    """
    buckets = max(16, docs.rdd.getNumPartitions())
    first = saved(docs.mapInArrow(_suffixes(buckets), SUFFIXES))
    second = saved(first.filter(F.col("bucket").isNotNull()).select("bucket", "payload").groupBy("bucket").applyInArrow(_bucket, "doc long, mark long, gone binary, compare binary"))
    compare = second.filter(F.col("compare").isNotNull())
    lists = compare.groupBy("doc", "mark").agg(F.collect_list("compare").alias("lists"))
    size = compare.agg(F.sum(F.length("compare") + 48)).first()[0] or 0
    lists = F.broadcast(lists) if size <= BROADCAST else lists
    contexts = docs.join(lists, ["doc", "mark"]).select("text", "doc", "mark", "lists").mapInArrow(_contexts, "lead binary, context binary, doc long, mark long, anchor long, first long")
    third = saved(contexts.repartitionByRange("lead").mapInArrow(_compared, "doc long, mark long, gone binary"))
    gone = first.filter(F.col("gone").isNotNull()).select("doc", "mark", "gone").unionByName(second.filter(F.col("gone").isNotNull()).select("doc", "mark", "gone")).unionByName(third)
    return gone.groupBy("doc", "mark").agg(F.collect_list("gone").alias("lists"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each text's bytes without strings of SPAN bytes that start earlier.

    Earlier means a smaller doc_id (null last; texts of one doc_id by their hash), or the same document and an earlier
    start. A null text is empty; of repeated rows (doc_id and text) one is judged as it stands and all bytes of the
    others are repeats, if they have SPAN bytes; other columns are ignored; an empty table gives no rows.
    """
    own = docs.select("doc_id", text_of().alias("text"))
    own = own.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("mark", F.xxhash64("text"))
    gone = repeats(own.select("doc", "mark", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = own.join(gone, ["doc", "mark"], "left").select("doc_id", "doc", "mark", "text", "lists")
    out = joined.mapInArrow(_kept, f"doc_id {kind}, doc long, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    again = (F.row_number().over(Window.partitionBy("doc", "mark").orderBy("n_bytes")) > 1) & (F.col("n_bytes") >= SPAN)
    out = out.withColumn("again", again)
    return out.select(
        "doc_id", "n_bytes", F.when(F.col("again"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("again"), F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(F.col("again"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op9_query(spark, sf_dir):
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
