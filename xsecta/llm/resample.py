"""Target-distribution importance resampling of documents, over an integer dictionary of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, row_chunks, saved, shuffled, text_batch, text_of

#: Words of the longest feature, buckets of the hash, seed of the draw, least words of a drawn document, documents drawn in per cent.
GRAMS, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of text of a block, whose words share one list; a longer text is a block of its own.
BLOCK = 8 << 20
#: Digits and letters, and all bytes of other characters.
_SOLID = np.zeros(256, bool)
_SOLID[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True

BLOCKS = "block long, target boolean, docs array<long>, sizes binary, tokens binary, words array<string>"
GRAMMED = "block long, target boolean, docs array<long>, n binary, sizes binary, place binary, times binary, grams array<array<long>>, counts array<long>"


def _words(data: np.ndarray, offsets: np.ndarray):
    """All words of all rows as an Arrow array, and the n + 1 offsets of each row's words."""
    import pyarrow as pa

    low = lower_ascii(data)
    solid = _SOLID[low] if len(low) else np.zeros(0, bool)
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]
    begins[inner], ends[inner - 1] = solid[inner], solid[inner - 1]  # words never cross rows
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    kept = low[solid]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(kept))
    return words, np.searchsorted(starts, offsets)


def _packed(x: np.ndarray) -> bytes:
    """x as 32-bit numbers, first all lowest bytes and last all highest ones: small numbers compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(target: bool):
    """One row for each block of texts: its documents, their words as places in the block's list, and that list."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for data, offsets in row_chunks(*text_batch(batch.column("text")), BLOCK):
                rows = len(offsets) - 1
                words, at = _words(data, offsets)
                coded = words.dictionary_encode()
                token = coded.indices.to_numpy(zero_copy_only=False)
                often = np.argsort(-np.bincount(token, minlength=len(coded.dictionary)), kind="stable")
                place = np.empty(len(often), np.int64)
                place[often] = np.arange(len(often))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([2 * number + target], pa.int64()),
                        pa.array([target]),
                        pa.array([batch.column("doc_id").slice(done, rows).to_pylist()], pa.list_(pa.int64())),
                        pa.array([_packed(np.diff(at))], pa.binary()),
                        pa.array([_packed(place[token])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(often)], pa.int32()), coded.dictionary.take(pa.array(often)).cast(pa.string())),
                    ],
                    ["block", "target", "docs", "sizes", "tokens", "words"],
                )
                done, number = done + rows, number + 1

    return run


def _grams(longest: int):
    """For each block, its distinct runs of up to longest words as tuples of ids, how often each occurs, and each document's."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.asarray(batch.column("ids")[i].values, np.int64)
                sizes, tokens = (_unpacked(batch.column(c)[i].as_py()) for c in ("sizes", "tokens"))
                rows = len(sizes)
                doc = np.repeat(np.arange(rows), sizes)
                prefix, grams, codes, docs, known = tokens, [], [], [], 0
                for k in range(longest):
                    if k:  # a run is the run without its last word, and that word
                        whole = doc[k:] == doc[: len(doc) - k] if len(doc) > k else np.zeros(0, bool)
                        prefix = np.where(whole, prefix[: len(whole)] * len(ids) + tokens[k:], -1)
                    good = np.flatnonzero(prefix >= 0)
                    _, first, code = np.unique(prefix[good], return_index=True, return_inverse=True)
                    grams.append(ids[tokens[good[first][:, None] + np.arange(k + 1)]])
                    codes.append(code + known), docs.append(doc[good])
                    full = np.full(len(prefix), -1, np.int64)
                    full[good] = code  # small numbers again, so the next product stays exact
                    prefix, known = full, known + len(first)
                code, doc_of = np.concatenate(codes), np.concatenate(docs)
                pair, times = np.unique(doc_of * max(known, 1) + code, return_counts=True)
                owner = pair // max(known, 1)
                counts = np.bincount(code, minlength=known)
                ends = np.cumsum(np.concatenate([[0], *(np.full(len(g), g.shape[1]) for g in grams)]))
                tuples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([g.ravel() for g in grams]), pa.int64()))
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("block").slice(i, 1), batch.column("target").slice(i, 1), batch.column("docs").slice(i, 1),
                        pa.array([_packed(np.bincount(doc_of, minlength=rows))], pa.binary()),
                        pa.array([_packed(np.bincount(owner, minlength=rows))], pa.binary()),
                        pa.array([_packed(pair - owner * max(known, 1))], pa.binary()),
                        pa.array([_packed(times)], pa.binary()),
                        whole(tuples),
                        whole(pa.array(counts, pa.int64())),
                    ],
                    ["block", "target", "docs", "n", "sizes", "place", "times", "grams", "counts"],
                )

    return run


def _weights(batches):
    """(doc_id, n_features, weight) of each block's documents, from the gains of its tuples in order."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            n, sizes, place, times = (_unpacked(batch.column(c)[i].as_py()) for c in ("n", "sizes", "place", "times"))
            gains = np.asarray(batch.column("gains")[i].values, np.int64)
            sums = np.concatenate([[0], np.cumsum(gains[place] * times)]) if len(place) else np.zeros(1, np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            total = sums[at[1:]] - sums[at[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("docs")[i].values, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])


def _listed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(block, name): the values of each block's places in order; as many as the block's list, which BLOCK bounds."""
    return rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", value))).alias("__v")).select("block", F.col(f"__v.{value}").alias(name))


def bucket_gain(s: Column, t: Column, all_s: Column, all_t: Column, buckets: int) -> Column:
    """1000 times the logarithm of the ratio of both smoothed shares of a bucket, floored."""
    d = lambda c: c.cast("double")
    return F.floor(1000 * F.ln((d(t) + 1) * (d(all_s) + buckets) / ((d(s) + 1) * (d(all_t) + buckets)))).cast("long")


def weights(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features and weight of each document: how much likelier its features are in target than in docs.

    1. Texts are cut into words by blocks of up to BLOCK bytes; a block keeps each word once and its documents as places
       in that list, so from here on words are shuffled once a block and not once an occurrence.
    2. The distinct words of all blocks get integer ids: the dictionary, a written table. Each block's list is joined with
       it and becomes a list of ids.
    3. A block's runs of up to grams words are tuples of ids, counted within it. Summed over all blocks, each distinct
       tuple comes once; its text is put together from the dictionary, and its bytes are hashed to a bucket once.
    4. Buckets' counts give gains, at most buckets rows. They are joined to the tuples, the tuples back to the blocks, and
       each document's gains are averaged there.

    A null or empty text, or one without words, has no feature and weight 0. Very long texts are whole: one block. Repeated
    rows and repeated or null doc_ids count each; other columns are ignored; an empty table of documents gives no rows,
    an empty target counts as no feature.
    """
    cut = lambda df, flag, id_: df.select(id_.cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_blocks(flag), BLOCKS)
    blocks = saved(cut(docs, False, F.col("doc_id")).unionByName(cut(target, True, F.lit(0))))
    listed = blocks.select("block", F.posexplode("words").alias("place", "word"))
    dictionary = saved(listed.select("word").distinct().withColumn("id", F.monotonically_increasing_id()))
    ids = _listed(listed.join(shuffled(dictionary), "word").select("block", "place", "id"), "id", "ids")
    known = blocks.drop("words").join(shuffled(ids), "block", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
    counted = saved(known.mapInArrow(_grams(grams), GRAMMED))
    side = lambda flag: F.sum(F.when(F.col("target") == flag, F.col("v.counts")).otherwise(0))
    tuples = counted.select("target", F.explode(F.arrays_zip("grams", "counts")).alias("v")).groupBy(F.col("v.grams").alias("gram")).agg(side(False).alias("s"), side(True).alias("t"))
    if grams == 1:
        spelled = tuples.withColumn("id", F.col("gram")[0]).join(shuffled(dictionary), "id").withColumnRenamed("word", "bytes")
    else:
        places = tuples.select("gram", "s", "t", F.posexplode("gram").alias("place", "id")).join(shuffled(dictionary), "id")
        spelled = places.groupBy("gram").agg(F.first("s").alias("s"), F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")).withColumn("bytes", F.array_join(F.col("w.word"), " "))
    hashed = saved(spelled.select("gram", "s", "t", (F.crc32(F.encode("bytes", "UTF-8")) % buckets).alias("bucket")))
    sums = hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    gains = sums.crossJoin(F.broadcast(totals)).select("bucket", bucket_gain(F.col("s"), F.col("t"), F.col("all_s"), F.col("all_t"), buckets).alias("gain"))
    own = hashed.join(F.broadcast(gains), "bucket").select("gram", "gain")
    back = counted.filter("not target").select("block", F.posexplode("grams").alias("place", "gram")).join(shuffled(own), "gram").select("block", "place", "gain")
    met = counted.filter("not target").drop("grams", "counts", "target").join(shuffled(_listed(back, "gain", "gains")), "block", "left")
    met = met.withColumn("gains", F.coalesce("gains", F.array().cast("array<long>")))
    return met.mapInArrow(_weights, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A draw of the standard Gumbel distribution, fixed by seed and doc_id, times 1000 and floored; a null id is empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document: drawn without replacement in proportion to exp(weight).

    The score is the weight plus noise() of the doc_id. Of the N documents with at least `least` words, the floor(percent *
    N / 100) of the highest scores are drawn; ties go to the smaller doc_id (null first), then to fewer features. Others
    have no rank. See weights() for texts without words, nulls, repeats and empty tables.

    No order of all documents is made: scores are integers within a bounded range, so their counts from the top, a row a
    score, tell where each score's ranks begin, and only documents of one score are ordered among each other. Rows that are
    equal in all columns are one row with its number there, so copies of one doc_id in any number are no hot group.
    """
    words = F.col("n_features") if grams == 1 else F.floor((F.col("n_features") + grams * (grams - 1) / 2) / grams).cast("long")
    scored = weights(docs, target, grams, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    same = saved(scored.groupBy("doc_id", "n_features", "weight", "score").agg(F.count("*").alias("copies")))
    fit = same.filter(words >= least)
    per_score = fit.groupBy("score").agg(F.sum("copies").alias("here"))
    above = F.sum("here").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_score.withColumn("above", F.coalesce(above, F.lit(0))).withColumn("drawn", F.floor(F.lit(percent) * F.sum("here").over(Window.partitionBy()) / 100))
    offsets = offsets.filter("above < drawn").select("score", "above", "drawn")
    order = Window.partitionBy("score").orderBy("doc_id", "n_features").rowsBetween(Window.unboundedPreceding, 0)
    ranked = fit.join(F.broadcast(offsets), "score").withColumn("last", F.col("above") + F.sum("copies").over(order))
    ranks = ranked.select("doc_id", "n_features", "weight", "score", F.col("last") - F.col("copies") + 1, F.least("last", "drawn")).toDF("d", "n", "w", "sc", "first", "upto")
    met = same.join(shuffled(ranks.filter("first <= upto")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("n_features") == F.col("n")) & (F.col("weight") == F.col("w")) & (F.col("score") == F.col("sc")), "left")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    rank = F.col("first") + F.col("copy")
    return met.withColumn("copy", each).select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("upto"), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs with all their columns, and their __rank; options as in importance().

    doc_id names a row here; of rows that share one, or have none, each is kept if one of them is drawn.
    """
    drawn = importance(docs, target, **options).filter("rank is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("rank").alias("__rank"))
    return docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))).drop("__id")


def op11_query(spark, sf_dir):
    return importance(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# crc32 of the UTF-8 bytes of each word, from the 256 remainders of the polynomial 0xEDB88320
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS r FROM bits WHERE k = 8),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w, false AS tgt FROM documents
  UNION ALL
  SELECT 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), true FROM benchmark),
hexes AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x), 2), lambda p: CAST((instr('0123456789ABCDEF', x[p]) - 1) * 16 + instr('0123456789ABCDEF', x[p + 1]) - 1 AS BIGINT))),
                lambda a, b: xor(a >> 8, r[xor(a & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM hexes CROSS JOIN remainders),
buckets AS (SELECT bucket, count(*) FILTER (NOT tgt) AS s, count(*) FILTER (tgt) AS t FROM words JOIN hashed USING (w) GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM buckets),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE NOT tgt GROUP BY 1),
drawn AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(g AS DOUBLE) / n), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM drawn),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored s LEFT JOIN ranks ON ranks.doc_id = s.doc_id
"""
