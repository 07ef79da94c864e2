"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small, text_of, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents of one range of a source, about.
BIN_ROWS = 4_000
WORD = r"[^\x20\x09-\x0D]"


def source_targets(totals: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets in words for totals(skey, source, source_size): weights repeat over the sources by code point, null last.

    All targets together are the sum of all sizes. Water-filling: in order of size per weight, a source is capped at
    cap times its size while its share at the level reached so far is above that; the others share the rest by weight.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    named = totals.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * F.lit(cap).cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    tried = named.withColumn("level", level).withColumn("capped", F.col("most") < F.col("weight") * F.col("level"))
    final = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("source_size") / F.col("weight"))).over(everything)
    return tried.withColumn("final", final).select(
        "skey", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target")
    )


def document_key():
    """The hash-random key of a row: of doc_id, or of the text where that is null."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(text_of()))))


def _placed(docs: DataFrame, weights, cap: int, bin_rows: int, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources' targets, the documents outside the bins that a cut falls into, and those inside them.

    All documents have base, the words of whole epochs and, below the cut, of the last one. Those inside have upto, the
    words before the document in its bin, and rest, what of the budget is left for the bin.
    """
    sized = saved(
        docs.select(*keep, F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"), document_key().alias("key"))
        .withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .drop("source")
    )
    named = F.when(F.col("skey") != "n", F.expr("substring(skey, 2)"))
    totals = saved(sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).withColumn("source", named))
    targets = source_targets(totals, weights, cap).join(totals.select("skey", F.ceil(F.col("rows") / bin_rows).alias("bins")), "skey")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = saved(targets.withColumn("epochs", epochs).withColumn("over", budget - epochs * F.col("source_size")))
    place = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("bins"), 32).alias("bin")
    binned = sized.join(small(targets.select("skey", "bins")), "skey").select(*sized.columns, place)
    here = binned.groupBy("skey", "bin").agg(F.sum("size").alias("here"))
    upto = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = here.withColumn("offset", F.coalesce(F.sum("here").over(upto), F.lit(0))).join(targets, "skey")
    plan = saved(plan.withColumn("rest", F.col("over") - F.col("offset")).select("skey", "bin", "source_size", "target", "epochs", "rest", "here"))
    known = binned.join(small(plan), ["skey", "bin"])
    within = (F.col("rest") > 0) & (F.col("rest") < F.col("here"))
    known = known.withColumn("within", within).withColumn("base", F.col("size") * (F.col("epochs") + ((F.col("rest") >= F.col("here")) & (F.col("here") > 0)).cast("long")))
    inside = Window.partitionBy("skey", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = known.filter("within").withColumn("upto", F.sum("size").over(inside) - F.col("size"))
    return targets, known.filter("not within"), cut


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, bin_rows: int = BIN_ROWS) -> DataFrame:
    """How many words of each document a mix of all sources at target weights takes.

    Documents get the hash-random key md5(doc_id) (of the text, where doc_id is null). (source, leading bits of the key)
    are the ranges, one for about bin_rows documents: keys are uniform, so equal key ranges are equal shares, whatever
    the source's size, and need no sampling. Prefix sums over the ranges' totals give every range its place in its
    source, and the source is cut at floor(target) words, after whole epochs if the target exceeds its size. Only the one
    range of a source that the cut falls into is sorted and summed document by document.

    Returns doc_id, size, source_size, target, taken. Null or empty texts have size 0 and give 0 words; a null source is
    a source of its own; rows with equal doc_id are taken as they come by size; an empty table gives no rows; other
    columns are ignored. Targets need one order of all sources, so their table, one row a source, is sorted in one task.
    """
    _, whole, cut = _placed(docs, weights, cap, bin_rows, ["doc_id"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto")))
    columns = ["doc_id", "size", "source_size", "target"]
    return whole.select(*columns, F.col("base").alias("taken")).unionByName(cut.select(*columns, (F.col("base") + extra).cast("long").alias("taken")))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, the one at a source's cut whole.

    No text is shuffled: a row's number of copies follows from its own key and the place of its source's cut, one row a
    source. Only rows with the key and doc_id of the row at the cut are counted out, by size and all their columns.
    Documents without words are not part of any mix.
    """
    targets, whole, cut = _placed(docs, weights, cap, bin_rows, ["doc_id"])
    own = F.struct("key", F.col("doc_id").alias("id"))
    last = cut.filter((F.col("size") > 0) & (F.col("rest") > F.col("upto"))).select("skey", own.alias("at"))
    ends = last.groupBy("skey").agg(F.max("at").alias("top"))
    ends = last.join(ends, "skey").groupBy("skey").agg(F.max("top").alias("at"), F.sum((F.col("at") == F.col("top")).cast("long")).alias("more"))
    done = whole.groupBy("skey").agg(F.max(F.when(F.col("base") > F.col("epochs") * F.col("size"), own)).alias("below"))
    plans = small(saved(targets.select("skey", "epochs").join(done, "skey", "left").join(ends, "skey", "left")))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_of().alias("text"), document_key().alias("key"), source.alias("skey"))
    known = keyed.filter(F.col("text").rlike(WORD)).join(plans, "skey").withColumn("own", own)
    edge = F.coalesce(F.col("own") == F.col("at"), F.lit(False))
    extra = F.coalesce(F.col("own") <= F.coalesce("at", "below"), F.lit(False)).cast("long")
    plain = known.filter(~edge).select("row", (F.col("epochs") + extra).alias("copies"))
    tied = known.filter(edge).groupBy("skey", "row").agg(F.count("*").alias("n"), F.max("epochs").alias("epochs"), F.max("more").alias("more"), F.max(word_count(F.col("text"))).alias("size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("size", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = tied.select("row", (F.col("epochs") * F.col("n") + F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - before))).alias("copies"))
    copies = plain.unionByName(tied).filter("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op5_query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, '')))) AS k
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS pos
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM totals),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM weighted
  WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (
  SELECT min_by(level, CAST(source_size AS DOUBLE) / w) AS level FROM levels WHERE NOT (3 * source_size < w * level)),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN 3 * l.source_size < l.w * l.level THEN CAST(3 * l.source_size AS DOUBLE) ELSE l.w * f.level END AS target
  FROM levels l CROSS JOIN final f),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
