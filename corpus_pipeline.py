"""Corpus pipeline: quality, near duplicates, personal data, source mix and tokens, in this order.

Each stage gets what the one before it kept. When it starts, scratch tables that no DataFrame reads any more are deleted, so
those of a stage go once its result is written and dropped, and results that are still held stay whole. All stages take
null texts as empty, keep extra columns as they are and give no rows for an empty table.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from xsecta.llm import bpe, common, jaccard, mixing, pii, quality


def stage(function):
    """A stage that sweeps before it starts."""

    @wraps(function)
    def run_stage(spark, docs, sf_dir):
        common.sweep(spark)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def keep_good(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject (score of at least 0.3).

    The score depends on the text alone, so repeated rows, and rows with a null or repeated doc_id, stay or go alike; an
    empty text has the score of the bias.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, docs.columns).filter(F.col("score") >= 0.3).select(*docs.columns)


@stage
def one_of_each(spark, docs, sf_dir):
    """Of documents that are linked by 0.8 or more of their word shingles, the one of the smallest doc_id.

    If a doc_id is null or repeated, rows are told apart by a hash of doc_id and text instead, and of each group the row
    with the smallest hash stays; rows that are equal in both are one document, of which the first by its other columns
    stays. Rows without words are linked with nothing and all stay.
    """
    unclear = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count() > 0
    number = F.xxhash64("doc_id", common.text_of()) if unclear else F.col("doc_id").cast("long")
    numbered = docs.select(number.alias("__number"), F.struct(*docs.columns).alias("__row"))
    found = common.saved(jaccard.link(docs.select(number.alias("doc_id"), "text")))
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__number")).distinct()
    kept = numbered.join(common.small(gone, jaccard.BROADCAST), "__number", "left_anti")
    if unclear:
        twice = common.small(found.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__number")), jaccard.BROADCAST)
        first = kept.join(twice, "__number", "left_semi").groupBy("__number").agg(F.min("__row").alias("__row"))
        kept = kept.join(twice, "__number", "left_anti").unionByName(first)
    return kept.select("__row.*")


@stage
def redacted(spark, docs, sf_dir):
    """All documents, with each span of personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs, docs.columns)


@stage
def mixed(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it; the one at a source's cut is taken whole.

    Documents without words are part of no mix and go. A null source is one of its own; a row with a null or repeated
    doc_id counts for itself, and rows that are equal in all columns are taken as often as their number says.
    """
    return mixing.mixed(docs)


@stage
def encoded(spark, docs, sf_dir):
    """n_tokens and digests of the ids and of the decoded text of each document, one row for each row."""
    return bpe.encode_documents(docs, bpe.default_tokenizer())


STAGES = [("quality", keep_good), ("near_duplicates", one_of_each), ("pii", redacted), ("mixing", mixed), ("bpe", encoded)]

#: The stages' models, searches and tokens have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = common.saved(function(spark, docs, sf_dir))
    common.sweep(spark)
    return docs
