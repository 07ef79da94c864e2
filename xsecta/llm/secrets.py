"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_sample, saved, text_of
from .spans import listed, with_matches

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]
VALUE = r"[A-Za-z0-9+/_.=-]++"
PATTERNS = {
    "assign": r"(?=[pPsStTaA])((?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?(" + VALUE + ")",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
    # a run of key characters, from the run's start
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+",
}
#: Characters of the models, in the order of their indexes.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Labelled strings of each kind that the models are fitted on at most (in expectation), and documents they come from.
SAMPLE, SAMPLE_DOCS = 20_000, 4_000
#: Classes of labelled strings: ordinary identifiers, and random strings by alphabet, as most of them are hexadecimal.
ORDINARY, CLASSES = 0, {"hex": 1, "assign": 2, "access": 2}
#: Transitions that a character's prior stands for, and added to each character's count in it.
PRIOR, SMOOTH = 8.0, 0.5
#: Log-likelihood ratio from which a string counts as random: on average over its transitions, and in all.
RATIO, LEAST = 0.7, 9.0


def transitions(samples: DataFrame) -> DataFrame:
    """Counts n of neighbouring characters two, by label, of samples(value, label): at most 68 ** 2 rows a label."""
    pairs = samples.filter(F.length("value") >= 2).select("label", F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("two"))
    known = F.lit(ALPHABET)
    inside = (F.instr(known, F.substring("two", 1, 1)) > 0) & (F.instr(known, F.substring("two", 2, 1)) > 0)
    return pairs.groupBy("label", "two").agg(F.count("*").alias("n")).filter(inside)


def train(samples: DataFrame) -> dict[int, list[float]]:
    """By class of random strings: the log-likelihood ratio of each transition, random over ordinary.

    samples(value, label): label ORDINARY are identifiers, other labels classes of random strings; transitions are in the
    order 68 * index(first) + index(second). All models are first-order Markov chains; a transition's probability is that
    of its counts and of PRIOR further ones dealt by how frequent the second character is in its class, so a class with few
    samples is told by its characters. A class without any sample is uniform.
    """
    size = len(ALPHABET)
    labels = [ORDINARY, *sorted(set(CLASSES.values()))]
    counts = {k: [[0.0] * size for _ in range(size)] for k in labels}
    for r in transitions(samples).collect():
        if r.label in counts:
            counts[r.label][ALPHABET.index(r.two[0])][ALPHABET.index(r.two[1])] += r.n
    logs = {}
    for k, rows in counts.items():
        single = [SMOOTH + sum(row[b] for row in rows) for b in range(size)]
        whole = sum(single)
        logs[k] = [math.log((row[b] + PRIOR * single[b] / whole) / (sum(row) + PRIOR)) for row in rows for b in range(size)]
    return {k: [x - y for x, y in zip(logs[k], logs[ORDINARY])] for k in labels if k != ORDINARY}


def ratio(value: Column, weights: list[float]) -> Column:
    """Sum of log-likelihood ratios over the transitions of value."""
    table = F.expr("cast(split('" + ",".join(f"{w:.5f}" for w in weights) + "', ',') as array<double>)")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1
    step = lambda total, i: total + F.coalesce(F.get(table, place(i) * len(ALPHABET) + place(i + 1)), F.lit(0.0))
    return F.when(F.length(value) > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), F.lit(0.0), step)).otherwise(0.0)


def is_random(value: Column, weights: dict[int, list[float]]) -> Column:
    """Whether the best of the classes beats ordinary identifiers by RATIO a transition and by LEAST in all."""
    best = F.greatest(*[ratio(value, w) for w in weights.values()], F.lit(float("-inf")))
    return (best >= RATIO * (F.length(value) - 1)) & (best >= LEAST)


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and found: array of (kind, start, end, value); value is the part that would be the secret."""
    text = F.col("__text")
    tests = {
        "assign": text.rlike(r"(?i)(?=[pstak])(passw|secret|token|api_?key)"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{16}"),
        "random": text.rlike(r"[A-Za-z0-9+/_=-]{12}"),
    }
    df = docs.select(*keep, text_of().alias("__text"))
    for kind in KINDS:
        df = with_matches(df, f"__{kind}", PATTERNS[kind], tests[kind], "__text")
        df = df.withColumn(f"__{kind}", F.filter(F.transform(f"__{kind}", _described(kind)), lambda s: F.length(s["value"]) >= 12))
    return df.select(*keep, F.concat(*[f"__{k}" for k in KINDS]).alias("found"))


def _described(kind: str):
    value = lambda s: F.regexp_extract(s["value"], PATTERNS["assign"], 2) if kind == "assign" else s["value"]
    return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value"))


def of_kind(i: int):
    return lambda s: s["kind"] == i


def labelled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """samples(value, label) from the corpus itself.

    What the base patterns find is random, by class; words that start with a letter are ordinary, those with digits if they
    are shorter than any candidate. Random strings are chosen by hash so that about SAMPLE of each class stay, ordinary ones
    from about SAMPLE_DOCS documents.
    """
    kinds = F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (BASE.index(k), v)])
    hits = found.select(F.explode("found").alias("s")).filter(F.col("s.kind") < len(BASE)).select("s.value", F.element_at(kinds, F.col("s.kind")).alias("label"))
    share = {r.label: min(1.0, SAMPLE / r["count"]) for r in hits.groupBy("label").count().collect()}
    chosen = F.lit(False)
    for k, v in share.items():
        chosen = chosen | ((F.col("label") == k) & in_sample("value", v))
    some = docs.select("doc_id", text_of().alias("text")).filter(in_sample(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), min(1.0, SAMPLE_DOCS / max(1, found.count()))))
    word = r"(?<![A-Za-z0-9+/_.=-])(?:[A-Za-z][A-Za-z_-]{3,}+|[A-Za-z][A-Za-z0-9_-]{3,10}+)(?![A-Za-z0-9+/_=-]|\.[A-Za-z0-9])"
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(word), F.lit(0))).alias("value"))
    return hits.filter(chosen).unionByName(words.withColumn("label", F.lit(ORDINARY)))


def find(docs: DataFrame, weights: dict[int, list[float]] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (kind:start:end, joined) and spans of every whole text.

    One pass finds the base matches and all runs of 12 key characters or more. A run that isn't part of a base match is a
    secret of kind random if is_random() says so; it may hold a base match. weights come from train(); if they are not
    given, the models are trained on labelled() samples of docs. Null texts are empty; repeated rows stay; an empty table
    gives no rows; other columns are ignored.
    """
    table = saved(candidates(docs, ["doc_id"]))
    weights = weights or train(labelled(docs, table))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    apart = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    more = F.filter("found", lambda s: (s["kind"] == len(BASE)) & apart(s) & is_random(s["value"], weights))
    table = table.withColumn("base", base).withColumn("more", F.when(F.exists("found", lambda s: s["kind"] == len(BASE)), more).otherwise(F.slice("found", 1, 0)))
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return table.select("doc_id", *counts, listed(F.col("base"), KINDS).alias("base"), listed(F.concat("base", "more"), KINDS).alias("spans"))


def op6_query(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
