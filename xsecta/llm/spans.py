"""Regex matches with code-point offsets, as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths that one inner fold of running() adds up.
RUN = 256


def running(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of ints, in runs of RUN so that long arrays aren't copied for each element."""
    start = F.lit(0).cast("int")
    block = lambda b: F.slice(lengths, b * RUN + 1, F.lit(RUN))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))), block)
    sums = F.transform(blocks, lambda b: F.aggregate(b, start, lambda a, x: a + x))
    offsets = F.aggregate(sums, F.array(start), add)
    inner = F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.element_at(offsets, i + 1)), add), F.lit(1), F.size(b)))
    return F.flatten(inner)


def with_matches(df: DataFrame, name: str, pattern: str, only: Column, text: str = "text", context: int = 48) -> DataFrame:
    """Add name: array of (start, end, value, before, after) of the leftmost non-overlapping matches of pattern.

    Offsets are in code points, end exclusive: the pieces between matches come from splitting by the same pattern, and
    their lengths give the places. before and after are up to context characters around a match, within the pieces. only
    is a cheap test that texts without any match fail.
    """
    empty = F.array().cast("array<string>")
    found, gaps, starts = f"__{name}_found", f"__{name}_gaps", f"__{name}_starts"
    df = df.withColumn(found, F.when(only, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, F.lit(pattern), -1)).otherwise(empty))
    lengths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(F.col(gaps), i)))
    df = df.withColumn(starts, F.when(F.size(found) > 0, running(lengths)).otherwise(F.array().cast("array<int>")))
    one = lambda m, i: F.struct(
        (F.get(F.col(starts), i) + F.length(F.get(F.col(gaps), i))).alias("start"),
        (F.get(F.col(starts), i) + F.length(F.get(F.col(gaps), i)) + F.length(m)).alias("end"),
        m.alias("value"),
        F.right(F.get(F.col(gaps), i), F.lit(context)).alias("before"),
        F.left(F.get(F.col(gaps), i + 1), F.lit(context)).alias("after"),
    )
    return df.withColumn(name, F.transform(found, one)).drop(found, gaps, starts)


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each of spans(start, end, kind as place in kinds), by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
