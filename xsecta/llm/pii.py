"""Personal data by weak supervision: labelers vote, EM weighs them, and a span classifier learns from the outcome."""

from __future__ import annotations

import json
import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of
from .spans import listed, with_matches

BASE = ["email", "ip", "card", "phone"]
#: Further kinds that the classifier may add: obfuscated addresses, and numbers without the base patterns' marks.
ADDED = ["email_like", "number_like"]
KINDS = BASE + ADDED

# Possessive quantifiers and look-behinds keep long runs linear without changing any match: a match starts where a run
# does, or right where the match before ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_like": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[({](?i:at)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?i:dot)[\])}])\x20?[A-Za-z0-9-]++)++",
    "number_like": r"[0-9(+][0-9().+\x20-]*[0-9]",
}

# Fixed values of the labelers: gazetteers and context words in the corpus's languages.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
PRIVATE = r"^(0|10|127|169\.254|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
COUNTRIES = r"^\+(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
NEAR = {
    "email": r"(?i)(mail|contact|write to|kontakt|schreib|courriel|correo|escrib)",
    "ip": r"(?i)(\bip\b|server|host|address|adresse|direcci|logged|login)",
    "card": r"(?i)(card|visa|master|amex|credit|karte|carte|tarjeta|iban|account|konto)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|anruf|handy|appel|llam|m[oó]vil)",
}
NEAR |= {"email_like": NEAR["email"], "number_like": NEAR["phone"][:-1] + r"|ssn|social security|passport|konto|account|tax id)"}
AWAY = r"(?i)(version|isbn|page|seite|figure|section|chapter|order|invoice|article|total|price|sum|year|\bv\.?|\bno\.?|[$€£%])\W*$"

#: Rounds of EM; smoothing of all counts; posterior from which the classifier adds a span.
ROUNDS, SMOOTH, ADD_FROM = 15, 1.0, 0.9
#: EM ends when no rate moves by this much.
STILL = 0.002
VOTERS = ["regex", "gazetteer", "context", "shape"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The contract's test of a match; failing matches are dropped."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_extract(p, "0*([0-9]{1,3})$", 1).cast("int"), F.lit(0)) <= 255))
    n = F.length(digits_of(value))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "number_like":  # holds no base match
        parts = F.regexp_extract_all(value, F.lit(PATTERNS["card"]), F.lit(0))
        cards = F.exists(parts, lambda p: valid("card", p))
        return n.between(7, 19) & ~value.rlike(PATTERNS["ip"]) & ~F.exists(F.regexp_extract_all(value, F.lit(PATTERNS["phone"]), F.lit(0)), lambda p: valid("phone", p)) & ~cards
    return F.lit(True)


def votes(kind: str, s: Column) -> list[Column]:
    """1 for, 0 against, null to abstain: regex, gazetteer, context and shape labelers, in the order of VOTERS."""
    value, digits = s["value"], digits_of(s["value"])
    yes = lambda c: F.when(c, 1)
    strict = {
        "email": value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,12}$"),
        "ip": value.rlike(r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"),
        "card": value.rlike(r"^[0-9]{12,19}$|^[0-9]{4}([ -][0-9]{4}){2,3}"),
        "phone": value.rlike(r"^\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)|[0-9]{2,4})[ .-]?[0-9][0-9 .-]+$"),
        "email_like": value.rlike(r"(?i)dot|\."),
        "number_like": value.rlike(r"^(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    }[kind]
    listed_in = {
        "email": value.rlike(rf"(?i)\.({DOMAINS})$"),
        "ip": ~value.rlike(PRIVATE),
        "card": digits.rlike(ISSUERS),
        "phone": value.rlike(COUNTRIES),
        "email_like": value.rlike(rf"(?i)(\.|dot[\])}}]?) ?({DOMAINS})$"),
        "number_like": digits.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$"),
    }[kind]
    context = F.when(s["before"].rlike(AWAY), 0).when(s["before"].rlike(NEAR[kind]) | s["after"].rlike(NEAR[kind]), 1)
    odd = value.rlike(r"^([0-9])\1*$|^(19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|^[0-9]{1,2}[ .-][0-9]{1,2}[ .-](19|20)[0-9]{2}|[0-9]-[0-9]{1,4}-[0-9]$") | (F.length(value) > 40)
    shape = F.when(odd, 0).when(s["before"].rlike(r"[\p{L}_/=]$") | s["after"].rlike(r"^[\p{L}_/=]"), 0)
    return [yes(strict).otherwise(0), yes(listed_in).otherwise(0 if kind != "number_like" else None), context, shape]


def traits(kind: str, s: Column) -> list[Column]:
    """Features of a span for the classifier; each has few values."""
    value, n = s["value"], F.length(digits_of(s["value"]))
    marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(value, r"[A-Za-z0-9]", ""), ""))), "")
    near = lambda c: F.when(c == "", "end").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "blank").otherwise("mark")
    parts = [
        F.least(F.length(value), F.lit(60)) / 4,
        F.least(n, F.lit(20)),
        F.substring(marks, 1, 6),
        near(F.right(s["before"], F.lit(1))),
        near(F.left(s["after"], F.lit(1))),
        s["before"].rlike(NEAR[kind]),
        F.substring(value, 1, 1).rlike("[(+]"),
    ]
    return [F.concat_ws("|", F.lit(kind), F.lit(str(i)), (F.floor(p).cast("string") if i == 0 else p.cast("string"))) for i, p in enumerate(parts)]


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and found: array of (kind, start, end, base, votes, traits) of each document."""
    text = F.col("__text")
    tests = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9]"),
        "phone": F.contains(text, F.lit("+")),
        "email_like": text.rlike(r"[\[({](?i:at)[\])}]"),
        "number_like": text.rlike("[0-9]"),
    }
    df = docs.select(*keep, text_of().alias("__text"))
    for kind in KINDS:
        df = with_matches(df, f"__{kind}", PATTERNS[kind], tests[kind], "__text")
        df = df.withColumn(f"__{kind}", F.transform(F.filter(f"__{kind}", _passes(kind)), _described(kind)))
    return df.select(*keep, F.concat(*[f"__{k}" for k in KINDS]).alias("found"))


def _passes(kind: str):
    return lambda s: valid(kind, s["value"])


def _described(kind: str):
    said = lambda s: F.concat(*[F.coalesce(v.cast("string"), F.lit("-")) for v in votes(kind, s)])
    return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), said(s).alias("votes"), F.array(*traits(kind, s)).alias("traits"))


def of_kind(i: int):
    return lambda s: s["kind"] == i


def reliabilities(patterns, rounds: int = ROUNDS) -> dict[int, tuple[float, list[tuple[float, float]]]]:
    """By kind: the share of true spans, and each voter's rate of votes for true and for false spans.

    patterns are rows (kind, votes, n), at most 3 ** 4 a kind whatever the corpus, so EM runs over them on the driver:
    posteriors of the patterns under the present rates, then the rates from the weighted counts.
    """
    at = {k: (0.5, [(0.85, 0.3)] * len(VOTERS)) for k in range(len(KINDS))}
    for _ in range(rounds):
        before = dict(at)
        for k in {r.kind for r in patterns}:
            own = [(r.votes, r.n, probability(at, k, r.votes)) for r in patterns if r.kind == k]
            rates = []
            for j in range(len(VOTERS)):
                said = [(votes_[j] == "1", n, p) for votes_, n, p in own if votes_[j] != "-"]
                rate = lambda yes, all_, prior: min(0.98, max(0.02, (yes + 4 * prior) / (all_ + 4)))
                rates.append(
                    (
                        rate(sum(n * p for yes, n, p in said if yes), sum(n * p for _, n, p in said), 0.85),
                        rate(sum(n * (1 - p) for yes, n, p in said if yes), sum(n * (1 - p) for _, n, p in said), 0.3),
                    )
                )
            share = (sum(n * p for _, n, p in own) + SMOOTH) / (sum(n for _, n, _ in own) + 2 * SMOOTH)
            at[k] = (min(0.98, max(0.02, share)), rates)
        flat = lambda d: [x for share, rates in d.values() for x in (share, *chain(*rates))]
        if max(abs(x - y) for x, y in zip(flat(before), flat(at))) < STILL:
            break
    return at


def probability(at, kind: int, votes_: str) -> float:
    """posterior() of one kind and one string of votes."""
    share, rates = at[kind]
    odds = math.log(share / (1 - share))
    for vote, (a, b) in zip(votes_, rates):
        if vote != "-":
            odds += math.log(a / b) if vote == "1" else math.log((1 - a) / (1 - b))
    return 1 / (1 + math.exp(-odds))


def as_map(d: dict[str, float]) -> Column:
    """A map column from one literal: its values aren't part of the generated code, so all rounds share one class."""
    return F.from_json(F.lit(json.dumps(d)), "map<string,double>")


def posterior(at, votes_: Column | None = None, kind: Column | None = None) -> Column:
    """Probability that a span is true, from its kind and votes; abstentions say nothing."""
    votes_, kind = F.col("votes") if votes_ is None else votes_, F.col("kind") if kind is None else kind
    odds = {}
    for k, (share, rates) in at.items():
        odds[f"{k}"] = math.log(share / (1 - share))
        for j, (a, b) in enumerate(rates):
            odds |= {f"{k}:{j}:1": math.log(a / b), f"{k}:{j}:0": math.log((1 - a) / (1 - b))}
    held, name = as_map(odds), kind.cast("string")
    own = F.element_at(held, name)
    for j in range(len(VOTERS)):
        own = own + F.coalesce(F.element_at(held, F.concat_ws(":", name, F.lit(str(j)), F.substring(votes_, j + 1, 1))), F.lit(0.0))
    return 1 / (1 + F.exp(-own))


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id alone by default), n_email, n_ip, n_card, n_phone, base (kind:start:end, joined) and spans.

    One pass over the texts finds the candidates with their votes and features. EM over the counts of vote patterns
    estimates how reliable each labeler is for each kind; its posteriors are the labels of a naive Bayes classifier of
    span features, which is again one aggregate with a bounded number of rows. Base matches always stay; spans of the
    further kinds are added where classifier and posterior both reach ADD_FROM. Null texts are empty; repeated rows stay;
    an empty table gives no rows; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    table = saved(candidates(docs, keep))
    spans = table.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.traits")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n")).orderBy("kind", "votes").collect()
    at = reliabilities(patterns)
    total = {k: (0.0, 0.0) for k in range(len(KINDS))}
    for r in patterns:
        p = probability(at, r.kind, r.votes)
        total[r.kind] = (total[r.kind][0] + p * r.n, total[r.kind][1] + (1 - p) * r.n)
    own = {KINDS.index(k): at[KINDS.index(k)] for k in ADDED}
    soft = spans.filter(F.col("kind") >= len(BASE)).withColumn("p", posterior(own)).select("kind", "p", F.explode("traits").alias("trait"))
    soft = soft.groupBy("kind", "trait").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).collect()
    share = lambda x, k, i: math.log((x + SMOOTH) / (total[k][i] + 2 * SMOOTH))
    weights = {r.trait: share(r.a, r.kind, 0) - share(r.b, r.kind, 1) for r in soft}
    start = {k: math.log((a + SMOOTH) / (b + SMOOTH)) for k, (a, b) in total.items() if a + b}

    def added(s):
        if not weights:
            return F.lit(False)
        score = F.coalesce(F.element_at(as_map({str(k): v for k, v in start.items()}), s["kind"].cast("string")), F.lit(0.0)) + F.aggregate(
            s["traits"], F.lit(0.0), lambda acc, t: acc + F.coalesce(F.element_at(as_map(weights), t), F.lit(0.0))
        )
        return (1 / (1 + F.exp(-score)) >= ADD_FROM) & (posterior(own, s["votes"], s["kind"]) >= ADD_FROM)

    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    every = F.filter("found", lambda s: (s["kind"] < len(BASE)) | added(s))
    counts = [F.size(F.filter("found", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return table.select(*keep, *counts, listed(base, KINDS).alias("base"), listed(every, KINDS).alias("spans"))


def redact(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with each found span replaced by its kind in brackets; spans within an earlier one are part of it."""
    others = [c for c in columns if c != "text"]
    found = find(docs, ["text", *others])
    spans = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        more = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        return F.when(s["start"] >= acc["at"], more).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(spans, empty, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.col("spans") == "", F.col("text")).otherwise(done)).select(*columns)


def op1_query(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
