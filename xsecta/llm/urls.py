"""URL filters: path-template trees per host, judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: (verdict, rule) of the contract; a rule is host/path, the longest fitting one wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: A level is variable if its segments are as uncertain as this many equally frequent ones.
DISTINCT = 8
#: Branches with less than this share of their level's paths are not compared with others.
COMPARED = 1 / 64
#: Standard errors within which branches' shares of blocked paths count as the same; the distance of their children's shapes
#: and the ratio of their numbers of paths up to which branches are alike.
ALIKE, SHAPES_APART, TIMES = 1.96, 0.2, 4.0
#: Pseudo-paths of the parent's purity in a template's own, and the purity from which it is rejected.
SMOOTHING, REJECT = 4.0, 0.8
#: Bytes of a level's decisions that are broadcast at most; above that, paths are salted so often for the join.
BROADCAST, SALTS = 64 << 20, 32
#: Pages of one path that are shuffled to it at most.
HOT = 10_000
#: Shapes of a branch's children: what the next segment is like.
SHAPES = ("none", "empty", "number", "word", "file", "other")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_host_path(pages: DataFrame) -> DataFrame:
    at = F.instr("url", "://")
    rest = F.substring(F.col("url"), at + 3, F.length("url"))
    known = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return pages.withColumns({"host": F.when(known, host).otherwise(""), "path": F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")})


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, tail = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def _spread(n: Column, n_log_n: Column) -> Column:
    """How many equally frequent segments are as uncertain as those with n paths in all and that sum of n ln n."""
    return F.exp(F.ln(n) - n_log_n / n)


def _shape(segment: Column) -> Column:
    of = {"none": segment.isNull(), "empty": segment == "", "number": segment.rlike("^[0-9]+$"), "word": segment.rlike(r"^\p{L}+$"), "file": segment.rlike(r"\.[A-Za-z0-9]+$")}
    shape = F.lit("other")
    for name, test in reversed(of.items()):
        shape = F.when(test, name).otherwise(shape)
    return shape


def _decided(left: DataFrame) -> DataFrame:
    """One row a node (host, template) of two paths or more: its purity, what rare segments become, and names of the others.

    See with_templates(). A node's compared branches are at most 1 / COMPARED, so the rows are bounded.
    """
    keys, n = ["host", "template"], F.col("n")
    log, enough = n * F.ln("n"), DISTINCT - 1e-6  # sums of logarithms are not exact
    counts = [F.sum((F.col("child") == s).cast("long")).alias(f"c_{s}") for s in SHAPES]
    branches = left.groupBy(*keys, "seg").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("blocked"), F.max("up").alias("up"), *counts)
    level = branches.groupBy(keys).agg(F.sum("n").alias("all_n"), F.sum(log).alias("all_log"), F.sum("known").alias("all_known"), F.sum("blocked").alias("all_blocked"), F.max("up").alias("up"))
    level = saved(level.filter("all_n > 1").withColumn("purity", (F.col("all_blocked") + SMOOTHING * F.col("up")) / (F.col("all_known") + SMOOTHING)))
    few = _few(level, F.lit(64))
    joined = branches.drop("up").join(few.select(*keys, "all_n", "all_log", "all_known", "all_blocked"), keys)
    rare = joined.filter(n * DISTINCT < F.col("all_n")).groupBy(keys).agg(F.sum("n").alias("rare_n"), F.sum(log).alias("rare_log"))
    # labelled branches whose share of blocked paths is that of the other ones
    p, others = F.try_divide("all_blocked", "all_known"), F.col("all_known") - F.col("known")
    gap = F.abs(F.try_divide(F.col("blocked"), F.col("known")) - F.try_divide(F.col("all_blocked") - F.col("blocked"), others))
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("known")) + F.try_divide(F.lit(1.0), others)))
    compared = joined.filter(n >= COMPARED * F.col("all_n")).withColumn("same", (F.col("known") > 0) & F.coalesce(gap <= ALIKE * error, F.lit(False)))
    lists = compared.groupBy(keys).agg(
        F.collect_list(F.struct("seg", "n", "known", "same", (n * DISTINCT < F.col("all_n")).alias("rare"), F.array(*[F.col(f"c_{s}") / n for s in SHAPES]).alias("shares"))).alias("branches"),
        F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("pooled"),
        F.sum(F.when(F.col("same"), n)).alias("pool_n"),
        F.array(*[F.try_divide(F.sum(F.when(F.col("same"), F.col(f"c_{s}"))), F.sum(F.when(F.col("same"), n))) for s in SHAPES]).alias("pool"),
    )
    spread = lambda total, logs: F.coalesce(_spread(F.col(total), F.col(logs)) >= enough, F.lit(False))
    out = level.join(lists, keys, "left").join(rare, keys, "left").withColumns({"all_var": spread("all_n", "all_log"), "rare_var": spread("rare_n", "rare_log")})
    apart = lambda b: F.aggregate(F.zip_with(b["shares"], "pool", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x) / 2
    mean = F.try_divide("pool_n", "pooled")
    near = lambda b: (b["n"] <= TIMES * mean) & (b["n"] * TIMES >= mean) & (apart(b) <= SHAPES_APART)
    merges = lambda b: (F.col("pooled") >= 2) & (b["same"] | ((b["known"] == 0) & near(b)))
    name = lambda b: F.when(F.col("all_var") | (b["rare"] & F.col("rare_var")), "*").when(merges(b), "{}").otherwise(b["seg"])
    names = F.map_from_entries(F.transform(F.coalesce("branches", F.array()), lambda b: F.struct(b["seg"].alias("k"), name(b).alias("v"))))
    return saved(out.select(*keys, "purity", (F.col("all_var") | F.col("rare_var")).alias("wild"), names.alias("names")))


def _few(df: DataFrame, size: Column) -> DataFrame:
    """df with a broadcast hint if its rows of size bytes are at most BROADCAST together."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST else df


def _met(left: DataFrame, decided: DataFrame) -> DataFrame:
    """left with its node's decision: broadcast while the decisions are small, else by salted keys, as one host may be hot."""
    size = F.lit(200) + F.aggregate(F.map_keys("names"), F.lit(0), lambda a, k: a + 2 * F.length(k) + 32)
    if (decided.agg(F.sum(size)).first()[0] or 0) <= BROADCAST:
        return left.join(F.broadcast(decided), ["host", "template"], "left")
    salted = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "template", "salt"], "left").drop("salt")


def with_templates(paths: DataFrame) -> DataFrame:
    """host, path, bad, template and up of paths(host, path, bad): variable segments are *, like branches {}.

    Level by level below each host, until no template has unsplit segments. If the next segments of a node are spread
    like DISTINCT equally frequent ones or more, they all become one wildcard; otherwise those with a share below
    1 / DISTINCT do so if they are spread like that among themselves. Both look at shares only, so the number of pages
    doesn't matter. Of the other segments, labelled branches whose share of blocked paths differs from that of their
    siblings by less than ALIKE standard errors are merged; if they are two or more, so are unlabelled branches like them
    in size (TIMES) and in the shapes of their children (SHAPES_APART). up is the purity of the node above: each node's
    blocked share with SMOOTHING pseudo-paths of its own parent's, from the blocked share of all labelled paths at the top.

    Each level is a few aggregates with map-side sums and a join with one row for each node of two paths or more, so a
    host of any size is fine. A node with one path needs no further level, so there are as many levels as segments that
    two paths of a host share, plus one.
    """
    prior = paths.agg(F.avg("bad")).first()[0] or 0.0
    rest = F.split(F.regexp_replace("path", "^/", ""), "/")
    out = saved(paths.select("host", "path", "bad", F.lit("").alias("template"), F.lit(prior).alias("up"), rest.alias("rest")))
    done = None
    while True:
        left = out.filter(F.size("rest") > 0)
        ended = out.filter(F.size("rest") == 0).drop("rest")
        done = ended if done is None else done.unionByName(ended)
        if left.isEmpty():
            return done
        left = left.withColumn("seg", F.get("rest", F.lit(0))).withColumn("child", _shape(F.get("rest", F.lit(1))))
        alone = F.col("purity").isNull()
        name = F.coalesce(F.element_at("names", F.col("seg")), F.when(F.col("wild"), "*").otherwise(F.col("seg")))
        out = saved(
            _met(left, _decided(left)).select(
                "host",
                "path",
                "bad",
                F.concat("template", F.lit("/"), F.when(alone, F.array_join("rest", "/")).otherwise(name)).alias("template"),
                F.coalesce("purity", "up").alias("up"),
                F.when(alone, F.array().cast("array<string>")).otherwise(F.expr("slice(rest, 2, size(rest))")).alias("rest"),
            )
        )


def _with_paths(known: DataFrame, judged: DataFrame) -> DataFrame:
    """known with its path's judgement. Paths of more than HOT pages, null urls among them, are few: their judgements are
    sent to the pages, so no task gets all pages of one path; the others meet by a shuffle."""
    keys = ["host", "path"]
    hot = judged.join(known.groupBy(keys).count().filter(F.col("count") > HOT).select(*keys), keys, "left_semi")
    if (hot.agg(F.sum(F.length("host") + 2 * F.length("path") + 100)).first()[0] or 0) > BROADCAST:
        return known.join(judged, keys)
    hot = F.broadcast(hot)
    return known.join(hot, keys).unionByName(known.join(hot, keys, "left_anti").join(judged, keys))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for each row of pages(page_id, url).

    Pages that a rule fits are the labelled ones and keep the rule's verdict. Any other page gets its template's: block
    if (blocked + SMOOTHING * up) / (labelled + SMOOTHING) reaches REJECT, where up is the purity of the node above; so a
    template without labelled pages takes that of the nearest node which has some, and a host without any the blocked
    share of all labelled paths. Rules look at host and path only, so all pages of one path have one label, and it counts
    once: templates and purities don't change when pages repeat. Null urls and urls without :// have an empty host and
    path and no rule; a path of any length is looked at whole; repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    rule, verdict = rule_of(rules)
    known = with_host_path(pages.select("page_id", F.col("url").cast("string").alias("url")))
    known = known.withColumn("rule", rule).withColumn("said", verdict).withColumn("bad", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("long")))
    known = saved(known.select("page_id", "host", "path", "rule", "said", "bad"))
    shaped = saved(with_templates(saved(known.select("host", "path", "bad").distinct())))
    purity = (F.coalesce(F.sum("bad"), F.lit(0)) + SMOOTHING * F.max("up")) / (F.count("bad") + SMOOTHING)
    templates = shaped.groupBy("host", "template").agg(purity.alias("purity"))
    judged = shaped.select("host", "path", "template").join(_few(templates, F.length("host") + F.length("template") + 48), ["host", "template"])
    out = _with_paths(known, judged)
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")


def op7_query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
