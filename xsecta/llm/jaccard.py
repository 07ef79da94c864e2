"""N-gram Jaccard join by grouped prefixes: documents that share size and prefix are one group until they are verified."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mix64, ranges, release, row_chunks, saved, text_batch, text_of, texts_of_pairs, word_hashes
from .components import components

#: Words of a shingle. Two sets are linked if NUM * intersection >= DEN * (sum of sizes), which is a similarity of 0.8.
WORDS, NUM, DEN = 5, 9, 4
#: The most frequent shingles, which come last in the order of prefixes: 1 MB, whatever the corpus. It only sets the order.
FREQUENT = 1 << 17
#: A batch reports the shingles that this many of its documents hold.
REPORTED = 4
#: Members of a hub that meet one copy of its text.
HUB = 2_000
#: Ids that are broadcast at most to pick texts by; above that the texts are joined by a shuffle.
BROADCAST = 1_000_000
#: Rounds of star pairs before all pairs of what is left.
STARS = 1
#: 64-bit words of a set's parity bitmap, and their columns.
BITMAP = 8
BITS = [f"b{i}" for i in range(BITMAP)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The sorted distinct 64-bit shingle hashes of each row; a row of fewer words is one shingle, one without none."""
    words, at = word_hashes(data, offsets)
    if len(words) >= WORDS:
        parts = [mix64(words + np.uint64(0x9E37 + k)) * np.uint64(2 * k + 3) for k in range(WORDS)]
        n = len(words) - WORDS + 1
        grams = mix64(sum(p[k : k + n] for k, p in enumerate(parts)))
    else:
        grams = np.zeros(0, np.uint64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        elif b > a:
            short = sum(int(mix64(words[a + k : a + k + 1] + np.uint64(77 + k))[0]) * (2 * k + 3) for k in range(b - a)) + (b - a)
            yield mix64(np.array([short & (2**64 - 1)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _sets_of(column):
    for part in row_chunks(*text_batch(column)):
        yield from shingle_sets(*part)


def _frequent(batches):
    """(shingle, n): shingles that several documents of a batch hold."""
    import pyarrow as pa

    for batch in batches:
        all_ = np.sort(np.concatenate([np.zeros(0, np.uint64), *_sets_of(batch.column("text"))]))
        edges = ranges(all_)
        n = np.diff(edges)
        many = n >= REPORTED
        yield pa.RecordBatch.from_arrays([pa.array(all_[edges[:-1]][many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["shingle", "n"])


def frequent_shingles(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, rarest first. Any shingle in more documents than REPORTED times the batches is counted."""
    counts = docs.mapInArrow(_frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return top.column("shingle").to_numpy()[::-1].view(np.uint64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix64(s + np.uint64(1)).sum().astype(np.uint64).view(np.int64)), int((mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(3)).sum().astype(np.uint64).view(np.int64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each hashed place: whether an odd number of the set's shingles falls there."""
    odd = np.bincount((mix64(s ^ np.uint64(0xC3C3C3C3C3C3C3C3)) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(held, buckets: int, shape):
    """One row a document, and one row for each bucket of tokens of a batch: the tokens of its groups' prefixes."""

    def run(batches):
        import pyarrow as pa

        frequent = held.value
        by_hash = np.argsort(frequent)
        sorted_ = frequent[by_hash]
        for batch in batches:
            n, one, two, group, seen = [], [], [], [], {}
            tokens, where, places = [], [], []
            for s in _sets_of(batch.column("text")):
                f1, f2 = _fingerprint(s)
                size = len(s)
                if size:
                    i = np.searchsorted(sorted_, s)
                    i[i == len(sorted_)] = 0
                    common = sorted_[i] == s if len(sorted_) else np.zeros(size, bool)
                    p = size - (4 * size + 4) // 5 + 1
                    rare = s[~common]
                    prefix = rare[:p] if len(rare) >= p else np.concatenate([rare, frequent[np.sort(by_hash[i[common]])][: p - len(rare)]])
                    g1, _ = _fingerprint(prefix)
                    g = int(mix64(np.array([(g1 & (2**64 - 1)) ^ (size * 0x9E3779B97F4A7C15 & (2**64 - 1))], np.uint64)).view(np.int64)[0])
                    if g not in seen:
                        seen[g] = (len(seen), size)
                        tokens.append(prefix), where.append(np.full(p, len(seen) - 1, np.uint32)), places.append(np.arange(1, p + 1, dtype=np.uint32))
                else:
                    g = 0
                n.append(size), one.append(f1), two.append(f2), group.append(g)
            rows = batch.num_rows
            blank = [None] * rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(group, pa.int64()), pa.array(blank, pa.int32()), pa.array(blank, pa.binary())], names=shape
            )
            if not seen:
                continue
            tokens, where, places = np.concatenate(tokens), np.concatenate(where), np.concatenate(places)
            groups = np.array(list(seen), np.int64)
            sizes = np.array([x[1] for x in seen.values()], np.uint32)
            bucket = (mix64(tokens) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((tokens, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            numbers, payloads = [], []
            for b in range(buckets):
                o = order[edges[b] : edges[b + 1]]
                if len(o):
                    own, local = np.unique(where[o], return_inverse=True)
                    head = np.array([len(o), len(own)], np.int64)
                    payloads.append(b"".join(x.tobytes() for x in (head, tokens[o], groups[own], sizes[own], local.astype(np.uint32), places[o])))
                    numbers.append(b)
            none = lambda kind: pa.nulls(len(numbers), kind)
            yield pa.RecordBatch.from_arrays([none(batch.schema.field("doc_id").type), *[none(pa.int64())] * 4, pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], names=shape)

    return run


def _shared(got):
    """(token, grp, n, place) of the tokens in a bucket that more than one group's prefix holds."""
    import pyarrow as pa

    tokens, groups, sizes, places = [], [], [], []
    for raw in got.column("payload").to_pylist():
        m, k = np.frombuffer(raw, np.int64, 2)
        at = 16
        tokens.append(np.frombuffer(raw, np.uint64, m, at))
        at += 8 * m
        own = np.frombuffer(raw, np.int64, k, at)
        at += 8 * k
        size = np.frombuffer(raw, np.uint32, k, at)
        at += 4 * k
        local = np.frombuffer(raw, np.uint32, m, at)
        groups.append(own[local]), sizes.append(size[local]), places.append(np.frombuffer(raw, np.uint32, m, at + 4 * m))
    tokens, groups, sizes, places = (np.concatenate(x) for x in (tokens, groups, sizes, places))
    order = np.lexsort((groups, tokens))
    tokens, groups, sizes, places = tokens[order], groups[order], sizes[order], places[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1])
    tokens, groups, sizes, places = tokens[first], groups[first], sizes[first], places[first]
    edges = ranges(tokens)
    keep = np.repeat(np.diff(edges) > 1, np.diff(edges))
    return pa.table({"token": tokens[keep].view(np.int64), "grp": groups[keep], "n": sizes[keep].astype(np.int64), "place": places[keep].astype(np.int64)})


def _marked(shape):
    """Texts with their sets' fingerprints and bitmaps."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            marks, maps = [], np.zeros((batch.num_rows, BITMAP), np.int64)
            for i, s in enumerate(_sets_of(batch.column("text"))):
                marks.append(_fingerprint(s))
                maps[i] = _bitmap(s)
            prints = [pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *prints, *[pa.array(maps[:, k].copy()) for k in range(BITMAP)]], names=shape)

    return run


def _linked(batches):
    """Those (a, b) whose sets are similar enough; rows of one b follow each other, so its set is made once."""
    import pyarrow as pa

    last = held = None
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        texts = batch.column("text_b")
        for i, x in enumerate(_sets_of(batch.column("text_a"))):
            text = texts[i].as_py()
            if text != last:
                last, held = text, next(_sets_of(texts.slice(i, 1)))
            common = len(np.intersect1d(x, held, assume_unique=True))
            ok[i] = NUM * common >= DEN * (len(x) + len(held))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose whole sets, of texts(e, text), are similar enough."""
    return texts_of_pairs(pairs, texts, HUB, BROADCAST).mapInArrow(_linked, "a long, b long")


def _prefix(n):
    """Tokens in the prefix of a set of n shingles."""
    return n - F.floor((4 * n + 4) / 5) + 1


def _similar_size(a, b):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def open_places(places: DataFrame, parts: DataFrame | None) -> DataFrame:
    """places with each member's component as part, of the tokens that still hold several components."""
    if parts is None:
        return places.withColumn("part", F.col("e"))
    named = places.join(parts.withColumnRenamed("node", "e"), "e", "left").withColumn("part", F.coalesce("component", "e")).drop("component")
    named = saved(named)
    mixed = named.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("token")
    return named.join(mixed, "token", "left_semi")


def star_pairs(places: DataFrame, seed: int) -> DataFrame:
    """One pair (a, b) of each member at most: with the hub that most of its tokens share.

    In the first round a token's hub is its member with the most common prefix, which is likely what others are copies
    of; later ones draw it by hash.
    """
    hub = F.struct("e", "n", "part")
    if seed == 0:
        common = places.join(places.groupBy("token").agg(F.count("*").alias("df")), "token").groupBy("e").agg((F.sum("df") / F.first(_prefix(F.col("n")))).alias("common"))
        hubs = places.join(common, "e").groupBy("token").agg(F.max_by(hub, F.struct("common", "e")).alias("h"))
    else:
        hubs = places.groupBy("token").agg(F.min_by(hub, F.xxhash64("e", F.lit(seed))).alias("h"))
    met = places.join(hubs, "token").filter((F.col("part") != F.col("h.part")) & _similar_size(F.col("n"), F.col("h.n")))
    counted = met.groupBy("e", F.col("h.e").alias("hub")).agg(F.count("*").alias("c"))
    best = counted.groupBy("e").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    return best.select(F.col("e").alias("a"), F.col("hub").alias("b"))


def crossing_pairs(places: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All pairs (a, b) of members of different components that may be similar enough.

    Of two sets, the prefix of the one that ends earlier in the order holds all its tokens up to there, so the
    intersection is at most the common tokens of both prefixes and what that set has beyond its prefix. Pairs go before
    they are made if one side's tokens (m) are too few for that, and after if the common ones are. Nor are they made if
    the sets' parity bitmaps (e and BITS) differ in too many bits: each such bit takes an element that one set lacks.

    A token's largest component meets the others only, never itself. Pairs within the others are at most as many as
    those between them and the largest one, so no token costs more than a few times its crossing pairs.
    """
    counted = places.groupBy("e").agg(F.count("*").alias("m"))
    largest = places.groupBy("token", "part").count().groupBy("token").agg(F.max_by("part", F.struct("count", "part")).alias("top"))
    places = saved(places.join(counted, "e").join(bitmaps, "e").join(largest, "token").withColumn("main", F.col("part") == F.col("top")).drop("top"))
    x, y = places.alias("x"), places.filter("not main").alias("y")
    overlap = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + F.least("x.place", "y.place")
    need = DEN * (F.col("x.n") + F.col("y.n"))
    beyond = lambda a, b: F.greatest(F.col(a) - _prefix(F.col(a)), F.col(b) - _prefix(F.col(b)))
    enough = (F.col("x.whole") & F.col("y.whole")) | (NUM * (F.least("x.m", "y.m") + beyond("x.n", "y.n")) >= need)
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in BITS), F.lit(0))
    alike = NUM * differ <= (NUM - 2 * DEN) * (F.col("x.n") + F.col("y.n"))
    crossing = enough & alike & (F.col("x.part") != F.col("y.part")) & (F.col("x.main") | (F.col("x.e") < F.col("y.e"))) & _similar_size(F.col("x.n"), F.col("y.n")) & (NUM * overlap >= need)
    met = x.join(y, F.col("x.token") == F.col("y.token")).filter(crossing)
    # a pair may meet in one order where a side is of the largest component, and in the other elsewhere
    flip = F.col("x.e") > F.col("y.e")
    met = met.select(*[F.when(flip, F.col(f"{q}.{c}")).otherwise(F.col(f"{p}.{c}")).alias(f"{c}_{p}") for p, q in (("x", "y"), ("y", "x")) for c in ("e", "n")], (F.col("x.whole") & F.col("y.whole")).alias("whole"))
    counted = met.groupBy(F.col("e_x").alias("a"), F.col("e_y").alias("b")).agg(
        F.first("n_x").alias("n_a"), F.first("n_y").alias("n_b"), F.count("*").alias("c"), F.max("whole").alias("whole")
    )
    return counted.filter(F.col("whole") | (NUM * (F.col("c") + beyond("n_a", "n_b")) >= DEN * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def link(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id that links of similarity 0.8 or more reach.

    1. Every document's shingles are ordered, the corpus's most frequent ones last. Its first n - ceil(0.8 n) + 1 are its
       prefix; documents of equal prefix and size are one group, and those of equal sets within it one member.
    2. Tokens of the groups' prefixes meet in hashed buckets; those of a single group go.
    3. Groups are expanded to members. In each of STARS rounds every token has a hub, drawn by hash, and each member is
       verified against the one that most of its tokens share. So a group of near copies costs as many pairs as it has
       members; links make components, and tokens that hold one component only are done.
    4. The tokens left give all their pairs between different components that pass the size, position, bitmap and count
       filters, and these are verified as well. So no link between different components is lost, and pairs within one aren't
       needed.

    A null text is empty: 0 shingles, linked with nothing. Repeated rows are one member and stay in the result; rows
    with a null doc_id keep a null component; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = spark.sparkContext.broadcast(frequent_shingles(texts, frequent))
    buckets = max(64, 2 * docs.rdd.getNumPartitions())
    shape = ["doc_id", "n", "one", "two", "grp", "bucket", "payload"]
    first = saved(texts.mapInArrow(_prefixes(order, buckets, shape), "doc_id long, n long, one long, two long, grp long, bucket int, payload binary"))
    members = saved(first.filter(F.col("bucket").isNull()).select("doc_id", "n", "one", "two", "grp"))
    shared = first.filter(F.col("bucket").isNotNull()).select("bucket", "payload").groupBy("bucket").applyInArrow(_shared, "token long, grp long, n long, place long")
    sets = saved(members.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("n", "one", "two").agg(F.min("doc_id").alias("e"), F.min("grp").alias("grp")))
    several = sets.groupBy("grp").count().filter("count > 1").select("grp")
    within = sets.join(several, "grp", "left_semi").select(F.col("grp").alias("token"), "e", "n", F.lit(1).cast("long").alias("place"), F.lit(True).alias("whole"))
    expanded = shared.select("token", "grp", "place").join(sets.select("grp", "e", "n"), "grp").select("token", "e", "n", "place", F.lit(False).alias("whole"))
    places = saved(expanded.unionByName(within))
    forget(first)
    release(spark)
    wanted = places.select("e").distinct().join(sets.select("e", "one", "two"), "e")
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    picked = texts.join(near.select(F.col("e").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_marked(["e", "text", "one", "two", *BITS]), ", ".join(["e long, text string, one long, two long", *[f"{b} long" for b in BITS]]))
    held = saved(picked.join(near, ["e", "one", "two"], "left_semi").dropDuplicates(["e", "one", "two"]).select("e", "text", *BITS))

    release(spark)
    links = parts = None
    for step in range(STARS + 1):
        left = open_places(places, parts)
        pairs = saved(star_pairs(left, step) if step < STARS else crossing_pairs(left, held.select("e", *BITS)))
        found = saved(verified(pairs, held))
        links = found if links is None else links.unionByName(found)
        forget(pairs)
        release(spark)
        if parts is None or not found.isEmpty():
            parts = saved(components(links))
    forget(places, held)
    named = sets.join(parts.withColumnRenamed("node", "e"), "e", "left").select("n", "one", "two", F.coalesce("component", "e").alias("component_id"))
    out = members.join(named, ["n", "one", "two"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op8_query(spark, sf_dir):
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
