"""MinHash near-duplicates by a chosen-path set similarity join: a forest branches documents by selected minwise tokens."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mix64, row_chunks, saved, small, text_batch, text_of, texts_of_pairs, word_hashes
from .components import components
from .jaccard import BITMAP, BITS, open_places

#: Words of a shingle, and the least similarity of a link in per cent.
WORDS, PERCENT = 2, 80
#: Minwise tokens of a set; of each, two bits are compared before a pair is made.
TOKENS = 64
#: Members of a node that is compared as it is, and the factor by which a level is taken to make nodes smaller.
LIMIT, SHRINK = 32, 20
#: A node has one child token for a member, and a second one in this share of nodes: 1 / 0.8 children, so a pair at the
#: least similarity meets in one child on the average.
SECOND = 1 / 4
#: Share of the pairs at the least similarity that the forest may miss by its size.
MISSED = 1e-5
#: Differing tokens of a pair that is made: five standard deviations above what the least similarity leaves.
APART = 24
#: Members of a hub that meet one copy of its text.
HUB = 2_000
#: Ids of pairs that are broadcast at most to pick texts by; above that the texts are joined by a shuffle.
BROADCAST = 1_000_000
#: Levels that are branched without counting.
FIRST = 2

_random = np.random.default_rng(20_240_117)
_FLIP = _random.integers(0, 2**64, TOKENS, np.uint64)
_TIMES = _random.integers(0, 2**64, TOKENS, np.uint64) | np.uint64(1)


def survival(depth: int, similarity: float = PERCENT / 100) -> float:
    """Chance that a pair of that similarity still shares a node of one tree at that depth."""
    f = 1.0
    for _ in range(depth):
        miss = 1 - similarity * f
        f = 1 - ((1 - SECOND) * miss + SECOND * miss * miss)
    return f


def trees(depth: int, missed: float = MISSED) -> int:
    """Trees of that depth that together miss at most that share of the pairs at the least similarity."""
    return math.ceil(math.log(missed) / math.log(1 - survival(depth)))


def levels(n: int) -> int:
    """Levels of a forest over n sets: one more than nodes need to become small if each level divides them by SHRINK."""
    return max(FIRST, math.ceil(math.log(max(1.0, n / LIMIT), SHRINK))) + 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of all rows, and the n + 1 offsets; a row of fewer words is one shingle."""
    words, at = word_hashes(data, offsets)
    rows, size = len(offsets) - 1, np.diff(at)
    row = np.repeat(np.arange(rows), size)
    value = np.zeros(len(words), np.uint64)
    run = max(0, len(words) - width + 1)
    for k in range(width):
        value[:run] += mix64(words[k : k + run] + np.uint64(0x9E37 + k)) * np.uint64(2 * k + 3)
    whole = np.arange(len(words)) + width <= at[row + 1]
    for r in np.flatnonzero((size > 0) & (size < width)):
        a = at[r]
        value[a] = sum((mix64(words[a + k : a + k + 1] + np.uint64(77 + k)) * np.uint64(2 * k + 3) for k in range(size[r])), np.zeros(1, np.uint64))[0] + np.uint64(size[r])
        whole[a] = True
    value, row = mix64(value[whole]), row[whole]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(rows + 1))


def _sets(column):
    """shingles() of the column's rows, by chunks."""
    for part in row_chunks(*text_batch(column)):
        yield shingles(*part)


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=1).view(">i8").astype(np.int64).ravel()


def _parities(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A bit for each hashed place and row: whether an odd number of the row's shingles falls there."""
    places, rows = 64 * BITMAP, len(at) - 1
    place = (mix64(value ^ np.uint64(0xC3C3C3C3C3C3C3C3)) % np.uint64(places)).astype(np.int64)
    odd = np.bincount(place + np.repeat(np.arange(rows), np.diff(at)) * places, minlength=rows * places) & 1
    return np.packbits(odd.reshape(rows, places).astype(np.uint8), axis=1).view(np.int64)


MARKED = ", ".join(["doc_id long, mark long, n long, one long, two long, k1 long, k2 long, sketch binary", *[f"{b} long" for b in BITS]])


def _marked(batches):
    """Size, 128-bit fingerprint, minwise tokens, their compared bits and parity bits of each text's set; no tokens of an
    empty set."""
    import pyarrow as pa

    for batch in batches:
        done = 0
        for value, at in _sets(batch.column("text")):
            rows, n = len(at) - 1, np.diff(at)
            full = np.flatnonzero(n)
            one, two, tokens = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros((rows, TOKENS), np.uint64)
            if len(full):
                starts = at[full]
                one[full] = np.add.reduceat(mix64(value + np.uint64(1)), starts)
                two[full] = np.add.reduceat(mix64(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                for i in range(TOKENS):
                    tokens[full, i] = np.minimum.reduceat((value ^ _FLIP[i]) * _TIMES[i], starts)
            tokens = mix64(tokens)
            keys = [_bits((tokens >> np.uint64(b)) & np.uint64(1) == 1) for b in (40, 41)]
            raw = [r.tobytes() if n[i] else None for i, r in enumerate(tokens.astype("<u4"))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(done, rows) for c in ("doc_id", "mark")], pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *[pa.array(k) for k in keys], pa.array(raw, pa.binary()), *[pa.array(b) for b in _parities(value, at).T.copy()]],
                ["doc_id", "mark", "n", "one", "two", "k1", "k2", "sketch", *BITS],
            )
            done += rows


def _children(node: np.ndarray, row: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, row) of the rows of nodes: the node alone selects one or two tokens, each member goes to its child of each."""
    t = np.uint64(TOKENS)
    first = mix64(node ^ np.uint64(0x1F83D9ABFB41BD6B)) % t
    second = (first + np.uint64(1) + mix64(node ^ np.uint64(0x5BE0CD19137E2179)) % (t - np.uint64(1))) % t
    both = mix64(node ^ np.uint64(0x6A09E667F3BCC908)) < np.uint64(int(SECOND * 2**64))
    place, owner = np.concatenate([first, second[both]]), np.concatenate([row, row[both]])
    parent = np.concatenate([node, node[both]])
    value = tokens[owner, place.astype(np.int64)].astype(np.uint64)
    return mix64(mix64(parent + (place << np.uint64(32))) ^ value), owner


def _branched(roots: int, deep: int):
    """(node, e) of the members' nodes deep levels below those in the column nodes, or below the roots of so many trees."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                tokens = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u4").reshape(-1, TOKENS)
                if roots:
                    node, row = np.tile(mix64(np.arange(1, roots + 1, dtype=np.uint64)), len(tokens)), np.repeat(np.arange(len(tokens)), roots)
                else:
                    lists = part.column("nodes")
                    node, row = np.asarray(lists.flatten(), np.int64).view(np.uint64), np.repeat(np.arange(len(tokens)), np.asarray(lists.value_lengths()))
                for _ in range(deep):
                    node, row = _children(node, row, tokens)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), part.column("e").take(pa.array(row))], ["node", "e"])

    return run


def forest(sets: DataFrame, depth: int, count: int) -> DataFrame:
    """(token, e): the members of all leaves with two members or more of count trees over sets(e, sketch).

    A node above LIMIT members is branched again unless it is depth levels deep. What a node selects depends on the node
    alone, so members need no meeting for that: a level is a count by node, and a join of the members with their sketches.
    """
    leaves, level = None, FIRST
    rows = saved(sets.select("e", "sketch").mapInArrow(_branched(count, FIRST), "node long, e long"))
    while True:
        counts = rows.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1")
        met = saved(rows.join(counts, "node"))
        forget(rows)
        here = met if level >= depth else met.filter(F.col("members") <= LIMIT)
        leaves = here.select(F.col("node").alias("token"), "e") if leaves is None else leaves.unionByName(here.select(F.col("node").alias("token"), "e"))
        large = met.filter(F.col("members") > LIMIT)
        if level >= depth or large.isEmpty():
            return leaves
        lists = large.groupBy("e").agg(F.collect_list("node").alias("nodes"))  # a few for each tree
        rows = saved(lists.join(sets.select("e", "sketch"), "e").select("e", "sketch", "nodes").mapInArrow(_branched(0, 1), "node long, e long"))
        level += 1


def _close(x: str, y: str):
    """Whether members x and y may be linked, by the sizes of their sets and by their tokens' bits."""
    size = 100 * F.least(f"{x}.n", f"{y}.n") >= PERCENT * F.greatest(f"{x}.n", f"{y}.n")
    differ = F.bit_count(F.col(f"{x}.k1").bitwiseXOR(F.col(f"{y}.k1")).bitwiseOR(F.col(f"{x}.k2").bitwiseXOR(F.col(f"{y}.k2"))))
    return size & (differ <= APART)


def star_pairs(places: DataFrame) -> DataFrame:
    """One pair (a, b) of each member at most: with the hub that most of its nodes share and that is close enough.

    A node's hub is its member with the largest nodes, which is likely what others are copies of.
    """
    size = places.groupBy("token").agg(F.count("*").alias("members"))
    weight = places.join(size, "token").groupBy("e").agg(F.sum("members").alias("weight"))
    hubs = places.join(weight, "e").groupBy("token").agg(F.max_by(F.struct("e", "n", "k1", "k2", "part"), F.struct("weight", "e")).alias("h"))
    x, y = places.alias("x"), hubs.select("token", "h.*").alias("y")
    met = x.join(y, F.col("x.token") == F.col("y.token")).filter((F.col("x.part") != F.col("y.part")) & _close("x", "y"))
    counted = met.groupBy(F.col("x.e").alias("a"), F.col("y.e").alias("b")).agg(F.count("*").alias("c"))
    return counted.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def crossing_pairs(places: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All pairs (a, b) of a node's members of different components that are close enough, bitmaps(e, BITS) giving parities.

    Each parity bit in which two sets differ takes an element that one of them lacks, so too many of them rule a link out:
    pairs a little below the least similarity go before they are made, as far as sets aren't much larger than the bitmap.

    A node's largest component meets the others only, never itself, so a node costs no more than a few times its
    crossing pairs. A pair is made at the first node that both share, not at each: members bring their open nodes along,
    a few for each tree.
    """
    own = places.groupBy("e").agg(F.collect_list("token").alias("tokens")).join(bitmaps, "e")
    largest = places.groupBy("token", "part").count().groupBy("token").agg(F.max_by("part", F.struct("count", "part")).alias("top"))
    marked = saved(places.join(largest, "token").withColumn("main", F.col("part") == F.col("top")).drop("top").join(own, "e"))
    x, y = marked.alias("x"), marked.filter("not main").alias("y")
    lacking = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in BITS), F.lit(0))
    alike = (100 + PERCENT) * lacking <= (100 - PERCENT) * (F.col("x.n") + F.col("y.n"))
    crossing = (F.col("x.part") != F.col("y.part")) & (F.col("x.main") | (F.col("x.e") < F.col("y.e"))) & _close("x", "y") & alike
    crossing = crossing & (F.array_min(F.array_intersect("x.tokens", "y.tokens")) == F.col("x.token"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & crossing)
    return met.select(F.greatest("x.e", "y.e").alias("a"), F.least("x.e", "y.e").alias("b")).distinct()


def _linked(batches):
    """Those (a, b) whose whole sets are similar enough; rows of one b follow each other, so its set is made once."""
    import pyarrow as pa

    last, held = None, None
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        texts = batch.column("text_b")
        i = 0
        for value, at in _sets(batch.column("text_a")):
            for k in range(len(at) - 1):
                text = texts[i].as_py()
                if text != last:
                    last, held = text, next(_sets(texts.slice(i, 1)))[0]
                own = value[at[k] : at[k + 1]]
                common = len(np.intersect1d(own, held, assume_unique=True))
                ok[i] = 100 * common >= PERCENT * (len(own) + len(held) - common)
                i += 1
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose whole sets, of texts(e, text), are similar enough."""
    return texts_of_pairs(pairs, texts, HUB, BROADCAST).mapInArrow(_linked, "a long, b long")


def link(docs: DataFrame, missed: float = MISSED) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: near-duplicate classes of documents, by the smallest doc_id they reach.

    1. Each text's set of distinct WORDS-word shingles gets TOKENS minwise tokens. Equal sets (by 128 bits) are one member.
    2. trees(levels(n)) independent trees branch the members: a node selects one or two tokens, and members go to a child for
       each of their tokens there. Nodes of LIMIT members or fewer are leaves; so are larger ones at the last level, which
       hold mostly copies. Two sets of the least similarity share a leaf but for a chance of missed.
    3. Members of a leaf are compared: first each with one hub only, so a group of near copies costs as many pairs as
       members, then all that are still in different components. A pair needs similar sizes and few differing
       token and parity bits to be made (APART, a chance of about 1e-6 for a link), and whole sets that are similar enough to be a link.

    A null text is empty: 0 shingles, linked with nothing, kept. A document of fewer words than a shingle is one shingle.
    Texts of any length are whole. Repeated rows are one member and stay in the result; of rows that share a doc_id each
    has the class of its own text; rows with a null doc_id have no component and are kept; other columns are ignored; an
    empty table gives no rows.
    """
    text = text_of()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    marked = saved(texts.mapInArrow(_marked, MARKED))
    members = marked.select("doc_id", "n", "one", "two")
    full = marked.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = [F.first(c).alias(c) for c in ("k1", "k2", "sketch", *BITS)]
    sets = full.groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "mark")).alias("pick"), *same)
    sets = saved(sets.withColumn("e", F.monotonically_increasing_id()))
    depth = levels(sets.count())
    places = forest(sets, depth, trees(depth, missed))
    places = saved(places.join(sets.select("e", "n", "k1", "k2"), "e"))
    near = small(sets.join(places.select("e").distinct(), "e", "left_semi").select("e", "pick.*"), BROADCAST)
    alike = texts.join(near, ["doc_id", "mark"]).select("e", "text")
    if full.groupBy("doc_id", "mark").count().filter("count > 1").limit(1).count():
        alike = alike.dropDuplicates(["e"])
    alike = saved(alike)
    links = parts = None
    for made in (star_pairs, lambda left: crossing_pairs(left, sets.select("e", *BITS))):
        pairs = saved(made(open_places(places, parts)))
        found = saved(verified(pairs, alike))
        links = found if links is None else links.unionByName(found)
        forget(pairs)
        if parts is None or not found.isEmpty():
            parts = saved(components(links))
    forget(places, alike)
    named = sets.select("e", "n", "one", "two", "pick.doc_id").join(parts.withColumnRenamed("node", "e"), "e")
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("n", "one", "two", "least")
    firsts = sets.select("n", "one", "two", "pick.doc_id").join(named, ["n", "one", "two"], "left").select("n", "one", "two", F.coalesce("least", "doc_id").alias("component_id"))
    out = members.join(firsts, ["n", "one", "two"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_query(spark, sf_dir):
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# all pairs that share a shingle, counted; components by spreading the smallest doc_id along links
OP12_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM split),
sized AS (SELECT doc_id, g, CAST(len(g) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, n, unnest(g) AS x FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.r),
least_ AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY 1)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, l.component_id IS NULL OR l.component_id = s.doc_id AS kept
FROM sized s LEFT JOIN least_ l ON l.doc_id = s.doc_id
"""
