"""Approximate nearest neighbours: NN-descent builds the graph by Spark joins, queries search it greedily."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, matrix, ranges, saved, whole_groups

#: Neighbours kept for each node: K at least, and WIDTH for each doubling of the table.
K, WIDTH = 16, 1.5
#: NN-descent ends when a round changes less than this share of the neighbour lists' entries.
STILL = 0.05
#: First cells: at most PIVOTS pivots (a bounded sample), CELL rows of a cell, cells that a row joins, bits of a row's place.
PIVOTS, CELL, HOMES, BITS = 4096, 256, 2, 30
#: Beam of a search at first, in widths of the graph; it is doubled until less than this share of the answers changes.
BEAM, SETTLED = 4, 0.005
#: Nodes that a query opens in one step at most, so a step's rows grow with the queries and not with the beam.
OPEN = 256
#: A beam is done when at most this share of its nodes is unopened.
LEFT = 0.02
#: Bytes of packed vectors and rows of opened nodes that are broadcast at most; beyond that they are joined by shuffles.
HELD, OPENED = 64 << 20, 1_000_000
#: Candidates of a query that are scored exactly, for each neighbour wanted.
EXACT = 8


def usable(vectors: DataFrame) -> DataFrame:
    """id and vec of the vectors that take part: not null, not empty, all components finite, not zero."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").alias("id"), "embedding").filter(
        F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))
    ).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in x.astype(np.float16)]


def _unpack(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, dims).astype(np.float32)


def width(n: int) -> int:
    """Neighbours kept for each of n nodes."""
    return max(K, math.ceil(WIDTH * math.log2(max(n, 2))))


def _held(nodes: DataFrame, n: int, dims: int) -> DataFrame:
    """nodes with a broadcast hint if n packed vectors of dims numbers are small."""
    return F.broadcast(nodes) if n * (2 * dims + 32) <= HELD else nodes


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best (node, other, sim, born) of each node, once each; the window's limit also works before the shuffle."""
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    once = pairs.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _local_joins(dims: int, k: int):
    """(node, other, sim) of pairs within each group of (hub, id, packed, least, fresh), one of the two being fresh: for each
    node the k best that better its worst neighbour."""

    def run(batches):
        import pyarrow as pa

        for table in whole_groups(batches, "hub"):
            hub, ids, least, fresh = (table.column(c).to_numpy() for c in ("hub", "id", "least", "fresh"))
            x = _unpack(table.column("packed"), dims)
            edges = ranges(hub)
            nodes, others, sims = [], [], []
            for a, b in zip(edges[:-1], edges[1:]):
                s = x[a:b] @ x[a:b].T
                np.fill_diagonal(s, -2)
                good = (s > least[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
                if b - a > k:
                    good &= s >= np.partition(s, -k, axis=1)[:, -k, None]
                i, j = np.nonzero(good)
                nodes.append(ids[a:b][i]), others.append(ids[a:b][j]), sims.append(s[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(others), pa.int64()), pa.array(np.concatenate(sims).astype(np.float32))], ["node", "other", "sim"])

    return run


def _join_groups(groups: DataFrame, dims: int, k: int, step: int, dealt: bool = False) -> DataFrame:
    """Pairs of _local_joins(); dealt says that a hub's rows are in one partition already."""
    grouped = groups.select("hub", "id", "packed", "least", "fresh")
    grouped = (grouped if dealt else grouped.repartition("hub")).sortWithinPartitions("hub", "id")
    return grouped.mapInArrow(_local_joins(dims, k), "node long, other long, sim float").withColumn("born", F.lit(step))


def build_graph(nodes: DataFrame, dims: int, k: int) -> DataFrame:
    """(node, other, sim): about the k nearest of each node of nodes(id, packed).

    The first graph comes from exact joins within small cells: each node joins the cells of its HOMES nearest pivots. A
    cell above CELL rows is halved by the sides of random planes through its pivot until its parts are small, so near rows
    stay together in a table of any size; only parts that planes don't divide are dealt by hash. Each round then gives
    every node a hub with its neighbours and some of the nodes that it is a neighbour of (2 k in all), and members of a hub
    are compared if one of them came in the round before: neighbours of neighbours. Hubs without a new member are left out,
    and only pairs that better what a node has are kept, so rounds ship few rows once the graph is good. Similarities only rise, so rounds end: when less than STILL of the entries are new.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    near = n * (2 * dims + 32) <= HELD
    pivots = nodes.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, HOMES * n // CELL))).collect()
    held = spark.sparkContext.broadcast(np.frombuffer(b"".join(p.packed for p in pivots), np.float16).reshape(-1, dims).astype(np.float32))

    planes = np.random.default_rng(0).normal(size=(BITS, dims)).astype(np.float32)

    def homes(batches):
        import pyarrow as pa

        through = held.value @ planes.T
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column("packed"), dims)
                sims = x @ held.value.T
                near = np.argsort(-sims, axis=1)[:, :HOMES]
                sides = (x @ planes.T)[:, None] - np.take_along_axis(sims, near, 1)[..., None] * through[near] > 0
                place = sides @ (1 << np.arange(BITS, dtype=np.int64))
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.ravel().astype(np.int64)), pa.array(place.ravel())], ["id", "cell", "place"])

    cells = saved(nodes.mapInArrow(homes, "id long, cell long, place long"))
    halves = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.col("count") / (2 * CELL))))).cast("int")
    sizes = cells.groupBy("cell").count().select("cell", halves.alias("halves"))
    placed = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.expr("place & (shiftleft(1L, halves) - 1)"))
    parts = placed.groupBy("cell", "part").count().select("cell", "part", F.ceil(F.col("count") / (2 * CELL)).alias("parts"))
    hub = F.xxhash64("cell", "part", F.pmod(F.xxhash64("id", "cell"), F.col("parts")))
    split = placed.join(parts, ["cell", "part"]).select(hub.alias("hub"), "id")
    none = F.lit(-1.5).cast("float")
    graph = saved(_best(_join_groups(split.join(_held(nodes, n, dims), "id").withColumn("least", none).withColumn("fresh", F.lit(True)), dims, k, 0), k))
    for step in itertools.count(1):
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(none).alias("least")).withColumnRenamed("node", "id")
        fresh = F.col("born") == step - 1
        both = graph.select(F.col("node").alias("hub"), F.col("other").alias("id"), F.lit(0).alias("back"), fresh.alias("fresh")).unionByName(
            graph.select(F.col("other").alias("hub"), F.col("node").alias("id"), F.lit(1).alias("back"), fresh.alias("fresh"))
        )
        chosen = Window.partitionBy("hub").orderBy("back", F.desc("fresh"), F.xxhash64("hub", "id", F.lit(step)), "id")
        members = both.withColumn("r", F.row_number().over(chosen)).filter(F.col("r") <= 2 * k).groupBy("hub", "id").agg(F.max("fresh").alias("fresh"))
        members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("hub"))).filter("any").drop("any")
        known = nodes.join(worst, "id", "left").withColumn("least", F.coalesce("least", none))
        # the windows have dealt the rows by hub, and a broadcast leaves them there
        found = _join_groups(members.join(_held(known, n, dims), "id"), dims, k, step, dealt=near)
        before, graph = graph, saved(_best(graph.unionByName(found), k))
        forget(before)
        if graph.filter(F.col("born") == step).count() <= STILL * k * n:
            return graph.drop("born")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dims: int, k: int, want: int, beam: int | None = None) -> DataFrame:
    """(query, node, sim): the nodes that greedy search from each query's own node finds.

    All queries walk at once: each step opens the OPEN best unopened nodes among the beam best of every query, scores
    their neighbours and keeps twice the beam. When at most LEFT of the beams' nodes are unopened, the beam is
    doubled and the walk goes on, what is left being opened then, until doubling it changed less than SETTLED of the want
    best of all queries: the beam grows with the table. It starts at BEAM times k, as a query starts in its own
    neighbourhood. A step joins the links with the nodes that all queries open, and vectors with what is new; either is
    broadcast while it is small, and both are shuffled beyond.
    """
    n, asked = nodes.count(), queries.count()
    beam = beam or BEAM * k
    links = graph.select("node", "other").unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "other"), "other")
    links = saved(links.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * k).drop("r"))

    def similar(batches):
        import pyarrow as pa

        for batch in batches:
            sims = (_unpack(batch.column("packed"), dims) * _unpack(batch.column("target"), dims)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(sims.astype(np.float32))], ["query", "node", "sim"])

    best = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    walk = queries.select(F.col("id").alias("query"), F.col("id").alias("node"), F.lit(1.0).cast("float").alias("sim"), F.lit(False).alias("opened"), F.lit(0).alias("born"))
    walk = saved(walk.withColumns({"r": F.lit(1), "turn": F.lit(1)}))
    targets = queries.select(F.col("id").alias("query"), F.col("packed").alias("target"))
    still = 0
    for step in itertools.count(1):
        now = ~F.col("opened") & (F.col("r") <= beam) & (F.col("turn") <= OPEN)
        opened = walk.filter(now).select("query", "node")
        reached = (F.broadcast(opened) if asked * OPEN <= OPENED else opened).join(links, "node").select("query", F.col("other").alias("node"), F.lit(False).alias("known"))
        seen = reached.unionByName(walk.select("query", "node", F.lit(True).alias("known"))).groupBy("query", "node").agg(F.max("known").alias("known"))
        scored = seen.filter(~F.col("known")).join(_held(nodes.select(F.col("id").alias("node"), "packed"), n, dims), "node").join(_held(targets, asked, dims), "query").select("query", "node", "packed", "target").mapInArrow(similar, "query long, node long, sim float")
        merged = walk.withColumn("opened", F.col("opened") | now).drop("r", "turn").unionByName(scored.withColumns({"opened": F.lit(False), "born": F.lit(step)}))
        turn = F.sum(F.when(F.col("opened"), 0).otherwise(1)).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        before, walk = walk, saved(merged.withColumns({"r": F.row_number().over(best), "turn": turn}).filter(F.col("r") <= 2 * beam))
        forget(before)
        held, top = F.col("r") <= beam, F.col("r") <= want
        count = lambda c: F.count(F.when(c, 1))
        unopened, size, changed, answers = walk.agg(count(held & ~F.col("opened")), count(held), count(top & (F.col("born") == step)), count(top)).first()
        still = still + 1 if step > 1 and changed <= SETTLED * answers else 0
        if still == 2 or not unopened:
            return walk.filter(F.col("r") <= EXACT * want).select("query", "node", "sim")
        beam *= 2


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest others by cosine of each row with vec_id divisible by every.

    Equal vectors form one class with its smallest id as node, so the graph isn't filled by copies; the k + 1 smallest
    ids of each class are enough for any answer. Every class is in the graph, which holds 16-bit unit vectors; what the
    search finds is scored anew on the original vectors in double precision. Ties go to the smaller vec_id; a repeated
    vec_id counts once with each of its vectors; a shorter vector counts as padded with zeros; vectors that are null, zero
    or hold null or non-finite components and rows without vec_id take no part; other columns are ignored; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    dims = rows.agg(F.max(F.size("vec"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], shape)
    rows = rows.select("id", F.concat("vec", F.array_repeat(F.lit(0.0), dims - F.size("vec"))).alias("vec"))
    rows = saved(rows.withColumn("mark", F.md5(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))))))
    first = Window.partitionBy("mark").orderBy("id")
    small = rows.select("mark", "id").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    heads = small.groupBy("mark").agg(F.min("id").alias("head"))
    members = saved(small.join(heads, "mark").select("head", F.col("id").alias("vec_id")))

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_pack(_unit(matrix(batch.column("vec"), dims))), pa.binary())], ["id", "packed"])

    exact = saved(rows.join(heads, (rows["mark"] == heads["mark"]) & (rows["id"] == heads["head"]), "left_semi").groupBy("id").agg(F.first("vec").alias("vec")))
    nodes = saved(exact.mapInArrow(packed, "id long, packed binary"))
    asked = saved(rows.filter(F.col("id") % every == 0).join(heads, "mark").select(F.col("id").alias("query_id"), "head").distinct())
    wide = width(nodes.count())
    graph = build_graph(nodes, dims, wide)
    found = search(graph, nodes, saved(nodes.join(asked.select(F.col("head").alias("id")).distinct(), "id", "left_semi")), dims, wide, k + 1)
    # whole classes by exact score: the best k + 1 classes of a head, and those equal to the last, hold its k best rows
    a, b = exact.select(F.col("id").alias("query"), F.col("vec").alias("x")), exact.select(F.col("id").alias("node"), F.col("vec").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    scored = found.join(a, "query").join(b, "node").select("query", "node", (dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))).alias("score"))
    scored = scored.withColumn("r", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1).drop("r")
    rows_found = asked.join(scored, F.col("head") == F.col("query")).drop("head").join(members, F.col("node") == F.col("head"))
    rows_found = rows_found.filter(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows_found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_query(spark, sf_dir):
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
