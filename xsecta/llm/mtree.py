"""Exact top-k search by inner product: an M-tree of paged metric nodes, searched best-first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import matrix, saved

#: Root routing objects at most (a bounded sample), rows of a page (in expectation), entries of a leaf, queries of a block.
ROOTS, PAGE, LEAF, BLOCK = 4096, 4096, 64, 8192
#: Rounding of bounds, far above that of any sum of a vector's terms: relative in squared distances, and in distances.
SLACK = 1e-12


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id and q = floor(scale * x) of each usable vector: not null or empty, without null or non-finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good
    return vectors.select(F.col("vec_id").alias("id"), "embedding").filter(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        "id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")
    )


def _lifted(q: np.ndarray, top: float) -> np.ndarray:
    """The vectors with one more coordinate that gives all the same norm, so that near means large inner product."""
    q = q.astype(float)
    return np.column_stack([q, np.sqrt(np.maximum(0, top - (q * q).sum(1)))])


def _limit(least, norm, top: float):
    """The distance from a lifted query of squared norm norm within which all rows of a score of at least `least` lie.

    Distances d satisfy d^2 = norm + top - 2 * score. All rounding is relative to norm + top, so SLACK of it is added: a
    wider limit costs comparisons, never results.
    """
    return np.sqrt(np.maximum(0.0, norm + top - 2.0 * least) + SLACK * (norm + top)) + SLACK * (np.sqrt(norm) + np.sqrt(top))


def _split(x: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Routing objects drawn from x, one for about size rows, and the rows nearest to each."""
    m = max(1, -(-len(x) // size))
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), m, replace=False))]
    owner = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(m + 1))
    return centres, [order[bounds[i] : bounds[i + 1]] for i in range(m)]


class Directory:
    """The tree's upper levels: nodes of root routing objects, each with covering radius and parent distance."""

    def __init__(self, roots: np.ndarray, radius: np.ndarray):
        self.roots, self.radius = roots, radius
        self.centres, self.parts = _split(roots, max(1, int(np.sqrt(len(roots)))), 0)
        self.parent = np.concatenate([np.linalg.norm(roots[p] - c, axis=1) for c, p in zip(self.centres, self.parts)])
        at = np.cumsum([0] + [len(p) for p in self.parts])
        self.parent = [self.parent[a:b] for a, b in zip(at[:-1], at[1:])]
        self.reach = np.array([(d + radius[p]).max() if len(p) else -np.inf for d, p in zip(self.parent, self.parts)])

    def search(self, lifted: np.ndarray, limit: float) -> np.ndarray:
        """Roots whose ball comes within limit of a query; a stored parent distance rules out before one is computed."""
        near = np.linalg.norm(self.centres - lifted, axis=1)
        out = []
        for i in np.flatnonzero(near - self.reach <= limit):
            p = self.parts[i]
            p = p[np.abs(near[i] - self.parent[i]) - self.radius[p] <= limit]
            out.append(p[np.linalg.norm(self.roots[p] - lifted, axis=1) - self.radius[p] <= limit])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class Page:
    """An M-tree of two levels: leaves of up to about LEAF entries, each with routing object, radius and parent distance."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, q: np.ndarray, top: float):
        self.keys, self.ids, self.q = keys, ids, q
        x = _lifted(q, top)
        self.pivot = x.mean(0)
        self.centres, self.parts = _split(x, LEAF, len(ids))
        self.reach = [np.linalg.norm(x[p] - c, axis=1) for c, p in zip(self.centres, self.parts)]
        self.radius = np.array([r.max() if len(r) else -np.inf for r in self.reach])
        self.parent = np.linalg.norm(self.centres - self.pivot, axis=1)

    def search(self, query: np.ndarray, own: int, k: int, least: int | None, top: float) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the one with key own; those below least may be missing.

        A leaf is opened in order of its bound d(query, centre) - radius; the stored parent distance rules leaves out before
        that distance is computed, and each entry's stored distance rules it out before its score is.
        """
        norm = float((query.astype(float) ** 2).sum())
        lifted = np.append(query.astype(float), 0.0)
        to_pivot = np.linalg.norm(lifted - self.pivot)
        limit = np.inf if least is None else _limit(float(least), norm, top)
        near = np.flatnonzero(np.abs(to_pivot - self.parent) - self.radius <= limit)
        distance = np.linalg.norm(self.centres[near] - lifted, axis=1)
        bound = distance - self.radius[near]
        queue = np.argsort(bound, kind="stable")
        best_s, best_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 1
        while at < len(queue) and bound[queue[at]] <= limit:
            opened = [i for i in queue[at : at + step] if bound[i] <= limit]
            at, step = at + step, step * 2
            part = np.concatenate([self.parts[near[i]][np.abs(distance[i] - self.reach[near[i]]) <= limit] for i in opened])
            part = part[self.keys[part] != own]
            scores = np.concatenate([best_s, self.q[part] @ query])
            ids = np.concatenate([best_v, self.ids[part]])
            keep = np.lexsort((ids, -scores))[:k]
            best_s, best_v = scores[keep], ids[keep]
            if len(best_s) == k:
                limit = min(limit, _limit(float(best_s[-1]), norm, top))
        return list(zip(best_s.tolist(), best_v.tolist()))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with vec_id divisible by every, the k others of largest inner product.

    The tree's top is a Directory of at most ROOTS routing objects, a bounded sample; rows go to the nearest one, and a root
    with more than PAGE rows is dealt into several pages by hash, so no page grows with the data. Each query is first
    searched in its own page, which gives a score that its results reach. The directory then names the roots whose balls
    let it do better; their pages are searched best-first, each by blocks of at most about BLOCK queries.

    Scores must fit into a long. Ties go to the smaller vec_id; rows of one vec_id all take part, each as a query and as a
    candidate of the others; a shorter vector counts as padded with zeros. Null or empty vectors, those with null or
    non-finite components and rows without vec_id are neither queries nor candidates; other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = saved(quantised(vectors, scale).withColumn("key", F.monotonically_increasing_id()))
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    sizes = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("q")).alias("dims")).first()
    shape = "query_id long, rank int, vec_id long, score long"
    if not sizes.n:
        return spark.createDataFrame([], shape)
    dims, top = sizes.dims, sizes.top
    rows = rows.select("key", "id", F.concat("q", F.array_repeat(F.lit(0).cast("long"), dims - F.size("q"))).alias("q"))
    n_roots = min(ROOTS, -(-sizes.n // PAGE))
    roots = _lifted(np.array([r.q for r in rows.orderBy(F.xxhash64("id"), "key").limit(n_roots).collect()], float), top)
    held = spark.sparkContext.broadcast(roots)

    def nearest(batches):
        import pyarrow as pa

        r = held.value
        for batch in batches:
            if batch.num_rows:
                x = _lifted(matrix(batch.column("q"), dims), top)
                root = ((r * r).sum(1) - 2 * x @ r.T).argmin(1)
                reach = np.linalg.norm(x - r[root], axis=1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "id", "q")], pa.array(root.astype("int32")), pa.array(reach)], ["key", "id", "q", "root", "reach"])

    placed = saved(rows.mapInArrow(nearest, "key long, id long, q array<long>, root int, reach double"))
    counts = placed.groupBy("root").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages"), F.max("reach").alias("radius"))
    dealt = placed.drop("reach").join(F.broadcast(counts.select("root", "pages")), "root").withColumn("page", F.pmod(F.xxhash64("key"), F.col("pages")).cast("int"))
    known = counts.orderBy("root").collect()  # at most ROOTS rows
    used = np.array([r.root for r in known])
    upper = spark.sparkContext.broadcast((Directory(roots[used], np.array([r.radius for r in known])), used, [r.pages for r in known]))

    def build(got):
        import pickle

        import pyarrow as pa

        got = got.sort_by("key")
        page = Page(got.column("key").to_numpy(), got.column("id").to_numpy(), matrix(got.column("q").combine_chunks(), dims).astype(np.int64), top)
        return pa.table({"root": got.column("root")[:1], "page": got.column("page")[:1], "tree": pa.array([pickle.dumps(page)], pa.binary())})

    pages = saved(dealt.groupBy("root", "page").applyInArrow(build, "root int, page int, tree binary"))
    queries = saved(dealt.filter(F.col("id") % every == 0).select("key", "id", "q", "root", "page"))

    def search_page(got_page, got_queries):
        import pickle

        import pyarrow as pa

        out = []
        if got_page.num_rows and got_queries.num_rows:
            page = pickle.loads(got_page.column("tree")[0].as_py())
            for key, qid, q, least in zip(*(got_queries.column(c).to_pylist() for c in ("key", "id", "q", "least"))):
                out += [(key, qid, v, s) for s, v in page.search(np.array(q, np.int64), key, k, least, top)]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("key", "query_id", "vec_id", "score"), columns)})

    found_shape = "key long, query_id long, vec_id long, score long"
    blocks = F.lit(max(1, -(-queries.count() // BLOCK)))
    first = queries.withColumn("least", F.lit(None).cast("long")).withColumn("block", F.lit(0))
    seeds = saved(pages.groupBy("root", "page").cogroup(first.groupBy("root", "page")).applyInArrow(search_page, found_shape))
    floor = seeds.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded = queries.join(floor, "key", "left").withColumn("block", F.pmod(F.xxhash64("key", F.lit(9)), blocks).cast("int"))

    def route(batches):
        """One row for each query and page that may better it, but for the query's first page."""
        import pyarrow as pa

        directory, used, n_pages = upper.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q = matrix(batch.column("q"), dims)
            where, root, page = [], [], []
            for i, (least, own) in enumerate(zip(batch.column("least").to_pylist(), zip(batch.column("root").to_pylist(), batch.column("page").to_pylist()))):
                limit = np.inf if least is None else _limit(float(least), float((q[i] * q[i]).sum()), top)
                for j in directory.search(np.append(q[i], 0.0), limit).tolist():
                    more = [p for p in range(n_pages[j]) if (used[j], p) != own]
                    where += [i] * len(more)
                    root += [used[j]] * len(more)
                    page += more
            rows_ = batch.take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[rows_.column(c) for c in ("key", "id", "q", "least", "block")], pa.array(root, pa.int32()), pa.array(page, pa.int32())], ["key", "id", "q", "least", "block", "root", "page"])

    routed = saved(bounded.mapInArrow(route, "key long, id long, q array<long>, least long, block int, root int, page int"))
    asked = routed.select(F.col("root").alias("r"), F.col("page").alias("p"), F.col("block").alias("b")).distinct()
    sent = pages.join(asked, (F.col("root") == F.col("r")) & (F.col("page") == F.col("p"))).select("r", "p", "b", "tree")
    rest = sent.groupBy("r", "p", "b").cogroup(routed.groupBy("root", "page", "block")).applyInArrow(search_page, found_shape)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = seeds.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_query(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row <> b.row
  WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
