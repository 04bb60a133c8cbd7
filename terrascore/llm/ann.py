"""Approximate nearest neighbours by adaptive dimension scans.

Vectors are turned by a random orthogonal matrix, so that any leading part of the dimensions stands for all, and dealt
into inverted lists by k-means centres; within a list they are kept as blocks of columns. A query scans the blocks of its
probed lists a few dimensions at a time. With d of D dimensions seen, the partial squared distance times D/d estimates
the whole; a candidate whose estimate exceeds the query's bound by more than the hypothesis test allows,

    partial > bound^2 * d/D * (1 + EPSILON / sqrt(d))^2,

is abandoned. What survives all dimensions is ranked by its distance on the original vectors in double precision.

A query's first bound is its k-th distance in the sample that the centres were fitted on: it is above its true k-th
distance, whatever lists are probed. In each block of a list it tightens to the k-th distance found so far. Centres,
matrix and the number of probed lists come from a bounded sample of at most ``SAMPLE`` rows (those of smallest hash of
their id); the number of lists is the least with which the sample's own queries reach ``TARGET`` recall within the sample.
A query probes those and the lists of the sample rows that its first bound comes from, so it always finds k rows if there
are as many. Every row is indexed.

Queries stay in Spark: their lists and bounds are found in tasks, and rows and queries of a list meet by a shuffle. A
list of more than ``BLOCK_ROWS`` rows, or ``BLOCK_QUERIES`` queries, is cut into blocks of each by a hash, however many
equal vectors it has; each pair of blocks is one group and returns at most k rows a query.

Vectors that are null, empty, all zero, of another length than most, or hold a null or non-finite component take no part.
Equal distances rank by smaller id. Rows that repeat an id are candidates each; as a query such an id counts once, with
its smallest vector, and none of its rows is a candidate of it. A null id takes no part. An empty table gives an empty
result. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, stored

SAMPLE = 8000
TARGET = 0.98
EPSILON = 3.0
STEP = 8
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Rows of a block that are scanned before the bounds of its queries tighten.
ROWS_AT_ONCE = 512


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part, but for their length."""
    v = rows[vec_col].cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(rows[id_col].isNotNull() & (F.size(v) > 0) & good).select(rows[id_col].cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(c), -1) if len(c) else np.empty((0, 0))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


class Plan:
    """What a search needs from the sample: rotation, centres, and the lists to probe."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ids = ids
        n, dim = sample.shape
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        x = sample @ self.turn
        lists = max(1, min(256, int(n**0.5)))
        centres = x[rng.permutation(n)[:lists]]
        for _ in range(8):
            own = _squared(x, centres).argmin(1)
            sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=lists)
            np.add.at(sums, own, x)
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        self.centres, self.sample, self.k = centres, x, k
        self.own = own = _squared(x, centres).argmin(1)
        trial = rng.permutation(n)[: min(n, 300)]
        near = _squared(x[trial], x)
        near[np.arange(len(trial)), trial] = np.inf
        true = np.argsort(near, axis=1)[:, : min(k, max(n - 1, 1))]
        rank = np.argsort(np.argsort(_squared(x[trial], centres), axis=1), axis=1)
        need = np.sort(rank[np.arange(len(trial))[:, None], own[true]].ravel()) + 1
        self.probes = int(min(lists, need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))])) if len(need) else lists

    def bounds(self, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
        """Squared k-th distance (rounded up) of each turned query to the sample's rows of other ids, or infinity if these are
        fewer, and the lists of the rows it comes from."""
        every = set(range(len(self.centres)))
        kth, lists = [np.empty(0)], []
        for i in range(0, len(queries), 256):
            d = _squared(queries[i : i + 256], self.sample)
            d[ids[i : i + 256, None] == self.ids[None, :]] = np.inf
            top = np.argpartition(d, min(self.k, d.shape[1]) - 1, axis=1)[:, : self.k]
            far = np.take_along_axis(d, top, axis=1).max(1) if d.shape[1] >= self.k else np.full(len(d), np.inf)
            kth.append(far)
            lists += [set(x) if np.isfinite(f) else every for x, f in zip(self.own[top].tolist(), far, strict=True)]
        # rounding in either way of computing a distance is far below this, so equal vectors are never lost
        return np.concatenate(kth) * (1 + 1e-9) + 1e-9 * (queries * queries).sum(1), lists


def scan(block: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Rows of a column block (dimensions x rows) that no test abandons."""
    dim, n = block.shape
    alive, partial = np.arange(n), np.zeros(n)
    for d in range(0, dim, STEP):
        part = block[d : d + STEP] if len(alive) == n else block[d : d + STEP, alive]
        partial = partial + ((part - query[d : d + STEP, None]) ** 2).sum(0)
        seen = min(d + STEP, dim)
        limit = bound if seen == dim else bound * seen / dim * (1 + EPSILON / seen**0.5) ** 2
        ok = partial <= limit * (1 + 1e-9)
        if not ok.all():
            alive, partial = alive[ok], partial[ok]
        if not len(alive):
            break
    return alive


def search_block(ids: np.ndarray, v: np.ndarray, block: np.ndarray, query_id: int, query: np.ndarray, turned: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of a block's rows found for a query; the bound tightens as rows are found."""
    best_id, best = np.empty(0, np.int64), np.empty(0)
    slack = 1e-9 * float(query @ query)
    for x in range(0, len(ids), ROWS_AT_ONCE):
        at = x + scan(block[:, x : x + ROWS_AT_ONCE], turned, bound)
        at = at[ids[at] != query_id]
        if len(at):
            best_id = np.concatenate([best_id, ids[at]])
            best = np.concatenate([best, np.sqrt(((v[at] - query) ** 2).sum(1))])
            top = np.lexsort((best_id, best))[:k]
            best_id, best = best_id[top], best[top]
            if len(best) == k:
                bound = min(bound, best[-1] ** 2 * (1 + 1e-9) + slack)
    return best_id, best


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each query row, ``is_query`` being a function of the id column."""
    rows = usable(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    schema = "query_id long, rank int, id long, score double"
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims["dim"])
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow()
    shared = spark.sparkContext.broadcast(Plan(few.column("id").to_numpy(), matrix(few.column("v")), k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            x = matrix(b.column(1)) @ plan.turn if b.num_rows else np.empty((0, len(plan.turn)))
            own = np.concatenate([_squared(x[i : i + 4096], plan.centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], ["id", "v", "list"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1)) @ plan.turn
            probed = np.argsort(_squared(q, plan.centres), axis=1)[:, : plan.probes].tolist()
            bound, also = plan.bounds(b.column(0).to_numpy(), q)
            lists = pa.array([sorted(also[i].union(x)) for i, x in enumerate(probed)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound), lists], ["query_id", "q", "bound", "lists"])

    index = stored(rows.mapInArrow(assign, "id long, v array<double>, list int"), "vectors")
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    asked = queries.mapInArrow(ask, "query_id long, q array<double>, bound double, lists array<int>")
    asked = stored(asked.select("query_id", "q", "bound", F.explode("lists").alias("list")), "queries")
    # one row a list, of which there are as many as the plan has centres
    deal = lambda key, n: F.pmod(F.xxhash64(key, F.lit(9)), n).cast("int")
    size = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    size = size.join(asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns")), "list")
    size = F.broadcast(cut(size))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.join(size, "list").withColumn("part", deal("id", F.col("parts"))).select("id", "v", "list", "part", every(F.col("turns")).alias("turn"))
    right = asked.join(size, "list").withColumn("turn", deal("query_id", F.col("turns"))).select("query_id", "q", "bound", "list", "turn", every(F.col("parts")).alias("part"))

    def search(t: pa.Table, asking: pa.Table) -> pa.Table:
        plan, found = shared.value, []
        if t.num_rows and asking.num_rows:
            ids, v, q, qid, bound = t.column("id").to_numpy(), matrix(t.column("v")), matrix(asking.column("q")), asking.column("query_id").to_numpy(), asking.column("bound").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            block, turned = np.ascontiguousarray((v @ plan.turn).T), q @ plan.turn
            for i in range(len(qid)):
                own, dist = search_block(ids, v, block, int(qid[i]), q[i], turned[i], float(bound[i]), k)
                found.append((np.full(len(own), qid[i]), own, dist))
        parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({name: pa.array(x) for name, x in zip(("query_id", "id", "score"), parts, strict=True)})

    key = ["list", "part", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
