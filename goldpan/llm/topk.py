r"""Exact top-k search by inner product, with a pivot table.

Components become floor(scale * x), so all scores are integers. ``PIVOTS`` rows are pivots, chosen
far apart from each other among at most ``SAMPLE`` rows, those with the least hashes of their ids.
Every row's distances to all pivots are computed once and written, the pivot table: a byte each, in
steps of one width, which keeps |d(q, p) - d(x, p)| up to a step. By the triangle inequality no
distance d(q, x) is less than the largest of these differences. As 2 <q, x> = |q|^2 + |x|^2 -
d(q, x)^2, that lower bound on the distance is an upper bound on the score.

Each query takes rows in the order of its own bounds and scores them until its k-th best score is
above all bounds that are left: the search is exact. It goes over the table twice. The first
time a query scores only the ``FIRST`` rows of largest bound in each batch; merged over all batches
these fix a k-th score that the second time every batch starts from, so that only rows whose bound
still reaches it are scored. Equal scores go on, as ties go to the smaller id.

Plan: queries are dealt in blocks of about ``QUERIES`` by a hash, a block is broadcast, and the written
table is read where it lies: rows are neither copied nor shuffled. A task returns k rows for each query
and batch at most, and a window merges them. Pivots are PIVOTS vectors whatever the input.

On vectors without structure in 64 dimensions the bounds settle little, since all distances are
nearly alike; the README has figures. The result is exact in any case.

Edges: vectors that are null or empty, or hold a null or a non-finite component, take no part, and
neither do rows without an id. Vectors of fewer components end in zeros. Rows with the same vec_id
are one item with the best of their scores. A zero vector takes part. Where there are fewer than k
candidates all are returned. Components of 2**53 / scale and more, and scores that don't fit a long,
are an error. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.llm.ann import merged
from goldpan.llm.vectors import finite, kept, matrix, width
from goldpan.scratch import Scratch

PIVOTS, SAMPLE = 512, 4096
QUERIES, ROWS = 16384, 2048
#: Rows that a query scores in a batch the first time, and between two looks at its bounds.
FIRST, STEP = 32, 128


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with the rows of b."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 1 << 53:  # sums of doubles are exact there
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound >= 1 << 63:
        raise OverflowError("inner products that don't fit a long")
    return a @ b.T


class Pivots:
    """Vectors far apart, and the steps in which distances to them are told."""

    def __init__(self, sample: np.ndarray, n: int):
        x = sample.astype(np.float64)
        at, near = [], np.full(len(x), np.inf)
        while len(at) < min(n, len(x)):
            at.append(int(near.argmax()) if at else 0)  # the farthest from all so far
            near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(axis=1))
        self.rows = x[at]
        d = distances(x, self.rows) if at else np.zeros((1, 0))
        self.low = d.min(axis=0)
        self.width = max(float((d.max(axis=0) - self.low).max(initial=0)) / 254, 1e-9)

    def table(self, x: np.ndarray) -> np.ndarray:
        """Bytes, a row for each row of x. Distances beyond the sample's are told as its farthest."""
        return np.clip((distances(x, self.rows) - self.low) / self.width, 0, 255).astype(np.uint8)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row for each row of x."""
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def upper_bounds(q: np.ndarray, dq: np.ndarray, x: np.ndarray, dx: np.ndarray, step: float) -> np.ndarray:
    """No score of a query (row) with a row (column) is above this. dq, dx: their rows of the pivot table."""
    most = np.zeros((len(q), len(x)), np.uint8)
    for a, b in zip(dq.T, np.ascontiguousarray(dx.T)):
        a = a[:, None]
        np.maximum(most, np.maximum(a, b) - np.minimum(a, b), out=most)
    nq, nx = (q.astype(np.float64) ** 2).sum(1), (x.astype(np.float64) ** 2).sum(1)
    # A byte is up to a step too small, and distances are rounded: give way by more than that.
    lower = (most.astype(np.float64) - 1) * step - 1e-6 * (1 + np.sqrt(nq)[:, None] + np.sqrt(nx))
    lower = np.maximum(lower, 0)
    return (nq[:, None] + nx - lower * lower) / 2 + 1e-9 * (nq[:, None] + nx) + 1e-6


def top_in_batch(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, kth: np.ndarray, k: int, first: int | None = None):
    """(query_id, vec_id, score, scored): of each query the k best rows with another id whose score reaches kth,
    found in the order of its own bounds; how many pairs were scored. first: look at so many rows alone."""
    out, scored = [], 0
    for i in range(len(q)):
        at, least = np.flatnonzero(bound[i] >= kth[i]), kth[i]
        if first is not None and len(at) > first:
            at = at[np.argpartition(-bound[i][at], first - 1)[:first]]
        at = at[np.argsort(-bound[i][at], kind="stable")]
        s, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low in range(0, len(at), STEP):
            part = at[low : low + STEP]
            part = part[bound[i][part] >= least]
            if not len(part):
                break
            new = inner(q[i : i + 1], x[part])[0]
            scored += len(part)
            good = (new >= least) & (ids[part] != q_ids[i])
            s, v = kept(np.concatenate([s, new[good]]), np.concatenate([v, ids[part][good]]), k)
            if len(s) == k:
                least = max(least, s[-1])
        out.append((np.full(len(s), q_ids[i]), v, s))
    return *(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [[], [], []])), scored


FOUND = "query_id long, vec_id long, score long"


def search(table: DataFrame, block: pa.Table, dim: int, step: float, k: int, scratch: Scratch) -> DataFrame:
    """table: id, v, d. The k best rows or more of each query in the block, unmerged."""
    spark = table.sparkSession
    ids, q = block.column("id").to_numpy(), matrix(block.column("v"), dim).astype(np.int64)
    dq = np.array([np.frombuffer(d.as_py(), np.uint8) for d in block.column("d")])
    none = np.iinfo(np.int64).min

    def one_pass(kth: np.ndarray, first: int | None) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, q, dq, kth))  # about QUERIES rows

        def run(batches):
            ids, q, dq, kth = shared.value
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = batch.slice(low, ROWS)
                    x, own = matrix(part.column(1), dim).astype(np.int64), part.column(0).to_numpy()
                    dx = np.array([np.frombuffer(d.as_py(), np.uint8) for d in part.column(2)])
                    for at in range(0, len(q), 512):
                        some = slice(at, at + 512)
                        bound = upper_bounds(q[some], dq[some], x, dx, step)
                        found = top_in_batch(ids[some], q[some], own, x, bound, kth[some], k, first)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found[:3]], names=["query_id", "vec_id", "score"])

        return table.select("id", "v", "d").mapInArrow(run, FOUND)

    started = merged(one_pass(np.full(len(ids), none), FIRST), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    reached = {r["query_id"]: r["kth"] for r in started.collect() if r["n"] == k}  # about QUERIES rows
    return scratch.table(one_pass(np.array([reached.get(i, none) for i in ids.tolist()], np.int64), None), "found")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, n_pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of every row that is_query tells, the k largest integer inner products."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    x = F.col(vec_col)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    valid = vectors.where(F.col(id_col).isNotNull() & finite(x))
    valid = valid.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    large = F.exists("v", lambda c: F.abs(c) >= F.lit(1 << 53))
    valid = valid.withColumn("v", F.when(large, F.raise_error(F.lit("a component is too large for exact scores"))).otherwise(F.col("v")))
    valid = scratch.table(valid, "vectors")
    dim = width(valid, "v")
    sample = valid.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(SAMPLE).toArrow()
    pivots = Pivots(matrix(sample.column("v"), dim) if sample.num_rows else np.zeros((0, max(dim, 1))), n_pivots)
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS rows

    def told(batches):
        for batch in batches:
            d = shared.value.table(matrix(batch.column(1), dim)) if batch.num_rows else np.zeros((0, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in d], pa.binary())], names=["id", "v", "q", "d"])

    table = scratch.table(valid.mapInArrow(told, "id long, v array<long>, q boolean, d binary"), "pivot-table")
    scratch.drop(valid)
    queries = table.where("q").dropDuplicates(["id", "v"])
    blocks = max(1, -(-queries.count() // QUERIES))
    queries = scratch.table(queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))), "queries")
    found = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        block = queries.where(F.col("block") == b).select("id", "v", "d").toArrow()
        if block.num_rows:
            found = found.unionByName(search(table, block, dim, pivots.width, k, scratch))
    return merged(found, k)


def op9_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every vector whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)
