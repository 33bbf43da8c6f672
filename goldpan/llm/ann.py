r"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is padded to a power of two and goes through three rounds of random signs and a fast
Hadamard transform, a pseudo-rotation. Its nearest signed axis is twice the position of the
largest component, plus 1 if that is negative; a table's hash is the pair of two such axes. Every row
is indexed in all ``TABLES`` tables. A query probes in every table the buckets of largest value, that
is, the pairs of axes it is nearest to. What lies in a probed bucket is a candidate, and all
candidates are reranked by their exact cosine in double precision.

How many buckets are probed is fitted on a sample of at most ``SAMPLE`` rows, those with the least
hashes of their ids: the fewest with which the sample's own neighbours are found ``AIM`` of the
times. Neighbours in a sample are farther than in the whole table and so harder to find; recall on
the whole is higher. At least about 64 candidates are expected of each query. A query that finds
fewer than k is asked again with all buckets probed.

Plan: the index, each row's hashes beside its vector, is computed once, written and read where it
lies: rows are neither copied nor shuffled, so no bucket is hot, whatever repeats. Queries are dealt in
blocks of about ``QUERIES`` by a hash; a block is broadcast with its probes as a bit for every query in
every bucket, and a row's candidates are the OR of its buckets' words. A task keeps k rows for each
query, by running k-th score, and a window merges the tasks'.

Edges: vectors that are null, empty or zero, or hold a null or a non-finite component, take no part,
and neither do rows without an id. Vectors of fewer components end in zeros. Rows with the same
vec_id are one item with the best of their cosines. Ties go to the smaller vec_id. Where there are
fewer than k candidates all are returned. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldpan.llm.vectors import finite, kept, matrix, width
from goldpan.scratch import Scratch

SAMPLE, SAMPLE_QUERIES, AIM = 4096, 256, 0.94
TABLES = 48
QUERIES, ROWS = 512, 2048
#: Scores closer than this are told apart by sums in a fixed order.
SLACK = 1e-9


class Hashes:
    """The pseudo-rotations of all tables: ``tables`` x ``hashes`` of three rounds each."""

    def __init__(self, dim: int, tables: int = TABLES, hashes: int = 2, seed: int = 7):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.hashes = tables, hashes
        signs = np.random.default_rng(seed).integers(0, 2, (tables, hashes, 3, self.size))
        self.signs = 2.0 * signs - 1.0
        self.buckets = (2 * self.size) ** hashes

    def rotated(self, unit: np.ndarray, table: int, which: int) -> np.ndarray:
        y = np.zeros((len(unit), self.size))
        y[:, : unit.shape[1]] = unit
        for signs in self.signs[table, which]:
            y *= signs
            step = 1
            while step < self.size:  # the fast Hadamard transform
                pairs = y.reshape(len(y), -1, 2, step)
                a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
                pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
                step *= 2
            y /= np.sqrt(self.size)
        return y

    def bucket(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), np.int64)
        for which in range(self.hashes):
            y = self.rotated(unit, table, which)
            axis = np.abs(y).argmax(axis=1)
            code = code * (2 * self.size) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return code

    def values(self, unit: np.ndarray, table: int) -> np.ndarray:
        """For each vector the value of every bucket, the larger the nearer."""
        total = np.zeros((len(unit), 1))
        for which in range(self.hashes):
            y = self.rotated(unit, table, which)
            signed = np.stack([y, -y], axis=2).reshape(len(y), -1)
            total = (total[:, :, None] + signed[:, None, :]).reshape(len(y), -1)
        return total

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        values = self.values(unit, table)
        n = min(n, values.shape[1])
        return np.argpartition(-values, n - 1, axis=1)[:, :n] if n < values.shape[1] else np.tile(np.arange(n), (len(unit), 1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Scaled to length 1; the largest component goes first, so no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_probes(h: Hashes, x: np.ndarray, k: int, aim: float = AIM) -> int:
    """The fewest probes that find a share ``aim`` of the k nearest within x."""
    n = len(x)
    if n < 2:
        return h.buckets
    unit = unit_rows(x)
    q = np.arange(0, n, max(1, n // SAMPLE_QUERIES))
    s = unit[q] @ unit.T
    s[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, n - 1)]
    rank = np.full(near.shape, h.buckets)  # with how many probes is each found?
    for t in range(h.tables):
        values, at = h.values(unit[q], t), h.bucket(unit, t)
        own = np.take_along_axis(values, at[near], axis=1)
        rank = np.minimum(rank, np.stack([(values > own[:, [j]]).sum(axis=1) for j in range(near.shape[1])], axis=1) + 1)
    return int(np.sort(rank, axis=None)[min(rank.size - 1, int(np.ceil(aim * rank.size)))])


def bit_table(probed: np.ndarray, buckets: int) -> np.ndarray:
    """probed: (query, table, probe). (table, bucket, word): a bit for every query that probes the bucket."""
    n, tables, _ = probed.shape
    out = np.zeros((tables, buckets, -(-n // 64)), np.uint64)
    query = np.arange(n)
    bit = np.uint64(1) << (query % 64).astype(np.uint64)
    for t in range(tables):
        np.bitwise_or.at(out[t], (probed[:, t], (query // 64)[:, None]), bit[:, None])
    return out


class Nearest:
    """The k best rows so far of each query of a block."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, bits: np.ndarray | None, k: int):
        self.ids, self.unit, self.bits, self.k = ids, unit, bits, k
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        self.scored = 0

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """(query, row) as booleans. Without bits every row is one."""
        if self.bits is None:
            return np.ones((len(self.ids), len(codes)), bool)
        found = self.bits[0][codes[:, 0]]
        for t in range(1, codes.shape[1]):
            found |= self.bits[t][codes[:, t]]
        return np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)].astype(bool).T

    def add(self, ids: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        for i, near in enumerate(self.candidates(codes)):
            s, v = self.best[i]
            at = np.flatnonzero(near & (ids != self.ids[i]))
            self.scored += len(at)
            least = s[-1] if len(s) == self.k else -np.inf
            at = at[unit[at] @ self.unit[i] >= least - SLACK]
            if len(at):
                exact = (unit[at] * self.unit[i]).sum(axis=1)  # one order of adding for all, so copies tie
                self.best[i] = kept(np.concatenate([s, exact]), np.concatenate([v, ids[at]]), self.k)

    def rows(self) -> pa.RecordBatch:
        found = [np.concatenate(c) if c else np.zeros(0) for c in zip(*[(np.full(len(s), q), v, s) for q, (s, v) in zip(self.ids, self.best)])] or [np.zeros(0)] * 3
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(found, kinds)], names=["query_id", "vec_id", "score"])


def indexed(vectors: DataFrame, h: Hashes, dim: int) -> DataFrame:
    """vectors: id, v, q. The same with codes, the bucket in every table as 32-bit numbers."""
    shared = vectors.sparkSession.sparkContext.broadcast(h)  # its size depends on the dimension alone

    def run(batches):
        hashes = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                unit = unit_rows(matrix(part.column(1), dim))
                codes = np.stack([hashes.bucket(unit, t) for t in range(hashes.tables)], axis=1).astype("<u4")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "q", "codes"])

    return vectors.mapInArrow(run, f"id long, v {vectors.schema['v'].dataType.simpleString()}, q boolean, codes binary")


def search(index: DataFrame, queries: DataFrame, h: Hashes, dim: int, probes: int | None, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score) with k rows at most of every task and query, unmerged. No probes: all buckets."""
    spark = index.sparkSession
    blocks = max(1, -(-queries.count() // QUERIES))
    dealt = queries.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"))

    def ask(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                unit = unit_rows(matrix(part.column(1), dim))
                found = np.stack([h.probes(unit, t, probes) for t in range(h.tables)], axis=1).astype("<u4")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "v", "block", "probed"])

    if probes is None:
        dealt = dealt.withColumn("probed", F.lit(b""))
    else:
        dealt = dealt.mapInArrow(ask, f"id long, v {queries.schema['v'].dataType.simpleString()}, block long, probed binary")
    dealt = scratch.table(dealt, "queries")
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for b in range(blocks):
        block = dealt.where(F.col("block") == b).toArrow()
        if not block.num_rows:
            continue
        ids, unit = block.column("id").to_numpy(), unit_rows(matrix(block.column("v"), dim))
        probed = None if probes is None else np.stack([np.frombuffer(x.as_py(), "<u4") for x in block.column("probed")]).reshape(len(ids), h.tables, -1)
        shared = spark.sparkContext.broadcast((ids, unit, probed, h.buckets))  # about QUERIES rows

        def run(batches, shared=shared):
            ids, unit, probed, buckets = shared.value
            near = Nearest(ids, unit, None if probed is None else bit_table(probed, buckets), k)
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = batch.slice(low, ROWS)
                    codes = np.stack([np.frombuffer(c.as_py(), "<u4") for c in part.column(2)])
                    near.add(part.column(0).to_numpy(), unit_rows(matrix(part.column(1), dim)), codes)
            yield near.rows()

        found = found.unionByName(index.select("id", "v", "codes").mapInArrow(run, "query_id long, vec_id long, score double"))
    return found


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: query_id, rank, vec_id, score."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row that is_query tells."""
    scratch = scratch or Scratch(vectors.sparkSession, "ann")
    v = F.col(vec_col)
    valid = vectors.where(F.col(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0))
    valid = scratch.table(valid.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    n, dim = valid.count(), width(valid, "v")
    h = Hashes(max(dim, 1), tables)
    if probes is None:
        sample = valid.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(SAMPLE).toArrow()
        probes = fit_probes(h, matrix(sample.column("v"), dim) if n else np.zeros((0, 1)), k)
        probes = min(h.buckets, max(probes, -(-64 * h.buckets // (max(1, n) * tables))))
    index = scratch.table(indexed(valid, h, dim), "index")
    queries = index.where("q").dropDuplicates(["id", "v"])
    found = scratch.table(merged(search(index, queries, h, dim, probes, k, scratch), k), "found")
    full = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k)
    short = scratch.table(queries.join(full, queries["id"] == full["query_id"], "left_anti"), "short")
    if not short.limit(1).count():
        return found
    rest = merged(search(index, short, h, dim, None, k, scratch), k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


def op1_cross_polytope(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest found for every vector whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, F.col("vec_id") % 50 == 0)
