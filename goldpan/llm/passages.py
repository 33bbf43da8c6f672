r"""Repeated passages, word for word: every run of ``least`` words that occurs earlier.

Words are ``[^\x20\x09-\x0D]+`` over a whole text, lower-cased; lines and sentences don't matter. A window
is ``least`` words in a row. It is a repeat if an equal window begins earlier, by (doc_id, start), in
another document or the same. What repeats cover, joined where they touch, is a passage, so a shared
run of ``least`` words or more is found wherever it lies and to its last word.

Plan: a window's anchor is the least hash of its runs of ``GRAM`` words. Equal windows have equal
anchors, and windows in a row with one anchor are a segment, about 18 of them. Segments are
hashed to 128 bits and one row each: all but the earliest of a digest are repeats as wholes, so copies
cost a row a segment. Only where an anchor has several digests, as at the ends of a shared run, or
comes twice in one segment, are the windows compared one by one, and of each digest only the earliest
segment's. No pairs are made; the hottest key meets aggregates with map-side sums and joins that AQE
splits. Texts are read twice; those with windows to compare cross one shuffle.

Edges: a null id comes first. Rows with the same doc_id are ordered by the text's hash; rows with the
same doc_id and text are one document. Null, empty and short texts and empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldpan.scratch import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
GRAM, CACHED = 16, 500_000
ODD = [(0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    x = a * np.uint64(ODD[which][0]) + b * np.uint64(ODD[which][1])
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def run_hashes(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """Of every ``size`` words in a row, from halves of doubled length."""
    n, level, out, at, bit = len(words) - size + 1, words, None, 0, 1
    while bit <= size:
        if size & bit:
            part = level[at : at + n]
            out = part if out is None else mixed(out, part, which)
            at += bit
        if 2 * bit <= size:
            level = mixed(level[: max(0, len(level) - bit)], level[bit:], which)
        bit *= 2
    return out


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x, step = np.minimum(x[: len(x) - step], x[step:]), 2 * step
    return np.minimum(x[:n], x[width - step : width - step + n])


class Reader:
    """Texts to word hashes and places; hashes of words seen before are kept, up to CACHED."""

    def __init__(self, least: int):
        self.least, self.known = least, {}

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word."""
        if len(self.known) > CACHED:
            self.known.clear()
        found = WORDS.findall(text)
        for w in set(found).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w.lower())
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        inside = np.r_[False, (code != 32) & ((code < 9) | (code > 13)), False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)), edges[::2], edges[1::2]

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return run_hashes(words, self.least, 0), run_hashes(words, self.least, 1)

    def segments(self, words: np.ndarray):
        """(first window, windows, anchor, d1, d2, whether the anchor comes twice) of a text of least words or more."""
        width = self.least - GRAM + 1
        grams = run_hashes(words, GRAM, 0)
        anchor = least_of(grams, width)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(anchor)])
        place = (np.arange(len(anchor)) - np.repeat(first, size)).astype(np.uint64)
        digests = [np.add.reduceat(mixed(w, place, k), first) for k, w in enumerate(self.windows(words))]
        value, span, last = anchor[first], np.arange(width), first + size - 1
        left = first + (grams[first[:, None] + span] == value[:, None]).argmax(axis=1)
        right = last + width - 1 - (grams[last[:, None] + span[::-1]] == value[:, None]).argmax(axis=1)
        return first, size, value, *digests, left != right


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def find_passages(docs: DataFrame, least: int = 51, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """o (doc_id), h, start, length, words of every passage that occurs earlier."""
    if least <= GRAM:
        raise ValueError(f"least must be over {GRAM}")
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("o"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def told(part, rows: list[list], names: list[str]) -> pa.RecordBatch:
        """A batch of o, h and each text's columns."""
        owner = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
        columns = [np.concatenate(c) for c in zip(*rows)]
        arrays = [signed(c) if c.dtype == np.uint64 else pa.array(c) for c in columns]
        return pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), *arrays], names=["o", "h", *names])

    def cut(batches):
        reader = Reader(least)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows, used = [], []
                for i, text in enumerate(part.column(2)):
                    words, start, end = reader.words(text.as_py())
                    if len(words) >= least:
                        first, size, anchor, d1, d2, twice = reader.segments(words)
                        rows.append([first, size, start[first], end[first + size + least - 2], anchor, d1, d2, twice])
                        used.append(i)
                if rows:
                    yield told(part.take(pa.array(used)), rows, ["i", "n", "start", "end", "m", "d1", "d2", "twice"])

    at = "i long, n long, start long, end long"
    segments = scratch.table(given.mapInArrow(cut, f"o {kind}, h long, {at}, m long, d1 long, d2 long, twice boolean"), "segments")
    begin = F.struct("o", "h", "i")
    firsts = segments.groupBy("m", "d1", "d2").agg(F.min(F.struct("o", "h", "i", "n")).alias("keeper"), F.count("*").alias("times"), F.max("twice").alias("twice"))
    firsts = scratch.table(firsts, "firsts")
    scratch.sweep()
    keepers = firsts.where("times > 1").select("d1", "d2", "m", "keeper")
    whole = segments.join(keepers, ["d1", "d2", "m"]).where(begin != F.struct("keeper.o", "keeper.h", "keeper.i")).select("o", "h", "i", "n", "start", "end")
    whole = scratch.table(whole, "whole")
    crowded = firsts.groupBy("m").agg(F.count("*").alias("digests")).where("digests > 1").select("m")
    asked = firsts.where("NOT twice").join(crowded, "m").select("keeper.*").unionByName(firsts.where("twice").select("keeper.*"))
    asked = asked.groupBy("o", "h").agg(F.collect_list("i").alias("i"), F.collect_list("n").alias("n")).withColumnsRenamed({"o": "_o", "h": "_h"})
    asked = scratch.table(asked, "asked")
    scratch.drop(segments, firsts)
    scratch.sweep()
    texts = given.join(asked, F.col("o").eqNullSafe(F.col("_o")) & (F.col("h") == F.col("_h"))).select("o", "h", "text", "i", "n")

    def compare(batches):
        reader = Reader(least)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows = []
                for text, first, size in zip(part.column(2), part.column(3), part.column(4)):
                    words, start, end = reader.words(text.as_py())
                    i = np.concatenate([np.arange(a, a + n) for a, n in zip(first.as_py(), size.as_py())])
                    d1, d2 = reader.windows(words)
                    rows.append([i, start[i], end[i + least - 1], d1[i], d2[i]])
                if rows:
                    yield told(part, rows, ["i", "start", "end", "d1", "d2"])

    windows = scratch.table(texts.mapInArrow(compare, f"o {kind}, h long, i long, start long, end long, d1 long, d2 long"), "windows")
    scratch.drop(asked)
    scratch.sweep()
    keepers = windows.groupBy("d1", "d2").agg(F.min(begin).alias("keeper"), F.count("*").alias("times")).where("times > 1").select("d1", "d2", "keeper")
    keepers = scratch.table(keepers, "keepers")  # so that AQE can split the join at a hot window
    single = windows.join(keepers, ["d1", "d2"]).where(begin != F.col("keeper")).select("o", "h", "i", F.lit(1).cast("long").alias("n"), "start", "end")
    # Repeats that overlap or touch are one passage.
    found = whole.unionByName(single).withColumn("last", F.col("i") + F.col("n") + (least - 1))
    order = Window.partitionBy("o", "h").orderBy("i", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce((F.col("i") > before).cast("long"), F.lit(1)))
    found = found.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("o", "h", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("i")).alias("words"))
    return found.select("o", "h", "start", (F.col("end") - F.col("start")).alias("length"), "words")


def op6_passages(spark, sf_dir: str) -> DataFrame:
    """Each passage of over 50 words that occurs earlier: doc_id, start, length, words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_passages(docs).drop("h").withColumnRenamed("o", "doc_id")
