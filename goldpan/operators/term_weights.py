"""TF-IDF weights of one block, summed for each row: how many terms, the sum of values of length 1.

Terms are 64-bit keys that numpy makes from whole texts: code points of character n-grams packed (hashed
where one is above U+0FFF), hashes of words and of pairs. A row's terms are counted where it is read. First
pass: every task's document counts, summed by term. Second pass: the commonest terms' weights are
looked up in a broadcast; of the other terms, (row, term, count) joins the written table of counts.
Only the broadcast is bounded, every term counts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.functions.text import lowered
from goldpan.operators.tfidf import CHARS, LEAST, by_id
from goldpan.scratch import Scratch

#: Terms in the broadcast, distinct terms that a task holds in the first pass, hashed words a worker keeps.
HELD, BUFFER, CACHE = 1 << 22, 1 << 22, 1 << 20

_WORD = re.compile(r"\w{2,}")
_SEPARATOR = re.compile("[\x1c-\x1f]")  # Python's white space, but not SQL's
_SPACE = re.compile("[\t-\r \x85\xa0%s]+" % "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(h: np.ndarray) -> np.ndarray:
    for odd in _ODD[:2]:
        h = (h ^ (h >> np.uint64(31))) * odd
    return h ^ (h >> np.uint64(29))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()


def word_keys(texts: list[str]) -> np.ndarray:
    found = []
    for text in texts:
        w = np.fromiter(map(_hashes.__getitem__, _WORD.findall(text)), np.uint64)
        found += [w, _mixed(w[:-1] * _ODD[2] + w[1:])]  # w itself stays as it is
    return np.concatenate(found).view(np.int64)


def char_keys(texts: list[str]) -> np.ndarray:
    """Runs of 3 to 5 without a space inside: of each word with a space at both ends."""
    words = [w for t in texts for w in (_SPACE.split(t) if _SEPARATOR.search(t) else t.split()) if w]
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    wide, inside, found = bool((c >= 4096).any()), c[1:-1] != 32, []
    whole = inside
    for k in range(CHARS[0], CHARS[1] + 1):
        n = len(c) - k + 1
        if n < 1:
            break
        if k > CHARS[0]:
            whole = whole[:n] & inside[k - 3 : k - 3 + n]
        at = np.flatnonzero(whole)
        key = np.full(len(at), (k - CHARS[0]) << 60, np.uint64)
        for i in range(k):
            key |= (c[at + i] & np.uint64(4095)) << np.uint64(12 * i)
        if wide:
            far = np.flatnonzero(np.any([c[at + i] >= 4096 for i in range(k)], axis=0))
            h = np.full(len(far), k, np.uint64)
            for i in range(k):
                h = _mixed(h * _ODD[2] + c[at[far] + i])
            key[far] = h | np.uint64(1 << 63)
        found.append(key)
    return np.concatenate(found).view(np.int64)


def _keys(block: str):
    return word_keys if block == "word" else char_keys


def _counts(block: str, buffer: int):
    keys = _keys(block)

    def run(batches):
        terms, sizes, rows = [], [], 0

        def merged():
            every, at = np.unique(np.concatenate(terms), return_inverse=True)
            return every, np.bincount(at, weights=np.concatenate(sizes)).astype(np.int64)

        for batch in batches:
            for texts in batch.column(1).to_pylist():
                t = np.unique(keys(texts))
                terms.append(t)
                sizes.append(np.ones(len(t)))
                rows += len(t)
                if rows >= buffer:
                    every, n = merged()
                    if len(every) > buffer // 2:
                        yield pa.record_batch({"term": every, "df": n})
                        terms, sizes, rows = [], [], 0
                    else:
                        terms, sizes, rows = [every], [n], len(every)
        if rows:
            every, n = merged()
            yield pa.record_batch({"term": every, "df": n})

    return run


def _sums(block: str, held, all_held: bool):
    keys = _keys(block)
    sums_type = pa.struct([("terms", pa.int64()), ("total", pa.float64()), ("square", pa.float64())])

    def run(batches):
        known, idf = held.value
        for batch in batches:
            of, spot, other_of, other, other_tf, sums = [], [], [], [], [], []
            for row, texts in enumerate(batch.column(1).to_pylist()):
                term, tf = np.unique(keys(texts), return_counts=True)
                at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
                hit = known[at] == term if len(known) else np.zeros(len(term), bool)
                if hit.any():
                    n = tf[hit]
                    v = (1 + np.log(n) if block == "word" else n) * idf[at[hit]]
                    of.append(row)
                    spot.append(term[hit][0])
                    sums.append({"terms": len(v), "total": float(v.sum()), "square": float(v @ v)})
                if not all_held and not hit.all():
                    other.append(term[~hit])
                    other_tf.append(tf[~hit])
                    other_of.append(np.full(len(other[-1]), row))
            ids = batch.column(0)
            if of:
                yield pa.record_batch([ids.take(pa.array(of)), pa.array(spot, pa.int64()), pa.nulls(len(of), pa.int32()), pa.array(sums, sums_type)], names=["id", "term", "tf", "sums"])
            if other:
                term = np.concatenate(other)
                yield pa.record_batch([ids.take(pa.array(np.concatenate(other_of))), pa.array(term), pa.array(np.concatenate(other_tf).astype(np.int32)), pa.nulls(len(term), sums_type)], names=["id", "term", "tf", "sums"])

    return run


def block_totals(docs: DataFrame, block: str, id_col: str = "example_id", text_col: str = "text") -> DataFrame:
    """(id, terms, total) of the rows that have a term of the vocabulary."""
    spark, n = docs.sparkSession, docs.count()
    scratch = Scratch(spark, "term-weights")
    rows = by_id(docs, id_col, text_col).select("id", F.transform("texts", lowered).alias("texts"))
    counts = rows.mapInArrow(_counts(block, BUFFER), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    known = scratch.table(counts.where(F.col("df") >= LEAST[block]), "frequencies")
    bar, total = None, 0
    for df, terms in sorted(map(tuple, known.groupBy("df").count().collect()), reverse=True):
        if total + terms > HELD:
            break
        bar, total = df, total + terms
    common = known.where(F.col("df") >= bar) if bar is not None else known.limit(0)
    table = common.toArrow()
    term, df = (table[c].to_numpy() for c in ("term", "df"))
    order = np.argsort(term)
    all_held = total == known.count()
    held = spark.sparkContext.broadcast((term[order], np.log((1.0 + n) / (1 + df[order])) + 1))
    made = rows.mapInArrow(_sums(block, held, all_held), f"id {rows.schema['id'].dataType.simpleString()}, term long, tf int, sums struct<terms:long,total:double,square:double>")
    if not all_held:
        tf = 1 + F.log("tf") if block == "word" else F.col("tf").cast("double")
        value = tf * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)
        rare = known if bar is None else known.where(F.col("df") < bar)
        made = made.join(rare, "term", "left").where("tf is null or df is not null").withColumn("value", value)
        one = F.struct(F.lit(1).cast("long").alias("terms"), F.col("value").alias("total"), (F.col("value") * F.col("value")).alias("square"))
        made = made.select("id", F.when(F.col("tf").isNull(), F.col("sums")).otherwise(one).alias("sums"))
        made = made.groupBy("id").agg(F.struct(*(F.sum(f"sums.{c}").alias(c) for c in ("terms", "total", "square"))).alias("sums"))
    return made.select("id", "sums.terms", (F.col("sums.total") / F.sqrt("sums.square")).alias("total"))
