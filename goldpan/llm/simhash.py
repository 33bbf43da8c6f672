r"""SimHash near-duplicates, compared in bit slices.

Fingerprint: A-Z are lower-cased, words are ``[^\x20\x09-\x0D]+``, shingles are runs of three words
joined by spaces, repeats included (fewer words: all of them; none: fingerprint zero). Each shingle
gives XXH64 of its UTF-8 bytes, seed 42; a bit is set if it is set in over half of the hashes.

Links: fingerprints that differ in at most ``radius`` (3) of 64 bits. Equal fingerprints are one
node from the start, so copies cost nothing further. By the pigeonhole principle two fingerprints
within the radius agree on some ``agree`` of ``radius + agree`` blocks of bits, so every choice of
that many blocks is a table and its value a bucket: no link is lost, and ``agree`` follows from the
number of fingerprints so that buckets stay small. In a bucket the comparison is bit-sliced: the
bucket's fingerprints are 64 bit planes, one bit for each; a word of a plane is XORed with a
query's bit, and three carry-save counters (and an overflow plane) add up 64 distances at once.
After every eight planes the words in which all 64 distances exceed the radius are abandoned.
A bucket with more than ``CHUNK`` members is dealt in pairs of chunks. Each group returns a
spanning forest of its links, never all pairs, and star contraction joins the forests.

Edges: a null text counts as an empty one. Rows that repeat get the same component. A null id takes
part; it is no component's smallest id unless all its members are null. An empty table gives no
rows. Other columns are kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm import marks
from goldpan.operators.components import connected_components
from goldpan.scratch import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Members of a bucket that are compared in one group, twice at most.
CHUNK = 8192
#: Shingles whose hashes are held at once.
HELD = 1 << 16
PLANES = 8


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a whole text."""
    text = text or ""
    words = WORDS.findall(text.lower() if text.isascii() else text.translate(UPPER))
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        shingles = iter([" ".join(words)])
        n = 1
    else:
        n = len(words) - size + 1
        shingles = map(" ".join, zip(*(words[k:] for k in range(size))))
    ones = np.zeros(64, np.int64)
    while part := [h(x, 42) for x in itertools.islice(shingles, HELD)]:
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f, the fingerprint as a signed long, and h, the text's hash."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            f = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64)), batch.column(2)], names=["doc_id", "f", "h"])

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("h")).mapInArrow(run, f"doc_id {kind}, f long, h long")


def bit_planes(f: np.ndarray) -> np.ndarray:
    """64 rows of words: bit j of word w in row b is bit b of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(f) // 64) * 64, np.uint64)
    padded[: len(f)] = f
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(f: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit-sliced distances of fingerprint f[query] to the 64 of ``word``, for many such entries.

    alive: which of the 64 to look at. Returns the entries (query, word) with any of them within
    the radius, and which. The counters hold 0 to 7; 8 and more go to the overflow plane.
    """
    one, two, four = (np.zeros(len(query), np.uint64) for _ in range(3))
    mine = f[query]
    for b in range(64):
        differs = planes[b][word] ^ -((mine >> np.uint64(b)) & np.uint64(1))
        carry = one & differs
        one ^= differs
        carry2 = two & carry
        two ^= carry
        alive = alive & ~(four & carry2)
        four ^= carry2
        if b % PLANES == PLANES - 1:
            over = four.copy() if radius == 3 else over_radius(one, two, four, radius)
            alive = alive & ~over
            keep = alive != 0
            if not keep.all():
                query, word, mine, one, two, four, alive = (x[keep] for x in (query, word, mine, one, two, four, alive))
            if not len(query):
                break
    return query, word, alive


def over_radius(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Which counters hold more than radius, 0 to 7."""
    over = np.zeros_like(one)
    for value in range(radius + 1, 8):
        over |= np.bitwise_and.reduce([x if value >> k & 1 else ~x for k, x in enumerate((one, two, four))])
    return over


def forest(f: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int, entries: int = 1 << 15) -> np.ndarray:
    """Every fingerprint's root in its group: the component under links inside begin[i]..end[i]."""
    n = len(f)
    root = np.arange(n)
    planes = bit_planes(f)
    first, last = np.arange(n) // 64, (end - 1) // 64  # only later members are looked at
    words = last - first + 1
    ends = np.cumsum(words)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + entries, side="right")))
        rows = np.arange(at, upto)
        query = np.repeat(rows, words[at:upto])
        word = np.arange(len(query)) - np.repeat(ends[at:upto] - words[at:upto] - (ends[at - 1] if at else 0), words[at:upto]) + first[query]
        low = np.maximum(query + 1 - word * 64, 0)
        high = np.minimum(end[query] - word * 64, 64)
        ones = ~np.uint64(0)
        alive = np.where(low < 64, ones << np.minimum(low, 63).astype(np.uint64), np.uint64(0))
        alive &= np.where(high > 0, ones >> (64 - np.maximum(high, 1)).astype(np.uint64), np.uint64(0))
        some = alive != 0
        query, word, alive = within(f, planes, query[some], word[some], alive[some], radius)
        if len(query):
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            entry, bit = np.nonzero(bits)
            root = joined(root, query[entry], word[entry] * 64 + bit)
        at = upto
    return root


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links a-b: each round hooks the larger root under the smaller."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def block_masks(radius: int, agree: int) -> list[int]:
    """The bit masks of all choices of ``agree`` among ``radius + agree`` blocks."""
    n = radius + agree
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in itertools.combinations(blocks, agree)]


def links(nodes: DataFrame, radius: int = 3, agree: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """nodes: node (long) and f, distinct. Edges (a, b) with the same components as all links."""
    if agree is None:
        n, agree = nodes.count(), 1
        while agree < 6 and n >> (64 * agree // (radius + agree)) > 64:
            agree += 1
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, agree)]
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    spread = nodes.select("node", "f", F.inline(tables))
    # Buckets over the chunk size, few by their size, are dealt in pairs of chunks.
    large = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    spread = spread.join(large, ["t", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("f"), F.coalesce("c", F.lit(1))).cast("int"))
    pairs = F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.least(o, F.col("mine")) * F.col("c") + F.greatest(o, F.col("mine"))))
    spread = spread.select("t", "key", F.explode(pairs).alias("pair"), "f", "node")
    spread = spread.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair")

    def run(batches):
        held = []

        def links_in(t, rows):
            cols = [np.concatenate([x[i] for x in rows]) for i in range(5)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            cut = len(cols[0]) if t else int(change[-1]) if len(change) else 0
            rest = [c[cut:] for c in cols]
            begin = np.concatenate([[0], change[change < cut]]).astype(np.int64)
            if not cut:
                return None, rest
            sizes = np.diff([*begin, cut])
            many = np.repeat(sizes, sizes) > 1
            f, node = cols[3][:cut][many].view(np.uint64), cols[4][:cut][many]
            sizes = sizes[sizes > 1]
            ends = np.cumsum(sizes)
            if not len(f):
                return None, rest
            root = forest(f, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), radius)
            linked = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"]), rest

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            if sum(len(x[0]) for x in held) >= 2 * chunk:
                out, rest = links_in(False, held)
                held = [rest]
                if out is not None:
                    yield out
        if held:
            out, _ = links_in(True, held)
            if out is not None:
                yield out

    return spread.mapInArrow(run, "a long, b long")


def components(prints: DataFrame, radius: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id long, f) -> (f, component_id), a row for each fingerprint."""
    scratch = scratch or Scratch(prints.sparkSession, "simhash")
    nodes = scratch.table(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "nodes")
    # The fingerprint itself is the node; ids are brought in for those that have a link.
    edges = links(nodes.select(F.col("f").alias("node"), "f"), radius)
    groups = connected_components(edges, scratch)
    groups = scratch.table(groups, "groups")
    linked = nodes.join(groups, nodes["f"] == groups["node"]).select("f", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("f", "component_id")
    alone = nodes.join(groups, nodes["f"] == groups["node"], "left_anti").select("f", F.col("least").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id, h (its text's hash)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, size, id_col, text_col), "prints")
    found = components(prints, radius, scratch).withColumnRenamed("f", "_f")
    # A fingerprint that a third of all rows share makes this join skewed; AQE splits such a partition.
    out = prints.join(found, prints["f"] == found["_f"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id", "h")


def keep_one(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less those that are in another's component: the smallest doc_id of each stays.

    Rows that share this doc_id all stay, and so do rows without an id in a component without any.
    Only texts that may have to go, by a table of bits, cross a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = near_duplicates(docs, radius, size, id_col, text_col)
    drop = found.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("_goldpan_id"), F.col("h").alias("_goldpan_h")).distinct()
    drop = scratch.table(drop.withColumn("_goldpan_at", F.xxhash64("_goldpan_id", "_goldpan_h")), "drop")
    suspect = marks.membership(drop, "_goldpan_at", scratch)(F.xxhash64(docs[id_col], F.xxhash64(docs[text_col])))
    same = docs[id_col].eqNullSafe(F.col("_goldpan_id")) & (F.xxhash64(docs[text_col]) == F.col("_goldpan_h"))
    return docs.where(~suspect).union(docs.where(suspect).join(drop, same, "left_anti"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint, component_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
