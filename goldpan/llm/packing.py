"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities.

Documents become token ids and an end id; a longer document than a sequence is cut so that its
first piece holds the remainder and all others are full. Best-fit decreasing needs no more than
how many pieces there are of each length, at most ``capacity`` numbers: the driver packs these
counts, taking all items of a length that meet the same tightest capacity at once, and the
result says for every (length, rank in that length) the sequence and the offset. It is the very
packing that placing pieces one at a time gives. A full piece is a sequence of its own and needs no rank. The rank of
any other in its length is dealt out by salted windows of about ``PART`` pieces, so a length that a
third of all pieces share is no single task's work.

Edges: a null or empty text is one piece, the end id alone. A null id stays null. Rows that
repeat are packed as often as they occur. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldpan.scratch import Scratch

#: Pieces of one length that one task ranks, about.
PART = 50_000


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """text -> list of ids, as the tokenizers library gives them for the file at path.

    Where the same vocabulary lies beside it as ranks, tiktoken encodes texts of the Latin
    scripts, five times as fast and with the same ids; any other text, any that holds the string of a
    special token, and any that tiktoken refuses, goes to the tokenizers library.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def by_file(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.basename(path) != "byte_bpe_50k.json" or not os.path.exists(ranks):
        return by_file
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def both(text: str) -> list[int]:
        if (text.isascii() or max(text) < "ɐ") and not any(t in text for t in special):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001  a Rust panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return by_file(text)

    return both


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first holds the remainder."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece; with ``keep_ids`` also its ids."""
    schema = PIECES.format(id=docs.schema[id_col].dataType.simpleString()) + (", ids array<int>" if keep_ids else "")
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[docs.schema[id_col].dataType.simpleString()]

    def run(batches):
        encode = tokenizer(path)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for k, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[start : start + n]
                    row = (doc_id, k, start, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
            types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if keep_ids else 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names[: len(types)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class OpenBins:
    """How many open bins have each remaining capacity: a segment tree of sums."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.width)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.width
        while i:
            self.sums[i] += n
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least size that an open bin has."""
        i = size + self.width
        if self.sums[i]:
            return size
        while i > 1:
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = 1024) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces of every length.

    Runs (length, rank, n, each, bin, offset): the n pieces of that length from rank on go to the
    bins from ``bin`` on, ``each`` of them to every bin, the first at ``offset``.
    """
    tree, ranges, runs, bins = OpenBins(capacity), {}, [], 0

    def opened(first: int, n: int, remaining: int) -> None:
        if n and remaining:
            ranges.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = ranges[room].pop()
                tree.add(room, -n)
            each = room // size  # a bin that took one is the tightest for the next, as long as it fits
            full = min(n, left // each)
            if full:
                runs.append((size, rank, full * each, each, first, capacity - room))
                opened(first, full, room - each * size)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if rest and left:
                runs.append((size, rank, left, left, first + full, capacity - room))
                opened(first + full, 1, room - left * size)
                rest, left = rest - 1, 0
                opened(first + full + 1, rest, room)
            elif rest:
                opened(first + full, rest, room)
    return runs


def pack(pieces: DataFrame, capacity: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """Pieces with their sequence_id and offset. ``pieces`` has a ``length`` of 1 to capacity."""
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.table(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    lengths = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity - 1
    salts = max(1, -(-max(lengths.values(), default=1) // PART))
    salted = short.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    # At most capacity x salts rows, which aren't collected.
    ahead = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    ahead = ahead.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_ahead"))
    ranked = salted.join(scratch.table(ahead, "ahead"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1)
    runs = np.array(best_fit(lengths, capacity), dtype=np.int64).reshape(-1, 6)
    starts = {int(s): np.flatnonzero(runs[:, 0] == s) for s in lengths}
    bins = int((runs[:, 4] + -(-runs[:, 2] // runs[:, 3])).max(initial=0))
    names = [c for c in pieces.columns if c != "_row"]
    ranked = ranked.select(*names, "_rank")
    shared = spark.sparkContext.broadcast((runs, starts))  # its size depends on capacity alone
    schema = ranked.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        runs, starts = shared.value
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine, own = size == s, starts[int(s)]
                at[mine] = own[np.searchsorted(runs[own, 1], rank[mine], side="right") - 1]
            _, first, _, each, bin0, offset = runs[at].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(bin0 + k // each), pa.array(offset + k % each * size)], names=[*names, "sequence_id", "offset"])

    full = pieces.where(F.col("length") == capacity)
    full = full.select(*names, (F.lit(bins).cast("long") + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, schema).unionByName(full)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenized(docs, path or default_tokenizer(), end_id, capacity), capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
