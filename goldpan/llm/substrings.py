r"""Substring dedup by hashing lines, cut further at the ends of sentences.

Passages that documents share often lie inside a line, so a unit is a line or a sentence in it: it
ends at a line feed, or with ``.``, ``!`` or ``?`` before white space. A unit's words
``[^\x20\x09-\x0D]+``, lower-cased and joined by single spaces, are hashed to 128 bits. Over all
documents the earliest occurrence of a digest, by (doc_id, start), is its keeper, the others are
repeats. Repeats that follow one another in a document form a passage, units without a word between
them aside; the units of passages of ``min_words`` or more words are removed, each with its original
offset, and shorter repeats, such as a common short line, stay. min_words is 30: a passage of over 50
words that was put into the middle of a sentence is found if its whole sentences have as many, and
not otherwise. ``passages`` finds every one, word for word.

Plan: units are cut where the documents are read. Digests that occur twice or more are found by an
aggregate with map-side sums, so the most common unit costs each task one row, and written. The join
of units to keepers is skewed if one unit is a large share of all; AQE splits such partitions. Only
repeats go on to the passages, which are windows within one document.

Edges: a null or empty text has no units. A null id comes first. Rows with the same doc_id are
ordered by the text's hash; rows with the same doc_id and text are one document. An empty table
gives no rows. ``remove`` keeps all columns whatever their names, and white space around what goes.
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
#: Every character of a text is in one match: a line feed, or a unit.
PIECES = re.compile(r"(?:[^\n.!?]+|[.!?]+[^\x20\x09-\x0D.!?])+[.!?]*|[.!?]+|\n")
UNITS = "o {id}, h long, unit int, start long, length long, words int, d1 long, d2 long"


def units_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, length, words, normalised text) of the units that have words. Their blanks at the ends don't count."""
    out = []
    for m in PIECES.finditer(text):
        piece = m.group()
        words = WORDS.findall(piece.lower())
        if words:
            lead = len(piece) - len(piece.lstrip(" \t\x0b\x0c\r"))
            out.append((m.start() + lead, len(piece.strip(" \t\x0b\x0c\r")), len(words), " ".join(words)))
    return out


def find_repeats(docs: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The units to remove: o (doc_id), h, unit, start, length, words, keeper_id, keeper_start."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    kind = docs.schema[id_col].dataType.simpleString()
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # the units of few documents at a time
                part = batch.slice(low, 256)
                rows, owner = [], []
                for i, (h, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2))):
                    for k, (start, length, words, norm) in enumerate(units_of(text.as_py() or "")):
                        d = xxhash.xxh3_128_intdigest(norm)
                        rows.append((h, k, start, length, words, d >> 64, d & ((1 << 64) - 1)))
                        owner.append(i)
                columns = list(zip(*rows)) if rows else [[]] * 7
                digests = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in columns[5:]]
                ids = part.column(0).take(pa.array(owner, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[:5], types)), *digests], names=["o", "h", "unit", "start", "length", "words", "d1", "d2"])

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.xxhash64(text_col).alias("h"), F.col(text_col))
    units = scratch.table(given.mapInArrow(run, UNITS.format(id=kind)), "units")
    keepers = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("o", "h", "start")).alias("keeper")).where("n > 1").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "keeper")
    keepers = scratch.table(keepers, "keepers")
    scratch.sweep()
    marked = units.join(keepers, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).where(F.struct("o", "h", "start") != F.col("keeper"))
    marked = marked.drop("d1", "d2", "k1", "k2").dropDuplicates(["o", "h", "unit"])
    # Neighbours in a passage have the same difference of their number and their rank among repeats.
    marked = marked.withColumn("_run", F.col("unit") - F.row_number().over(Window.partitionBy("o", "h").orderBy("unit")))
    marked = marked.withColumn("_words", F.sum("words").over(Window.partitionBy("o", "h", "_run")))
    return marked.where(F.col("_words") >= min_words).select("o", "h", "unit", "start", "length", "words", F.col("keeper.o").alias("keeper_id"), F.col("keeper.start").alias("keeper_start"))


def remove(docs: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those units, all columns as they were."""
    gone = find_repeats(docs, min_words, id_col, text_col)
    gone = gone.groupBy("o", "h").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_goldpan_gone")).withColumnsRenamed({"o": "_goldpan_o", "h": "_goldpan_h"})
    match = docs[id_col].eqNullSafe(F.col("_goldpan_o")) & (F.xxhash64(docs[text_col]) == F.col("_goldpan_h"))
    # What stays lies between the end of one unit and the start of the next.
    text, spans = docs[text_col], F.col("_goldpan_gone")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))

    def cut(acc, span):
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        return F.struct((span["start"] + span["length"]).alias("at"), F.concat(acc["kept"], piece).alias("kept"))

    rest = F.aggregate(spans, begin, cut, lambda acc: F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(spans.isNull(), text).otherwise(rest).alias(text_col)
    return docs.join(gone, match, "left").select(*[new if c == text_col else docs[c] for c in docs.columns])


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """Each unit of all documents that goes: doc_id, unit, start, length, words, keeper_id, keeper_start."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_repeats(docs).drop("h").withColumnRenamed("o", "doc_id")
