"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source gets a target: its share, by weight, of all words, stopped at ``max_repeats``
times the source's own words; what a stopped source leaves is shared among the others by
weight again (water filling). Its documents are shuffled by a hash of their id, and each copy
of a document gets a virtual finish time: the words that its source has sent by the end of
that copy, divided by the source's target. All copies are sorted by finish time and the list
is cut where it holds as many words as the corpus.

Plan: the text is read once, for its word count. The shuffled order within a source is cut into
``BUCKETS`` hash ranges, so running sums are a window in (source, range) plus a sum over the
ranges before: no source, however large, is sorted by one task. The global sort works in the
same way: ``BINS`` ranges of finish time with summed sizes give the range where the budget
ends, and only that range is sorted.

Edges: a null or empty text has size 0 and takes 0 words. A null source is a source of its own
and comes last. Rows that repeat are separate documents. An empty table gives no rows. A null
id is shuffled as the empty string. Columns other than id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from goldpan.llm import WORD
from goldpan.scratch import Scratch

#: Hash ranges of one source's shuffled order; each is sorted by one task.
BUCKETS = 1024
#: Ranges of a unit of finish time; four units are told apart, later copies share the last range.
BINS = 8192


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def constant(value: object, kind: DataType) -> Column:
    if isinstance(value, Row):
        return F.struct(*[constant(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> the same rows with their target. One row for each source."""
    every = Window.partitionBy()
    ranked = per_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumns({"_w": weight, "_cap": F.col("source_size") * max_repeats})
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # The level rises while sources stop at their caps and falls after the last of them.
    ranked = ranked.withColumn("_level", level).withColumn("_water", F.max("_level").over(every))
    return ranked.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_water")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, row: Column | None = None, by_size: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken, row_id, _key.

    ``size`` replaces the word count. ``weights`` go to the sources in code-point order, null last,
    and repeat. ``row_id`` numbers the rows of the table that was read, or is the column ``row``. Rows with the same id are in the
    order of their sizes, unless ``by_size`` is false, and then of ``row_id``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")) if size is None else size
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), shuffle_key(F.col(id_col)).alias("_key"), *([] if row is None else [row.alias("_row")]))
    slim = slim.withColumns({"_bucket": F.shiftright("_key", 60 - (BUCKETS - 1).bit_length()).cast("int"), "row_id": F.monotonically_increasing_id()} | ({} if row is None else {"row_id": F.col("_row")})).drop("_row")
    slim = scratch.table(slim, "sizes")

    ranges = slim.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ranges = scratch.table(ranges, "ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_repeats)
    total = ranges.agg(F.coalesce(F.sum("_sum"), F.lit(0))).first()[0]
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    ranges = ranges.withColumnRenamed("source", "_source").join(goal, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    ranges = ranges.withColumnRenamed("_bucket", "_b")

    timed = slim.join(ranges, slim["source"].eqNullSafe(ranges["_source"]) & (slim["_bucket"] == ranges["_b"])).drop("_source", "_b")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", *(["size"] if by_size else []), "row_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = timed.withColumn("_sent", F.col("_ahead") + F.sum("size").over(inside)).drop("_ahead", "_bucket")
    timed = scratch.table(timed, "timed")

    def finish(copy: Column) -> Column:
        return (copy * F.col("source_size") + F.col("_sent")) / F.col("target")

    def bin_of(time: Column) -> Column:
        return F.floor(F.least(time, F.lit(4.0)) * BINS).cast("int")

    copies = timed.where("size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("_time", finish(F.col("_copy")))
    bins = copies.groupBy(bin_of(F.col("_time")).alias("_bin")).agg(F.sum("size").alias("_sum"))
    running = F.sum("_sum").over(Window.orderBy("_bin"))
    over = bins.withColumn("_end", running).where(F.col("_end") > total).agg(F.min(F.struct("_bin", (F.col("_end") - F.col("_sum")).alias("start"))).alias("x")).first()[0]
    last = None
    if over is not None:
        names = ("_time", "_key", "doc_id", "_copy", "row_id")
        here = copies.withColumn("_bin", bin_of(F.col("_time"))).where(F.col("_bin") == over["_bin"])
        upto = Window.partitionBy("_bin").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
        here = here.withColumn("_end", F.lit(over["start"]) + F.sum("size").over(upto))
        last = here.where(F.col("_end") <= total).agg(F.max(F.struct(*names)).alias("x")).first()[0]

    def kept(copy: Column) -> Column:
        if over is None:
            return F.lit(True)
        time, at = finish(copy), bin_of(finish(copy))
        if last is None:
            return at < over["_bin"]
        mine = F.struct(time.alias("_time"), F.col("_key"), F.col("doc_id"), copy.alias("_copy"), F.col("row_id"))
        end = F.struct(*[constant(last[n], copies.schema[n].dataType).alias(n) for n in names])
        return (at < over["_bin"]) | ((at == over["_bin"]) & (mine <= end))

    count = F.lit(0)
    for copy in range(max_repeats):
        count = count + F.when((F.col("size") > 0) & kept(F.lit(copy)), 1).otherwise(0)
    return timed.select("doc_id", "source", "size", "source_size", "target", count.alias("copies"), (F.col("size") * count).alias("taken"), "row_id", "_key")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document as often as the mix takes it, all columns as they were; not those without a word.

    A source's documents are taken in their shuffled order, so what the mix takes of it is told by the
    last document of each copy: a row for each source, and texts are neither copied nor, unless there
    are very many sources, shuffled. Rows are known by their file and place in it; where ``docs`` isn't
    read from files they are numbered and written first.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    try:
        at = docs.metadataColumn("_metadata")
        rows = docs.select(*docs.columns, F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")).alias("_goldpan_row"))
    except AnalysisException:
        rows = scratch.table(docs.withColumn("_goldpan_row", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))), "documents")
    found = mix(rows, weights, max_repeats, id_col, text_col, source_col, row=F.col("_goldpan_row"), by_size=False, scratch=scratch)
    last = [F.max(F.when(F.col("copies") > k, F.struct("_key", "doc_id", "row_id"))).alias(f"_goldpan_{k}") for k in range(max_repeats)]
    last = scratch.table(found.where("copies > 0").groupBy(F.col("source").alias("_goldpan_source")).agg(*last), "last")
    out = rows.join(last, rows[source_col].eqNullSafe(F.col("_goldpan_source")))
    mine = F.struct(shuffle_key(rows[id_col]).alias("_key"), rows[id_col].alias("doc_id"), F.col("_goldpan_row").alias("row_id"))
    copies = F.lit(0)
    for k in range(max_repeats):
        copies = copies + F.when(mine <= F.col(f"_goldpan_{k}"), 1).otherwise(0)
    out = out.where(F.col(text_col).rlike(WORD)).withColumn("_goldpan_copies", copies).where("_goldpan_copies > 0")
    return out.withColumn("_goldpan_copy", F.explode(F.sequence(F.lit(1), F.col("_goldpan_copies")))).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed: doc_id, size, source_size, target, taken."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
