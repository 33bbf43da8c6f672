"""Documents with labelled spans: repaired offsets, target rows, an audit of disagreeing targets.

Input: (pos, content, annotations array<struct<value, label, start, end, tag>>); pos is the order of
the documents. Copies of a document, by stripped content, count once, the first of them. A span's
offset is repaired to the nearest occurrence of its value. A document in which one target has two
labels is counted and its rows are dropped. Offsets refer to the content as it came, text is
stripped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldpan.functions.text import nearest_offset, strip
from goldpan.model import make_id

#: The source's labels.
LABEL_NAMES = {"Positive": "positive", "Negative": "negative", "Neutral": "neutral"}
SOURCE = "finentity"

#: Spans with this row type that a document may hold.
ANNOTATIONS = "array<struct<value:string,label:string,start:int,end:int,tag:string>>"


def first_copies(docs: DataFrame) -> DataFrame:
    """The documents with text, the stripped content, and first: whether it's the first of its copies."""
    docs = docs.withColumn("text", strip(F.col("content")))
    # Copies meet by hash with the least pos found before a join, so a common content is one row.
    least = docs.groupBy(F.col("text").alias("_text")).agg(F.min("pos").alias("_pos"))
    return docs.join(least, docs["text"] == least["_text"]).withColumn("first", F.col("pos") == F.col("_pos")).drop("_text", "_pos")


def span_rows(docs: DataFrame) -> DataFrame:
    """A row for each span of the first copies: pos, text, span (its order), target, label, recorded, at, length."""
    spans = docs.where("first").select("pos", "content", "text", F.posexplode("annotations").alias("span", "a"))
    name = F.lit(None).cast("string")
    for given, label in LABEL_NAMES.items():
        name = F.when(F.col("a.label") == given, label).otherwise(name)
    name = F.coalesce(name, F.raise_error(F.concat(F.lit("unknown span label "), F.coalesce("a.label", F.lit("null")))).cast("string"))
    at = nearest_offset(F.col("content"), F.col("a.value"), F.col("a.start"))
    return spans.select("pos", "text", "span", strip(F.col("a.value")).alias("target"), name.alias("label"), F.col("a.start").alias("recorded"), at.alias("at"), F.length("a.value").alias("length"))


def targets(spans: DataFrame) -> DataFrame:
    """A row for each (document, target): its first span in order, and n_labels, how many labels it has."""
    good = spans.where("at is not null")
    per = good.groupBy("pos", "text", "target").agg(F.min(F.struct("span", "label", "at", "length")).alias("x"), F.count_distinct("label").alias("n_labels"))
    return per.select("pos", "text", "target", F.col("x.label").alias("label"), F.col("x.at").alias("at"), (F.col("x.at") + F.col("x.length")).alias("end"), "n_labels")


def _whole(per_target: DataFrame) -> DataFrame:
    """The targets with conflicted: whether any target of the document has two labels."""
    return per_target.withColumn("conflicted", F.max("n_labels").over(Window.partitionBy("pos")) > 1)


def target_rows(docs: DataFrame) -> DataFrame:
    """sentence_id, text, target, label, target_start, target_end, without self-conflicting documents."""
    kept = _whole(targets(span_rows(first_copies(docs)))).where("not conflicted")
    return kept.select(make_id(SOURCE, F.col("text")).alias("sentence_id"), "text", "target", "label", F.col("at").alias("target_start"), F.col("end").alias("target_end"))


def audit(docs: DataFrame) -> DataFrame:
    """One row with all counters and label_counts, a map."""
    marked = first_copies(docs)
    heads = marked.agg(F.count(F.when(F.col("first"), 1)).alias("n_documents"), F.count(F.when(~F.col("first"), 1)).alias("n_duplicate_documents"))
    spans = span_rows(marked)
    labels = [F.count(F.when(F.col("label") == name, 1)).alias(f"_{name}") for name in sorted(LABEL_NAMES.values())]
    per_span = spans.agg(
        F.count("*").alias("n_spans"),
        F.count(F.when(F.col("at").isNull(), 1)).alias("n_unrepairable"),
        F.count(F.when(F.col("at") != F.col("recorded"), 1)).alias("n_repaired_offsets"),
        *labels,
    )
    docs_of = targets(spans).groupBy("pos").agg(F.count("*").alias("n"), F.collect_set("label").alias("labels"), F.max("n_labels").alias("most"))
    good, many = F.col("most") == 1, (F.col("most") == 1) & (F.col("n") >= 2)
    differ = many & (F.size("labels") >= 2)
    per_doc = docs_of.agg(
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("n_targets"),
        F.count(F.when(F.col("most") > 1, 1)).alias("n_self_conflicting"),
        F.count(F.when(many, 1)).alias("n_multi_target"),
        F.count(F.when(differ, 1)).alias("n_multi_label"),
        F.count(F.when(many & F.array_contains("labels", "positive") & F.array_contains("labels", "negative"), 1)).alias("n_polar_opposite"),
        F.coalesce(F.sum(F.when(differ, F.col("n"))), F.lit(0)).alias("targets_from_multi_label"),
    )
    one = heads.join(F.broadcast(per_span)).join(F.broadcast(per_doc))  # one row each
    counted = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in sorted(LABEL_NAMES.values())]), F.array(*[F.col(f"_{c}") for c in sorted(LABEL_NAMES.values())])), lambda _, n: n > 0)
    rate = F.when(F.col("n_documents") > 0, F.col("n_multi_label") / F.col("n_documents")).otherwise(0.0)
    return one.select(
        "n_documents", "n_spans", "n_targets", "n_repaired_offsets", "n_unrepairable", "n_duplicate_documents", "n_multi_target",
        "n_multi_label", "n_polar_opposite", "n_self_conflicting", "targets_from_multi_label", rate.alias("multi_label_rate"), counted.alias("label_counts"),
    )


def passes_gate(audited: DataFrame, least: int = 100) -> bool:
    """Whether enough documents have targets with different labels."""
    return audited.first()["n_multi_label"] >= least
