"""Resolving labels: sentences with several files' or several aspects' labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.model import TIERS

#: Scores from here on aren't neutral; both bounds are exclusive.
NEGATIVE_BELOW, POSITIVE_ABOVE = -0.1, 0.1


def score_to_label(score: Column) -> Column:
    """The label of a score; NaN and null are neutral."""
    score = F.when(F.isnan(score), None).otherwise(score)
    return F.when(score < F.lit(NEGATIVE_BELOW), "negative").when(score > F.lit(POSITIVE_ABOVE), "positive").otherwise("neutral")


def tier_rank(tier: Column) -> Column:
    """0 for the widest tier; null for no tier."""
    out = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(TIERS))):
        out = F.when(tier == name, k).otherwise(out)
    return out


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank + 1)


def tier_at_least(df: DataFrame, tier: str, col: str = "agreement_tier") -> DataFrame:
    """The rows that reach a tier or a narrower one. ValueError for an unknown tier, its own or a row's."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}, expected one of {TIERS}")
    rank = tier_rank(F.col(col))
    rank = F.when(rank.isNull(), F.raise_error(F.concat(F.lit("unknown tier "), F.coalesce(F.col(col), F.lit("null"))))).otherwise(rank)
    return df.where(rank >= TIERS.index(tier))


def resolve_pool(lines: DataFrame) -> DataFrame:
    """(tier, text, label) lines of nested files -> a row for each text: labels (sorted), tier (the
    narrowest file that has it), repeated (twice or more in one file)."""
    per_file = lines.groupBy("text", "tier").agg(F.collect_set("label").alias("labels"), F.count("*").alias("n"))
    pooled = per_file.groupBy("text").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.max(tier_rank(F.col("tier"))).alias("rank"),
        F.max(F.col("n") > 1).alias("repeated"),
    )
    return pooled.select("text", "labels", tier_name(F.col("rank")).alias("tier"), "repeated")


def pool_rows(pooled: DataFrame) -> DataFrame:
    """(text, label, tier) of the texts with one label."""
    return pooled.where(F.size("labels") == 1).select("text", F.element_at("labels", 1).alias("label"), "tier")


def pool_dropped(pooled: DataFrame) -> DataFrame:
    """(text, labels, tier) of the texts whose labels contradict each other."""
    return pooled.where(F.size("labels") > 1).select("text", "labels", "tier")


def pool_audit(lines: DataFrame, pooled: DataFrame) -> DataFrame:
    """One row: n_lines of the widest file, n_repeated_texts, n_usable, n_dropped."""
    counts = pooled.agg(
        F.count(F.when(F.col("repeated"), 1)).alias("n_repeated_texts"),
        F.count(F.when(F.size("labels") == 1, 1)).alias("n_usable"),
        F.count(F.when(F.size("labels") > 1, 1)).alias("n_dropped"),
    )
    n = lines.where(F.col("tier") == TIERS[0]).agg(F.count("*").alias("n_lines"))
    return n.join(F.broadcast(counts))  # one row each


def resolve_scored(scored: DataFrame, text_col: str = "sentence", score_col: str = "score") -> DataFrame:
    """(text, label, n_labels): each text once, with its alphabetically first label and how many it has."""
    per = scored.groupBy(F.col(text_col).alias("text")).agg(F.sort_array(F.collect_set(score_to_label(F.col(score_col)))).alias("labels"))
    return per.select("text", F.element_at("labels", 1).alias("label"), F.size("labels").alias("n_labels"))


def scored_audit(resolved: DataFrame) -> DataFrame:
    """One row: n_sentences, n_conflicted_sentences, conflict_rate."""
    n, bad = F.count("*"), F.count(F.when(F.col("n_labels") > 1, 1))
    return resolved.agg(n.alias("n_sentences"), bad.alias("n_conflicted_sentences"), F.when(n > 0, bad / n).otherwise(0.0).alias("conflict_rate"))


def majority_label(rows: DataFrame, order_col: str, label_col: str = "label") -> DataFrame:
    """One row, (label, n): the commonest label, of equal ones that which comes first by order_col."""
    counts = rows.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"), F.min(order_col).alias("first"))
    return counts.orderBy(F.col("n").desc(), "first").limit(1).select("label", "n")


class MajoritySystem:
    """Predicts one label; neutral until fitted."""

    name, evidence_grade = "majority", "supported"

    def __init__(self):
        self.label = "neutral"

    def fit(self, rows: DataFrame, order_col: str = "example_id") -> MajoritySystem:
        best = majority_label(rows, order_col).first()
        if best is None:
            raise ValueError("no rows to fit on")
        self.label = best["label"]
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        return docs.select("example_id", F.lit(self.label).alias("pred"))
