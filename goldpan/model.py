"""The labelled row: its schema, domains, ids and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The label domain in its order, where labels come from, which of these may be
#: scored against, the tiers of annotator agreement from widest to narrowest, evidence grades.
LABELS = ("negative", "neutral", "positive")
LABEL_SOURCES = ("human", "public", "weak", "augmented")
SCORED_SOURCES = ("human",)
TIERS = ("50", "66", "75", "all")
GRADES = ("supported", "reported", "compromised", "not_run")

REQUIRED = ("example_id", "text", "label", "label_source", "source_dataset", "source_licence", "codebook_version")
OPTIONAL = ("agreement_tier", "borrowed_row_id", "dup_group", "family_id", "split")
#: All are strings; an optional one that is absent is the empty string, never null.
ROW = StructType([StructField(name, StringType()) for name in (*REQUIRED, *OPTIONAL)])


def make_id(source: str | Column, text: Column) -> Column:
    """source:first 16 hex digits of the text's SHA-256."""
    source = F.lit(source) if isinstance(source, str) else source
    return F.concat(source, F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))


def rows(df: DataFrame, **given: str | Column) -> DataFrame:
    """df in the row schema: columns it has, ``given`` columns or literals, else the empty string."""
    def column(name: str) -> Column:
        if name in given:
            value = given[name]
            return (value if isinstance(value, Column) else F.lit(value)).cast("string").alias(name)
        return F.col(name).cast("string").alias(name) if name in df.columns else F.lit("").alias(name)

    return df.select(*[column(f.name) for f in ROW.fields])


def group_key() -> Column:
    """A row's near-duplicate group, or its own id where it has none."""
    return F.coalesce(F.nullif(F.col("dup_group"), F.lit("")), F.col("example_id"))


def violations(df: DataFrame) -> DataFrame:
    """(example_id, problem) of the rows that break the schema's rules, the first rule each."""
    def blank(name: str) -> Column:
        return F.col(name).isNull() | F.col(name).rlike(r"(?U)^\s*$")

    problem = F.when(F.col("label").isNull() | ~F.col("label").isin(*LABELS), F.concat(F.lit("label not in the domain: "), F.coalesce("label", F.lit("null"))))
    problem = problem.when(F.col("label_source").isNull() | ~F.col("label_source").isin(*LABEL_SOURCES), F.concat(F.lit("bad label_source: "), F.coalesce("label_source", F.lit("null"))))
    for name in ("text", "source_dataset", "source_licence", "codebook_version"):
        problem = problem.when(blank(name), F.lit(f"{name} is empty"))
    return df.select("example_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def validate(df: DataFrame) -> DataFrame:
    """df, or ValueError that names its first offending row by id."""
    bad = violations(df).orderBy("example_id").first()
    if bad is not None:
        raise ValueError(f"{bad['example_id']}: {bad['problem']}")
    return df
