"""Readers of the text formats: zipped line files, CSV, JSON arrays, JSON lines, sectioned lists."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from goldpan.functions import stemming
from goldpan.functions.text import strip
from goldpan.model import OPTIONAL, REQUIRED, ROW, make_id, rows, validate
from goldpan.operators.conflicts import pool_rows, resolve_pool, resolve_scored
from goldpan.operators.lexicon import Lexicon
from goldpan.operators.spans import ANNOTATIONS
from goldpan.sources import store

#: The file of each tier in the archive, and what the sources are called.
POOL_FILES = {"50": "Sentences_50Agree.txt", "66": "Sentences_66Agree.txt", "75": "Sentences_75Agree.txt", "all": "Sentences_AllAgree.txt"}
POOL = {"label_source": "human", "source_dataset": "takala/financial_phrasebank", "source_licence": "CC-BY-NC-SA-3.0", "codebook_version": "fpb-v1"}
SCORED = {"label_source": "human", "source_dataset": "pauri32/fiqa-2018", "source_licence": "unknown-verify-before-redistribution", "codebook_version": "fiqa-v1"}

#: The strings that the usual CSV readers of Python take for missing.
MISSING = ("", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tier, text, label) of all lines of a zip archive, or of a folder with its files.

    Lines end as Python's do, which knows more line ends than Spark's readers; so each member is
    read whole. A line is cut at its last @; without one the text is empty and fails validation.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def members(name: str, content: bytes):
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for inner in z.namelist():
                    if "__MACOSX" not in inner:
                        yield inner, z.read(inner)
        else:
            yield name, content

    def run(frames):
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"]):
                for inner, data in members(name, content):
                    tier = next((t for t, f in POOL_FILES.items() if inner.endswith(f)), None)
                    for line in data.decode("latin-1").splitlines() if tier else ():
                        if line.strip():
                            text, _, label = line.strip().rpartition("@")
                            out.append((tier, text.strip(), label.strip()))
            yield pd.DataFrame(out, columns=["tier", "text", "label"])

    return files.mapInPandas(run, "tier string, text string, label string")


def pool(spark: SparkSession, path: str) -> DataFrame:
    """The archive's usable sentences as rows, by example_id; a row against the schema is an error."""
    found = pool_rows(resolve_pool(pool_lines(spark, path)))
    key = make_id("fpb", F.col("text"))
    return validate(rows(found, example_id=key, borrowed_row_id=key, agreement_tier=F.col("tier"), **POOL)).orderBy("example_id")


def scored_sentences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(sentence, score) of CSV files with those columns; a missing sentence is "nan", a missing score NaN."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(list(paths))
    sentence = F.when(F.col("sentence").isNull() | F.col("sentence").isin(*MISSING), "nan").otherwise(F.col("sentence"))
    score = F.when(F.col("sentiment_score").isNull() | F.col("sentiment_score").isin(*MISSING), float("nan")).otherwise(F.col("sentiment_score").cast("double"))
    return raw.select(sentence.alias("sentence"), score.alias("score"))


def scored_rows(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, conflicted) rows of the sentences with one label and with several."""
    found = resolve_scored(scored)
    key = make_id("fiqa", F.col("text"))
    made = rows(found.withColumn("agreement_tier", F.lit("")), example_id=key, borrowed_row_id=key, **SCORED)
    validate(made)
    counts = found.select(key.alias("_id"), "n_labels")
    made = made.join(counts, made["example_id"] == counts["_id"]).drop("_id")
    return made.where("n_labels = 1").drop("n_labels"), made.where("n_labels > 1").drop("n_labels")


def span_documents(spark: SparkSession, path: str) -> DataFrame:
    """(pos, content, annotations) of a file that is one JSON array of documents."""
    whole = spark.read.text(path, wholetext=True)
    docs = F.from_json("value", f"array<struct<content:string,annotations:{ANNOTATIONS}>>")
    return whole.select(F.posexplode(docs).alias("pos", "d")).select("pos", "d.content", "d.annotations")


def row_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON-lines file, by example_id. A line with an unknown field, or without a required
    one, is an error; an optional one that is absent is the empty string."""
    lines = spark.read.text(path).where(F.length(strip(F.col("value"))) > 0)
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*map(F.lit, ROW.names)))
    absent = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown field "), F.element_at(unknown, 1))))
    checked = checked.when(F.size(absent) > 0, F.raise_error(F.concat(F.lit("missing field "), F.element_at(absent, 1)))).otherwise(F.col("value"))
    parsed = lines.select(F.from_json(checked.cast("string"), ROW).alias("r")).select("r.*")
    return parsed.fillna("", list(OPTIONAL)).orderBy("example_id")


def lexicon(path: str, name: str, source: str = "", evidence_grade: str = "reported", stemmer=stemming.stem) -> Lexicon:
    """A word list: # comments, [positive] and [negative] sections, one word a line. Words are stemmed."""
    sections: dict[str, set[str]] = {"positive": set(), "negative": set()}
    current: set[str] | None = None
    for raw in store.text(path).splitlines():
        line = raw.strip()
        if line.startswith("[") and line.endswith("]"):
            current = sections.get(line[1:-1])
        elif line and not line.startswith("#") and current is not None:
            current.add(stemmer(line.lower()))
    return Lexicon(name, frozenset(sections["positive"]), frozenset(sections["negative"]), source, evidence_grade)


def run_lines(spark: SparkSession, path: str) -> DataFrame:
    """A registry file as a DataFrame; without columns and rows where there is no file."""
    return spark.read.json(path) if store.exists(path) else spark.createDataFrame([], StructType())
