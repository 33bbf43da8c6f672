"""The corpus pipeline: five stages over documents, each an operator of goldpan.llm.

A stage takes what the one before it has written and reads it all. The first four return the
columns of documents; the last returns the packed pieces. The language stage drops documents
without a letter and those whose language can't be told (a score under one half). The line stage
takes out repeated lines and counts the characters anew. The near-duplicate stage leaves the
smallest doc_id of each group. The mixing stage leaves each document as often as the mix takes it.
SQL can't express the first stage, so there is no SQL for the whole; tests hold every stage against
a brute-force version.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from goldpan.llm import language, line_dedup, mixing, packing, simhash
from goldpan.scratch import Scratch, gathered, shared_dir

#: What the stages of a run hold in the shared folder, by table and number of the stage.
_held: dict[tuple[str, int], list[Scratch]] = {}


def stage(number: int):
    """A stage is called with the written result of the one before, so what that one held can go."""

    def wrap(operator):
        @functools.wraps(operator)
        def run_stage(spark, docs, sf_dir):
            before = _held.pop((sf_dir, number - 1), [])
            for scratch in before:
                scratch.clear()
            if before:
                before[0].sweep()
            with gathered() as opened:
                out = operator(spark, docs, sf_dir)
            _held.setdefault((sf_dir, number), []).extend(opened)
            return out

        return run_stage

    return wrap


@stage(1)
def tell_language(spark, docs, sf_dir):
    return language.reject(docs, least=0.5)


@stage(2)
def drop_repeated_lines(spark, docs, sf_dir):
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage(3)
def drop_near_duplicates(spark, docs, sf_dir):
    return simhash.keep_one(docs)


@stage(4)
def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


@stage(5)
def pack_sequences(spark, docs, sf_dir):
    return packing.pack_documents(docs)


STAGES = [
    ("language", tell_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each stage's result written as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/goldpan/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
