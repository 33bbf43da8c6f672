"""The one place where systems are scored on a frozen split."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldpan.model import LABELS, SCORED_SOURCES
from goldpan.operators import metrics
from goldpan.scratch import Scratch
from goldpan.sources import store
from goldpan.sources.readers import row_lines


class System(Protocol):
    """name, and predictions (example_id, pred) for rows; evidence_grade if it isn't "supported"."""

    name: str

    def predict(self, docs: DataFrame) -> DataFrame: ...


def guard(rows: DataFrame, path, expected_hash: str | None) -> str:
    """The split's hash, if it has rows, all labelled by people, and is the expected file."""
    found = rows.agg(F.count("*").alias("n"), F.collect_set(F.when(~F.col("label_source").isin(*SCORED_SOURCES), F.col("label_source"))).alias("others")).first()
    if not found["n"]:
        raise ValueError(f"{path} has no rows to score")
    if found["others"]:
        raise AssertionError(f"{path} holds labels that no person gave: {', '.join(sorted(found['others']))}")
    actual = store.file_hash(path)
    if expected_hash not in (None, "", actual):
        raise AssertionError(f"{path} has changed: its hash is {actual}, not {expected_hash}")
    return actual


def joined(rows: DataFrame, predictions: DataFrame, name: str, n: int, as_name: str = "pred") -> DataFrame:
    """The rows with their prediction, one for each; otherwise AssertionError."""
    given = predictions.select(F.col("example_id").alias("_id"), F.col("pred").alias(as_name))
    found = rows.join(given, rows["example_id"] == F.col("_id"), "left").drop("_id")
    got = found.agg(F.count("*").alias("rows"), F.count(as_name).alias("answered")).first()
    if got["rows"] != n or got["answered"] != n:
        raise AssertionError(f"{name} gave {got['answered']} predictions for {n} rows: every row needs one")
    return found


def score(spark: SparkSession, system: System, path, expected_hash: str | None = None, comparators: dict[str, DataFrame] | None = None, bootstrap: int = 2000, seed: int = 0, mode: str = "multinomial") -> dict:
    """A report on one system. comparators: name -> (example_id, pred) of systems to compare with."""
    scratch = Scratch(spark, "harness")
    rows = scratch.table(row_lines(spark, str(path)), "rows")
    digest, n = guard(rows, path, expected_hash), rows.count()
    scored = joined(rows.withColumnRenamed("label", "gold"), system.predict(rows), system.name, n)
    scored = scratch.table(scored.select("example_id", "gold", "pred", "agreement_tier"), "scored")

    tiers: dict = {"exact": {}, "cumulative": {}}
    for r in metrics.tier_breakdown(scored).orderBy("kind", "tier").collect():
        tiers[r["kind"]][r["tier"]] = {"n": r["n"], "macro_f1": r["macro_f1"]}
    against = {}
    for name, other in (comparators or {}).items():
        both = joined(scored.withColumnRenamed("pred", "pred_a"), other, name, n, "pred_b")
        pair = metrics.paired_bootstrap(both, "pred_a", "pred_b", bootstrap, seed, mode)
        against[name] = interval(pair)
    table: dict = {g: {} for g in LABELS}
    for r in metrics.confusion(scored).collect():
        table[r["gold"]][r["pred"]] = r["n"]
    return {
        "system": system.name,
        "split": PurePosixPath(str(path)).stem,
        "split_hash": digest,
        "n": n,
        "macro_f1": interval(metrics.bootstrap_macro_f1(scored, bootstrap, seed, mode)),
        "accuracy": metrics.accuracy(scored).first()["accuracy"],
        "per_class": {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in metrics.per_class(scored).collect()},
        "confusion": table,
        "by_agreement_tier": tiers,
        "vs": against,
        "evidence_grade": getattr(system, "evidence_grade", "supported"),
        "notes": "",
    }


def interval(found: dict) -> dict:
    """low and high as ci95."""
    out = {k: v for k, v in found.items() if k not in ("low", "high")}
    return out | {"ci95": [found["low"], found["high"]]}


def write_report(report: dict, out_dir) -> str:
    return store.write_json(report, f"{out_dir}/{report['system']}.{report['split']}.json")
