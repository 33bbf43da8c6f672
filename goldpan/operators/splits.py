"""Grouped train/dev/test splits: first-fit cut, statistics, invariants.

Groups are taken in a shuffled order; each goes to test if it still fits there, else to dev if it
fits, else to train. In the ``hash`` order (by MD5 of seed and key) only the groups that may fit
are looked at, ``chunk`` at a time: the driver holds a chunk and the groups of test and dev, whose
sizes the targets bound, however many groups there are. The ``replay`` order is the seeded
shuffle of Python's random module over groups by falling size, then key; it needs every group on
the driver and is refused above ``most`` groups.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.model import SCORED_SOURCES, group_key, violations


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(group_key().alias("key")).agg(F.count("*").alias("n"))


def hash_order(seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary"))


class FirstFit:
    def __init__(self, n_test: int, n_dev: int):
        self.left = {"test": n_test, "dev": n_dev}
        self.chosen: list[tuple[str, str]] = []

    def offer(self, key: str, n: int) -> None:
        for name in self.left:
            if n <= self.left[name]:
                self.left[name] -= n
                self.chosen.append((key, name))
                return

    def most(self) -> int:
        return max(self.left.values())


def assignment(groups: DataFrame, n_test: int, n_dev: int, seed: int, order: str = "hash", chunk: int = 100_000, most: int = 5_000_000) -> list[tuple[str, str]]:
    """(key, split) of the groups that go to test or dev."""
    fit = FirstFit(n_test, n_dev)
    if order == "replay":
        if groups.count() > most:
            raise ValueError(f"over {most} groups; use the hash order")
        keys = [(r["key"], r["n"]) for r in groups.orderBy(F.col("n").desc(), "key").collect()]
        random.Random(seed).shuffle(keys)
        for key, n in keys:
            fit.offer(key, n)
        return fit.chosen
    if order != "hash":
        raise ValueError(f"unknown order {order!r}")
    ordered = groups.withColumn("o", hash_order(seed))
    after = None
    while fit.most() > 0:
        # A group larger than what is left fits nowhere, now or later.
        rest = ordered.where(F.col("n") <= fit.most())
        if after is not None:
            rest = rest.where(F.struct("o", "key") > F.struct(F.lit(after[0]), F.lit(after[1])))
        taken = rest.orderBy("o", "key").limit(chunk).collect()
        for r in taken:
            fit.offer(r["key"], r["n"])
        if len(taken) < chunk:
            break
        after = taken[-1]["o"], taken[-1]["key"]
    return fit.chosen


def cut(rows: DataFrame, n_test: int, n_dev: int, seed: int = 20260821, order: str = "hash", **options) -> DataFrame:
    """The rows with their split. No group straddles two splits."""
    chosen = assignment(group_sizes(rows), n_test, n_dev, seed, order, **options)
    table = rows.sparkSession.createDataFrame(chosen, "_key string, _split string")  # n_test + n_dev rows at most
    keyed = rows.withColumn("_k", group_key())
    split = F.coalesce("_split", F.lit("train"))
    out = keyed.join(F.broadcast(table), keyed["_k"] == table["_key"], "left").withColumn("_name", split)
    return out.select(*[F.col("_name").alias("split") if c == "split" else rows[c] for c in rows.columns], *([] if "split" in rows.columns else [F.col("_name").alias("split")]))


def stats(rows: DataFrame) -> DataFrame:
    """(split, kind, value, n) for train, dev, test: kind rows and groups, label and tier counts, by grouping sets."""
    keyed = rows.select("split", "label", F.col("agreement_tier").alias("tier"), group_key().alias("g"))
    sets = keyed.groupingSets([("split",), ("split", "label"), ("split", "tier")], "split", "label", "tier").agg(F.count("*").alias("n"), F.count_distinct("g").alias("groups"), F.grouping_id().alias("level"))
    whole = sets.where("level = 3").select("split", F.inline(F.array(F.struct(F.lit("rows").alias("kind"), F.lit("").alias("value"), F.col("n")), F.struct(F.lit("groups").alias("kind"), F.lit("").alias("value"), F.col("groups").alias("n")))))
    label = sets.where("level = 1").select("split", F.lit("label").alias("kind"), F.col("label").alias("value"), "n")
    tier = sets.where("level = 2").select("split", F.lit("tier").alias("kind"), F.col("tier").alias("value"), "n")
    found = whole.unionByName(label).unionByName(tier)
    zero = rows.sparkSession.createDataFrame([(s, k, "", 0) for s in ("train", "dev", "test") for k in ("rows", "groups")], "split string, kind string, value string, n long")
    return found.unionByName(zero).groupBy("split", "kind", "value").agg(F.sum("n").alias("n")).where(F.col("split").isin("train", "dev", "test"))


def stats_dict(rows: DataFrame) -> dict:
    """The statistics as nested maps, as a manifest holds them."""
    out = {s: {"n": 0, "labels": {}, "agreement_tiers": {}, "groups": 0} for s in ("train", "dev", "test")}
    place = {"label": "labels", "tier": "agreement_tiers"}
    for split, kind, value, n in stats(rows).orderBy("split", "kind", "value").collect():
        if kind in place:
            out[split][place[kind]][value] = n
        else:
            out[split]["n" if kind == "rows" else "groups"] = n
    return out


def straddling(rows: DataFrame) -> DataFrame:
    """(check, n): example ids, near-duplicate groups and families that are in two splits, and
    non-human labels in dev and test."""
    def over(key, name: str) -> DataFrame:
        per = rows.select(key.alias("k"), "split").where("k is not null and k <> ''").groupBy("k").agg(F.count_distinct("split").alias("s"))
        return per.agg(F.count(F.when(F.col("s") > 1, 1)).alias("n")).select(F.lit(name).alias("check"), "n")

    human = rows.where(F.col("split").isin("dev", "test") & ~F.col("label_source").isin(*SCORED_SOURCES)).agg(F.count("*").alias("n"))
    out = over(F.col("example_id"), "ids").unionByName(over(group_key(), "groups")).unionByName(over(F.col("family_id"), "families"))
    return out.unionByName(human.select(F.lit("non_human").alias("check"), "n"))


def check_invariants(rows: DataFrame) -> None:
    """ValueError for a row against the schema, AssertionError for a leak between splits; the first found."""
    bad = violations(rows).orderBy("example_id").first()
    if bad is not None:
        raise ValueError(f"{bad['example_id']}: {bad['problem']}")
    n = {r["check"]: r["n"] for r in straddling(rows).collect()}
    if n["ids"]:
        raise AssertionError(f"{n['ids']} example ids appear in more than one split")
    if n["groups"]:
        raise AssertionError(f"{n['groups']} near-duplicate groups straddle two splits")
    if n["families"]:
        raise AssertionError(f"{n['families']} augmentation families straddle two splits")
    if n["non_human"]:
        where = rows.where(F.col("split").isin("dev", "test") & ~F.col("label_source").isin(*SCORED_SOURCES)).select("split", "label_source").distinct().collect()
        raise AssertionError(f"an evaluation split carries non-human labels: {sorted({tuple(r) for r in where})}")

