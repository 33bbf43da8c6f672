"""Scores of predicted against true labels, from counts of (gold, pred) cells.

Everything but the counts needs 9 cells (27 for a pair of systems, 4 times that by tier), so one
aggregate over the predictions is all that grows with the data. A bootstrap resample is a draw of n
row numbers; with rows ordered by cell, a number's cell follows from the cells' running counts, so
draws never touch the rows. Draws come from ``hash`` (MD5 of seed, draw, place: the same in any
SQL), ``multinomial`` (numpy draws of cell counts, the same distribution in a fixed number of steps)
or ``replay`` (numpy row numbers over codes in example_id order, for small evaluation splits).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldpan.model import LABELS, TIERS
from goldpan.operators.conflicts import tier_rank


def _code(label: Column, what: str) -> Column:
    out = F.when(F.lit(True), F.raise_error(F.concat(F.lit(f"{what} label not in the domain: "), F.coalesce(label, F.lit("null")))).cast("int"))
    code = F.lit(None).cast("int")
    for k, name in enumerate(LABELS):
        code = F.when(label == name, k).otherwise(code)
    return F.coalesce(code, out)


def cells(scored: DataFrame, *systems: str) -> DataFrame:
    """(gold, <systems>..., n) of the combinations that occur, as codes 0 to 2."""
    codes = [_code(F.col("gold"), "gold").alias("gold"), *[_code(F.col(s), s).alias(s) for s in systems]]
    return scored.select(*codes).groupBy("gold", *systems).agg(F.count("*").alias("n"))


def confusion(scored: DataFrame) -> DataFrame:
    """(gold, pred, n) for all 9 combinations, by name."""
    found = cells(scored, "pred")
    names = F.array(*map(F.lit, LABELS))
    all_cells = scored.sparkSession.createDataFrame([(g, p) for g in range(3) for p in range(3)], "gold int, pred int")
    full = all_cells.join(F.broadcast(found), ["gold", "pred"], "left")
    return full.select(F.element_at(names, F.col("gold") + 1).alias("gold"), F.element_at(names, F.col("pred") + 1).alias("pred"), F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(scored: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support), 0 where a denominator is."""
    c = cells(scored, "pred")
    one = []
    for k, name in enumerate(LABELS):
        tp, pp, gp = (F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)) for cond in ((F.col("gold") == k) & (F.col("pred") == k), F.col("pred") == k, F.col("gold") == k))
        one += [tp.alias(f"tp{k}"), pp.alias(f"pp{k}"), gp.alias(f"gp{k}")]
    sums = c.agg(*one)
    rows = [F.struct(F.lit(name).alias("label"), F.col(f"tp{k}").alias("tp"), F.col(f"pp{k}").alias("pp"), F.col(f"gp{k}").alias("gp")) for k, name in enumerate(LABELS)]
    out = sums.select(F.inline(F.array(*rows)))
    p, r = _ratio(F.col("tp"), F.col("pp")), _ratio(F.col("tp"), F.col("gp"))
    out = out.select("label", p.alias("precision"), r.alias("recall"), F.col("gp").alias("support"))
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support")


def f1_of(count) -> Column:
    """Macro-F1 from count(gold code or None, pred code or None) columns."""
    total = F.lit(0.0)
    for k in range(3):
        tp, pp, gp = count(k, k), count(None, k), count(k, None)
        p, r = _ratio(tp, pp), _ratio(tp, gp)
        total = total + _ratio(2 * p * r, p + r)
    return total / F.lit(3.0)


def _sum_cells(gold: int | None, pred: int | None, n: Column, pred_col: str = "pred") -> Column:
    cond = F.lit(True)
    if gold is not None:
        cond = cond & (F.col("gold") == gold)
    if pred is not None:
        cond = cond & (F.col(pred_col) == pred)
    return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))


def macro_f1(scored: DataFrame) -> DataFrame:
    """One row, macro_f1: the mean over all three labels, absent ones too."""
    return cells(scored, "pred").agg(f1_of(lambda g, p: _sum_cells(g, p, F.col("n"))).alias("macro_f1"))


def accuracy(scored: DataFrame) -> DataFrame:
    """One row, accuracy: 0 for no rows."""
    return scored.agg(F.coalesce(F.avg(F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def tier_breakdown(scored: DataFrame, tier_col: str = "agreement_tier") -> DataFrame:
    """(kind, tier, n, macro_f1): exact tiers, and cumulative ones (a tier and all narrower). One scan:
    a row goes to its own tier and to every floor it reaches. Empty ones aren't listed."""
    rank = tier_rank(F.col(tier_col))
    floors = F.when(rank.isNotNull(), F.transform(F.slice(F.array(*map(F.lit, TIERS)), 1, rank + 1), lambda t: F.struct(F.lit("cumulative").alias("kind"), F.concat(t, F.lit("agree")).alias("tier")))).otherwise(F.array().cast("array<struct<kind:string,tier:string>>"))
    own = F.array(F.struct(F.lit("exact").alias("kind"), F.col(tier_col).alias("tier")))
    coded = scored.where(F.coalesce(tier_col, F.lit("")) != "").select(_code(F.col("gold"), "gold").alias("gold"), _code(F.col("pred"), "pred").alias("pred"), F.inline(F.concat(own, floors)))
    counts = coded.groupBy("kind", "tier", "gold", "pred").agg(F.count("*").alias("n"))
    return counts.groupBy("kind", "tier").agg(F.sum("n").alias("rows"), f1_of(lambda g, p: _sum_cells(g, p, F.col("n"))).alias("macro_f1")).withColumnRenamed("rows", "n")


def _drawn_hash(spark, counts: list[tuple], n: int, draws: int, seed: int) -> DataFrame:
    """(draw, gold, systems...) a row for each drawn place; cells in their order hold the row numbers."""
    place = spark.range(draws * n).select((F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("i"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("i").cast("string"))
    at = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n
    cell, end = F.lit(None).cast("int"), n
    for k in range(len(counts) - 1, -1, -1):  # at most 27 of them
        cell = F.when(F.col("at") < end, k).otherwise(cell)
        end -= counts[k][-1]
    return place.select("draw", at.alias("at")).select("draw", cell.alias("cell")).groupBy("draw", "cell").agg(F.count("*").alias("n"))


def _macro(table: np.ndarray) -> np.ndarray:
    """Macro-F1 of (..., 3, 3) counts."""
    tp = np.einsum("...ii->...i", table).astype(float)
    pp, gp = table.sum(-2), table.sum(-1)
    with np.errstate(all="ignore"):
        p, r = np.where(pp > 0, tp / pp, 0.0), np.where(gp > 0, tp / gp, 0.0)
        return np.where(p + r > 0, 2 * p * r / (p + r), 0.0).sum(-1) / 3


def _draw_values(scored: DataFrame, systems: tuple[str, ...], draws: int, seed: int, mode: str) -> tuple[np.ndarray | DataFrame, float, int]:
    """Macro-F1 (of a pair: its difference) in every draw, over all rows, and the number of rows."""
    counts = sorted(tuple(r) for r in cells(scored, *systems).collect())
    n = sum(c[-1] for c in counts)
    if not n:
        raise ValueError("no rows to draw from")

    def value(table: np.ndarray) -> np.ndarray:
        """table: (..., cells)"""
        tables = np.zeros((len(systems), *table.shape[:-1], 3, 3), dtype=np.int64)
        for k, c in enumerate(counts):
            for s in range(len(systems)):
                tables[s][..., c[0], c[1 + s]] += table[..., k]
        scores = [_macro(t) for t in tables]
        return scores[0] - scores[1] if len(systems) == 2 else scores[0]

    whole = float(value(np.array([c[-1] for c in counts])))
    if mode == "hash":
        drawn = _drawn_hash(scored.sparkSession, counts, n, draws, seed)
        gold = F.element_at(F.array(*[F.lit(c[0]) for c in counts]), F.col("cell") + 1)
        preds = [F.element_at(F.array(*[F.lit(c[1 + s]) for c in counts]), F.col("cell") + 1).alias(f"p{s}") for s in range(len(systems))]
        drawn = drawn.select("draw", gold.alias("gold"), *preds, "n")
        f = [f1_of(lambda g, p, s=s: _sum_cells(g, p, F.col("n"), f"p{s}")) for s in range(len(systems))]
        return drawn.groupBy("draw").agg((f[0] - f[1] if len(f) == 2 else f[0]).alias("value")), whole, n
    rng = np.random.default_rng(seed)
    if mode == "multinomial":
        return value(rng.multinomial(n, np.array([c[-1] for c in counts]) / n, size=draws)), whole, n
    if mode != "replay":
        raise ValueError(f"unknown mode {mode!r}")
    code = {c[:-1]: k for k, c in enumerate(counts)}
    names = ["gold", *systems]
    rows = scored.select("example_id", *[_code(F.col(c), c).alias(c) for c in names]).orderBy("example_id").select(*names).collect()
    codes = np.array([code[tuple(r)] for r in rows])
    return np.array([value(np.bincount(codes[rng.integers(0, n, n)], minlength=len(counts))) for _ in range(draws)]), whole, n


def _percentiles(values: np.ndarray | DataFrame) -> tuple[float, float, float]:
    """The 2.5 and 97.5 percentiles, and the share of draws at 0 or below."""
    if isinstance(values, DataFrame):
        r = values.agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.avg(F.when(F.col("value") <= 0, 1.0).otherwise(0.0)).alias("s")).first()
        return r["p"][0], r["p"][1], r["s"]
    low, high = np.percentile(values, [2.5, 97.5])
    return float(low), float(high), float((values <= 0).mean())


def bootstrap_macro_f1(scored: DataFrame, draws: int = 10000, seed: int = 0, mode: str = "multinomial") -> dict:
    """value, low and high (95 %) and method."""
    values, whole, _ = _draw_values(scored, ("pred",), draws, seed, mode)
    low, high, _ = _percentiles(values)
    return {"value": whole, "low": low, "high": high, "method": f"bootstrap-{draws}"}


def paired_bootstrap(scored: DataFrame, a: str = "pred_a", b: str = "pred_b", draws: int = 10000, seed: int = 0, mode: str = "multinomial") -> dict:
    """delta of a over b, low, high, p_value (two-sided) and separated (0 is outside the interval)."""
    values, delta, _ = _draw_values(scored, (a, b), draws, seed, mode)
    low, high, below = _percentiles(values)
    return {"delta": delta, "low": low, "high": high, "p_value": min(1.0, 2 * min(below, 1 - below)), "separated": low > 0 or high < 0}


def holm(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(name, p_value, ord) -> (name, p_value, threshold, significant). ord breaks ties; a test isn't
    significant once one with a smaller p-value wasn't. The family of tests is small: one partition."""
    order = Window.orderBy("p_value", "ord")
    ranked = p_values.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy())})
    ranked = ranked.withColumn("threshold", F.lit(float(alpha)) / (F.col("_n") - F.col("_r") + 1))
    passed = F.min(F.col("p_value") <= F.col("threshold")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("name", "p_value", "threshold", passed.alias("significant"))
