"""Rows, near-duplicate groups, splits, metrics, the harness and what is around them."""

import json
import itertools
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldpan import model
from goldpan.model import LABELS
from goldpan.operators import components, conflicts, metrics, near_dup, spans, splits, tfidf
from goldpan.plans import cli, harness, registry, settings
from goldpan.scratch import Scratch
from goldpan.sources import readers, store, writers


def pool(spark, n=60, **given):
    made = [(f"t:{i:04d}", f"The quarter {i} brought revenue number {i * 7} to the group in total", LABELS[i % 3]) for i in range(n)]
    df = spark.createDataFrame(made, "example_id string, text string, label string")
    return model.rows(df, **{"label_source": "human", "source_dataset": "test", "source_licence": "CC0", "codebook_version": "v0", **given})


# -- rows ---------------------------------------------------------------------------------------


def test_validation_names_the_row(spark):
    model.validate(pool(spark))
    for name in ("text", "source_dataset", "source_licence", "codebook_version"):
        with pytest.raises(ValueError, match=f"t:0000: {name} is empty"):
            model.validate(pool(spark).withColumn(name, F.lit(" \t")))
    with pytest.raises(ValueError, match="bad label_source: robot"):
        model.validate(pool(spark, label_source="robot"))
    with pytest.raises(ValueError, match="label not in the domain: mixed"):
        model.validate(pool(spark).withColumn("label", F.lit("mixed")))


# -- near-duplicates ----------------------------------------------------------------------------


def brute_groups(rows, threshold=0.5, cap=200):
    import re

    prints = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", t.lower())
        prints[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())
    holders = {}
    for i, s in prints.items():
        for x in s:
            holders.setdefault(x, set()).add(i)
    group = {i: i for i in prints}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for members in holders.values():
        if 2 <= len(members) <= cap:
            for a in members:
                for b in members:
                    if a < b and len(prints[a] & prints[b]) >= threshold * len(prints[a] | prints[b]):
                        x, y = sorted((find(a), find(b)))
                        group[y] = x
    return {i: find(i) for i in prints}


def near_rows(cap):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(80)]
    rows = [(f"d{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    for k in range(25):  # near copies, and chains of them
        i, t = rows[rng.randrange(len(rows))]
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "other"
        rows.append((f"e{k:03d}", " ".join(w)))
    common = "every row ends in this line"
    return rows + [(f"f{k:03d}", f"{rng.choice(words)} {common}" if k <= cap else common) for k in range(cap + 2)]


@pytest.mark.parametrize("cap", [3, 6, 200])
def test_groups_against_brute_force(spark, cap):
    rows = near_rows(min(cap, 6))
    got = {r["id"]: r["dup_group"] for r in near_dup.cluster(spark.createDataFrame(rows, "example_id string, text string"), cap=cap).collect()}
    assert got == brute_groups(rows, cap=cap)


def test_pairs_against_brute_force(spark):
    rows = near_rows(6)
    rows += [(f"g{k}", t) for k, (_, t) in enumerate(rows[:5])]
    prints = {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, t.split()) for i, t in rows)}
    held = Counter(s for p in prints.values() for s in p)
    df = spark.createDataFrame(rows + rows[:3], "example_id string, text string")
    for t in (0.3, 0.5, 0.8, 1.0):
        want = {}
        for a, b in itertools.combinations(sorted(prints), 2):
            both = prints[a] & prints[b]
            if any(held[s] <= 6 for s in both) and len(both) / len(prints[a] | prints[b]) >= t:
                want[a, b] = len(both) / len(prints[a] | prints[b])
        got = near_dup.similar_pairs(df, threshold=t, cap=6).collect()
        assert len(got) == len(want) > 0 and all(abs(want[r["l"], r["r"]] - r["jaccard"]) < 1e-12 for r in got)


def test_common_lines_and_copies_make_no_candidates(spark):
    """A line that 100 rows share is no reason to compare them, and 100 copies are one row."""
    own = [(f"r{i:03d}", "all of them share this line " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(100)]
    copies = [(f"c{i:03d}", "one and the same text stands in many rows") for i in range(100)]
    scratch = Scratch(spark, "test")
    pairs = near_dup.similar_pairs(spark.createDataFrame(own + copies, "example_id string, text string"), scratch=scratch)
    assert pairs.count() == 100 * 99 // 2
    made = [spark.read.parquet(str(p)).count() for p in Path(scratch.root.removeprefix("file://")).glob("*-candidates")]
    assert made == [0]


def test_cap_is_inclusive(spark):
    for n, groups in ((200, 1), (201, 201)):
        rows = spark.createDataFrame([(f"r{i:03d}", "one shingle of five words") for i in range(n)], "example_id string, text string")
        assert near_dup.cluster(rows).select("dup_group").distinct().count() == groups


def test_twins_share_a_group(spark):
    rows = pool(spark, 2).union(model.rows(spark.createDataFrame([("t:0009", "The quarter 1 brought revenue number 7 to the group in total again", "neutral")], "example_id string, text string, label string"), label_source="human", source_dataset="test", source_licence="CC0", codebook_version="v0"))
    got = {r["example_id"]: r["dup_group"] for r in near_dup.apply(rows).collect()}
    assert got == {"t:0000": "t:0000", "t:0001": "t:0001", "t:0009": "t:0001"}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}


# -- splits -------------------------------------------------------------------------------------


def grouped(spark):
    group = F.concat(F.lit("g"), (F.substring("example_id", 3, 4).cast("int") / 4).cast("int"))
    return pool(spark).withColumn("dup_group", F.when(F.substring("example_id", 6, 1) == "7", "").otherwise(group))


def first_fit(sizes, order, n_test, n_dev):
    left, out = {"test": n_test, "dev": n_dev}, {}
    for key in order:
        name = next((s for s in ("test", "dev") if sizes[key] <= left[s]), "train")
        out[key] = name
        if name != "train":
            left[name] -= sizes[key]
    return out


@pytest.mark.parametrize("order", ["replay", "hash"])
def test_cut_fills_targets_and_keeps_groups(spark, order):
    rows = splits.cut(grouped(spark), 12, 6, seed=7, order=order)
    again = splits.cut(grouped(spark), 12, 6, seed=7, order=order)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    n = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert (n["test"], n["dev"], n["train"]) == (12, 6, 42)
    splits.check_invariants(rows)
    other = splits.cut(grouped(spark), 12, 6, seed=8, order=order)
    assert sorted(map(tuple, rows.collect())) != sorted(map(tuple, other.collect()))


def test_cut_replays_the_seeded_shuffle(spark):
    sizes = {r["key"]: r["n"] for r in splits.group_sizes(grouped(spark)).collect()}
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    random.Random(7).shuffle(order)
    want = {k: s for k, s in first_fit(sizes, order, 12, 6).items() if s != "train"}
    assert dict(splits.assignment(splits.group_sizes(grouped(spark)), 12, 6, 7, "replay")) == want


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_cut_skips_groups_that_do_not_fit(spark, chunk):
    sizes = {f"k{i}": 1 + i * i % 9 for i in range(40)}
    groups = spark.createDataFrame(sorted(sizes.items()), "key string, n long")
    import hashlib

    order = sorted(sizes, key=lambda k: (hashlib.md5(f"3:{k}".encode()).hexdigest(), k))
    want = {k: s for k, s in first_fit(sizes, order, 25, 11).items() if s != "train"}
    assert dict(splits.assignment(groups, 25, 11, 3, chunk=chunk)) == want
    with pytest.raises(ValueError):
        splits.assignment(groups, 1, 1, 1, order="replay", most=3)


def test_invariants(spark):
    cut = splits.cut(grouped(spark), 12, 6, seed=7)
    one = F.col("example_id") == "t:0000"
    straddling = cut.withColumn("split", F.when(one, "train").otherwise("test"))
    with pytest.raises(AssertionError, match="straddle"):
        splits.check_invariants(straddling)
    families = pool(spark).withColumn("family_id", F.lit("f")).withColumn("split", F.when(one, "train").otherwise("test"))
    with pytest.raises(AssertionError, match="families straddle"):
        splits.check_invariants(families)
    with pytest.raises(AssertionError, match="non-human labels"):
        splits.check_invariants(pool(spark, label_source="weak").withColumn("split", F.lit("dev")))
    twice = pool(spark, 1).withColumn("split", F.lit("train")).union(pool(spark, 1).withColumn("split", F.lit("dev")))
    with pytest.raises(AssertionError, match="example ids"):
        splits.check_invariants(twice)


def test_freeze_is_byte_identical(spark, tmp_path):
    rows = splits.cut(grouped(spark), 12, 6, seed=7).withColumn("text", F.concat("text", F.lit(' "é" \\ end')))
    one, two = (writers.freeze(rows.repartition(n), tmp_path / str(n)) for n in (1, 5))
    assert one == two
    for name in ("train.jsonl", "dev.jsonl", "test.jsonl", "split_assignments.csv", "manifest.json"):
        assert (tmp_path / "1" / name).read_bytes() == (tmp_path / "5" / name).read_bytes()
    lines = (tmp_path / "1" / "dev.jsonl").read_text().splitlines()
    want = sorted((r.asDict() for r in rows.where("split = 'dev'").collect()), key=lambda r: r["example_id"])
    assert lines == [json.dumps(r, sort_keys=True) for r in want]
    assert one["stats"]["test"]["n"] == 12 and one["hashes"]["dev"] == store.file_hash(tmp_path / "1" / "dev.jsonl")
    assert sorted(map(tuple, readers.row_lines(spark, str(tmp_path / "1" / "dev.jsonl")).collect())) == sorted(map(tuple, rows.where("split = 'dev'").collect()))
    head, *rest = (tmp_path / "1" / "split_assignments.csv").read_text().splitlines()
    assert head == "example_id,split,agreement_tier,dup_group" and len(rest) == 60


def test_empty_splits_are_listed(spark):
    got = splits.stats_dict(pool(spark, 3).withColumn("split", F.lit("train")))
    assert got["dev"] == {"n": 0, "labels": {}, "agreement_tiers": {}, "groups": 0} and got["train"]["n"] == 3


# -- metrics ------------------------------------------------------------------------------------


def pairs(spark, gold, *preds, tier="all"):
    rows = [(f"x{i:05d}", g, tier, *p) for i, (g, *p) in enumerate(zip(gold, *preds))]
    names = ", ".join(f"{n} string" for n in ("pred", "pred_b")[: len(preds)])
    return spark.createDataFrame(rows, f"example_id string, gold string, agreement_tier string, {names}")


def plain_f1(gold, pred):
    total = 0.0
    for c in LABELS:
        tp = sum(g == p == c for g, p in zip(gold, pred))
        p, r = (tp / n if n else 0.0 for n in (sum(x == c for x in pred), sum(x == c for x in gold)))
        total += 2 * p * r / (p + r) if p + r else 0.0
    return total / 3


#: Confusion tables whose macro-F1 is known: rows gold negative, neutral, positive.
KNOWN = {0.2546: [[0, 66, 0], [0, 309, 0], [0, 125, 0]], 0.4426: [[20, 31, 15], [49, 219, 41], [11, 74, 40]], 0.5896: [[25, 28, 13], [11, 246, 52], [3, 55, 67]], 0.7385: [[37, 22, 7], [6, 283, 20], [1, 45, 79]]}


@pytest.mark.parametrize("value", sorted(KNOWN))
def test_known_tables(spark, value):
    table = KNOWN[value]
    gold, pred = zip(*[(LABELS[g], LABELS[p]) for g in range(3) for p in range(3) for _ in range(table[g][p])])
    df = pairs(spark, gold, pred)
    assert round(metrics.macro_f1(df).first()[0], 4) == value
    assert abs(metrics.macro_f1(df).first()[0] - plain_f1(gold, pred)) < 1e-12
    got = {(r["gold"], r["pred"]): r["n"] for r in metrics.confusion(df).collect()}
    assert [[got[g, p] for p in LABELS] for g in LABELS] == table
    low, high = {0.2546: (0.2431, 0.2651), 0.4426: (0.3941, 0.4907), 0.5896: (0.5349, 0.6416), 0.7385: (0.6885, 0.7848)}[value]
    found = metrics.bootstrap_macro_f1(df, 4000, 1)
    assert abs(found["low"] - low) < 0.005 and abs(found["high"] - high) < 0.005


def test_small_and_empty_vectors(spark):
    df = pairs(spark, ["negative", "neutral"], ["negative", "negative"])
    assert metrics.macro_f1(df).first()[0] == pytest.approx(plain_f1(["negative", "neutral"], ["negative", "negative"]))  # absent classes count
    assert metrics.accuracy(df).first()[0] == 0.5 and metrics.accuracy(df.limit(0)).first()[0] == 0.0
    assert metrics.macro_f1(df.limit(0)).first()[0] == 0.0
    assert [r["n"] for r in metrics.confusion(df.limit(0)).collect()] == [0] * 9
    with pytest.raises(Exception, match="not in the domain"):
        metrics.confusion(pairs(spark, ["mixed"], ["neutral"])).collect()


def noisy(n, wrong, seed=0):
    rng = random.Random(seed)
    gold = [LABELS[i % 3] for i in range(n)]
    return gold, [rng.choice(LABELS) if rng.random() < wrong else g for g in gold]


@pytest.mark.parametrize("mode", ["multinomial", "hash", "replay"])
def test_paired_bootstrap_separates_and_declines(spark, mode):
    gold, good = noisy(400, 0.1)
    bad = ["neutral"] * 400
    found = metrics.paired_bootstrap(pairs(spark, gold, good, bad), "pred", "pred_b", 300, 1, mode)
    assert found["separated"] and found["delta"] > 0 and found["p_value"] < 0.05
    same = metrics.paired_bootstrap(pairs(spark, gold, good, good), "pred", "pred_b", 300, 1, mode)
    assert same["delta"] == 0 and not same["separated"] and same["p_value"] == 0


def test_replay_draws_row_numbers_in_order(spark):
    gold, pred = noisy(120, 0.4)
    got = metrics.bootstrap_macro_f1(pairs(spark, gold, pred).repartition(5), 50, 3, "replay")
    rng = np.random.default_rng(3)
    draws = [plain_f1([gold[i] for i in at], [pred[i] for i in at]) for at in (rng.integers(0, 120, 120) for _ in range(50))]
    low, high = np.percentile(draws, [2.5, 97.5])
    assert (got["low"], got["high"]) == pytest.approx((low, high)) and got["value"] == pytest.approx(plain_f1(gold, pred))


def test_holm_is_strict_and_ordered(spark):
    family = lambda *p: spark.createDataFrame([(f"t{i}", float(x), i) for i, x in enumerate(p)], "name string, p_value double, ord int")
    got = {r["name"]: (r["threshold"], r["significant"]) for r in metrics.holm(family(0.001, 0.04, 0.02, 0.5)).collect()}
    assert got["t0"] == (pytest.approx(0.0125), True) and got["t2"] == (pytest.approx(0.05 / 3), False)
    assert not got["t1"][1] and not got["t3"][1]
    tied = {r["name"]: r["significant"] for r in metrics.holm(family(0.02, 0.02, 0.02)).collect()}
    assert tied == {"t0": False, "t1": False, "t2": False}  # 0.02 is over 0.05 / 3, and all later fail
    assert metrics.holm(family(0.05)).first()["significant"]


def test_tiers(spark):
    gold, pred = noisy(40, 0.3)
    tiers = ["50", "66", "75", "all", ""]
    df = pairs(spark, gold, pred).withColumn("agreement_tier", F.element_at(F.array(*map(F.lit, tiers)), (F.substring("example_id", 2, 5).cast("int") % 5 + 1).cast("int")))
    got = {(r["kind"], r["tier"]): (r["n"], r["macro_f1"]) for r in metrics.tier_breakdown(df).collect()}
    for k, t in enumerate(tiers[:4]):
        at = [i for i in range(40) if i % 5 == k]
        assert got["exact", t] == (len(at), pytest.approx(plain_f1([gold[i] for i in at], [pred[i] for i in at])))
        at = [i for i in range(40) if k <= i % 5 < 4]
        assert got["cumulative", f"{t}agree"] == (len(at), pytest.approx(plain_f1([gold[i] for i in at], [pred[i] for i in at])))
    assert len(got) == 8
    assert {r["tier"] for r in metrics.tier_breakdown(df.where("agreement_tier = '75'")).collect()} == {"75", "50agree", "66agree", "75agree"}


# -- labels -------------------------------------------------------------------------------------


def test_pool_resolution(spark):
    lines = [("50", "a", "neutral"), ("50", "a", "neutral"), ("all", "a", "neutral"), ("50", "b", "neutral"), ("66", "b", "positive"), ("66", "c", "negative"), ("75", "c", "negative")]
    df = spark.createDataFrame(lines, "tier string, text string, label string")
    pooled = conflicts.resolve_pool(df)
    assert sorted(map(tuple, conflicts.pool_rows(pooled).collect())) == [("a", "neutral", "all"), ("c", "negative", "75")]
    assert [tuple(r) for r in conflicts.pool_dropped(pooled).collect()] == [("b", ["neutral", "positive"], "66")]
    assert conflicts.pool_audit(df, pooled).first().asDict() == {"n_lines": 3, "n_repeated_texts": 1, "n_usable": 2, "n_dropped": 1}


def test_majority_prefers_the_first_of_equals(spark):
    rows = pool(spark, 4).withColumn("label", F.element_at(F.array(*map(F.lit, ["positive", "negative", "negative", "positive"])), F.substring("example_id", 6, 1).cast("int") + 1))
    assert conflicts.majority_label(rows, "example_id").first()["label"] == "positive"
    assert {r["pred"] for r in conflicts.MajoritySystem().predict(rows).collect()} == {"neutral"}
    assert conflicts.MajoritySystem().fit(rows).label == "positive"


def test_tiers_unknown(spark):
    rows = pool(spark, 4, agreement_tier="75")
    assert conflicts.tier_at_least(rows, "66").count() == 4 and conflicts.tier_at_least(rows, "all").count() == 0
    with pytest.raises(ValueError):
        conflicts.tier_at_least(rows, "80")
    with pytest.raises(Exception, match="unknown tier"):
        conflicts.tier_at_least(rows.withColumn("agreement_tier", F.lit("")), "50").collect()


# -- spans --------------------------------------------------------------------------------------


def documents(spark, *docs):
    def span(content, value, label, drift=0):
        at = max(content.find(value), 0) + drift
        return (value, label, at, at + len(value), "x")

    rows = [(i, c, [span(c, *s) for s in given]) for i, (c, given) in enumerate(docs)]
    return spark.createDataFrame(rows, f"pos int, content string, annotations {spans.ANNOTATIONS}")


def test_span_counters(spark):
    docs = documents(
        spark,
        ("Alpha rose.", [("Alpha", "Positive")]),
        ("  Alpha rose and Beta fell.", [("Alpha", "Positive"), ("Beta", "Negative")]),
        ("Gamma and Delta were flat.", [("Gamma", "Neutral"), ("Delta", "Neutral", 2)]),
        ("Eps rose, Eps fell, Zeta.", [("Eps", "Positive"), ("Eps", "Negative"), ("Zeta", "Neutral")]),
        ("Alpha rose.", [("Alpha", "Negative")]),
        ("Eta.", [("missing", "Neutral")]),
        ("Theta rose, Iota held.", [("Theta", "Positive"), ("Theta", "Positive", 1), ("Iota", "Neutral")]),
    )
    got = spans.audit(docs).first().asDict()
    assert got == {
        "n_documents": 6, "n_spans": 12, "n_targets": 7, "n_repaired_offsets": 2, "n_unrepairable": 1, "n_duplicate_documents": 1, "n_multi_target": 3,
        "n_multi_label": 2, "n_polar_opposite": 1, "n_self_conflicting": 1, "targets_from_multi_label": 4, "multi_label_rate": 2 / 6,
        "label_counts": {"negative": 2, "neutral": 5, "positive": 5},
    }
    rows = {r["target"]: r for r in spans.target_rows(docs).collect()}
    assert (rows["Beta"]["target_start"], rows["Beta"]["text"]) == (17, "Alpha rose and Beta fell.")
    assert rows["Delta"]["target_start"] == 10 and "Eps" not in rows
    assert not spans.passes_gate(spans.audit(docs)) and spans.passes_gate(spans.audit(docs), 2)
    with pytest.raises(Exception, match="unknown span label"):
        spans.audit(documents(spark, ("A.", [("A", "Odd")]))).collect()


# -- sources ------------------------------------------------------------------------------------


def test_pool_archive(spark, tmp_path):
    import zipfile

    body = "Profit rose @ 5 % .@positive\r\n\n  Sales fell\x85Flat é@neutral \nno label here\n"
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("x/Sentences_50Agree.txt", body.encode("latin-1"))
        z.writestr("x/Sentences_AllAgree.txt", "Flat é@neutral\n".encode("latin-1"))
        z.writestr("__MACOSX/x/Sentences_66Agree.txt", b"junk@neutral\n")
    got = sorted(map(tuple, readers.pool_lines(spark, str(tmp_path / "p.zip")).collect()))
    assert got == [("50", "", "Sales fell"), ("50", "", "no label here"), ("50", "Flat é", "neutral"), ("50", "Profit rose @ 5 % .", "positive"), ("all", "Flat é", "neutral")]
    rows = readers.pool(spark, str(tmp_path / "p.zip")).where("text = 'Flat é'").first()
    assert rows["agreement_tier"] == "all" and rows["example_id"] == rows["borrowed_row_id"]


def test_scored_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sentence,sentiment_score\n"x, ""y""",0.5\nz,-0.5\nz,0.5\nNA,\n')
    (tmp_path / "b.csv").write_text("sentence,sentiment_score\nw,0.1\n")
    scored = readers.scored_sentences(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    usable, conflicted = readers.scored_rows(scored)
    assert sorted((r["text"], r["label"]) for r in usable.collect()) == [("nan", "neutral"), ("w", "neutral"), ('x, "y"', "positive")]
    assert [(r["text"], r["label"]) for r in conflicted.collect()] == [("z", "negative")]
    audit = conflicts.scored_audit(conflicts.resolve_scored(scored)).first()
    assert (audit[0], audit[1], audit[2]) == (4, 1, 0.25)


def test_span_json_and_lexicon_file(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"content": "A up.\nB", "annotations": [{"value": "A", "label": "Positive", "start": 0, "end": 1, "tag": "t"}]}, {"content": "C", "annotations": []}], indent=1))
    got = readers.span_documents(spark, str(tmp_path / "d.json")).collect()
    assert [(r["pos"], r["content"], len(r["annotations"])) for r in got] == [(0, "A up.\nB", 1), (1, "C", 0)]
    (tmp_path / "l.txt").write_text("# note\n\n[positive]\nImproving\ngain\n[other]\nx\n[negative]\nlosses\n")
    got = readers.lexicon(str(tmp_path / "l.txt"), "l")
    assert (got.positive, got.negative, got.evidence_grade) == ({"improv", "gain"}, {"loss"}, "reported")


def test_row_lines_refuse_odd_fields(spark, tmp_path):
    good = {n: "x" for n in model.REQUIRED}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n")
    assert readers.row_lines(spark, str(tmp_path / "a.jsonl")).first()["dup_group"] == ""
    for bad in ({**good, "extra": 1}, {k: v for k, v in good.items() if k != "text"}):
        (tmp_path / "b.jsonl").write_text(json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="unknown field extra|missing field text"):
            readers.row_lines(spark, str(tmp_path / "b.jsonl")).collect()


# -- harness, registry, settings ----------------------------------------------------------------


class Always:
    name, evidence_grade = "always", "reported"

    def __init__(self, label, short=False):
        self.label, self.short = label, short

    def predict(self, docs):
        out = docs.select("example_id", F.lit(self.label).alias("pred"))
        return out.orderBy("example_id").limit(docs.count() - 1) if self.short else out


@pytest.fixture(scope="module")
def frozen(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("frozen")
    manifest = writers.freeze(splits.cut(near_dup.apply(pool(spark, 60, agreement_tier="75")), 12, 6, seed=1), out)
    return out, manifest


def test_report(spark, frozen, tmp_path):
    out, manifest = frozen
    report = harness.score(spark, Always("neutral"), out / "dev.jsonl", manifest["hashes"]["dev"], bootstrap=50)
    assert report["n"] == 6 and report["split"] == "dev" and report["evidence_grade"] == "reported"
    assert sum(sum(r.values()) for r in report["confusion"].values()) == 6
    assert set(report["by_agreement_tier"]["cumulative"]) == {"50agree", "66agree", "75agree"}
    assert json.loads(store.text(harness.write_report(report, tmp_path))) == json.loads(json.dumps(report))
    gold = readers.row_lines(spark, str(out / "dev.jsonl"))
    report = harness.score(spark, Always("neutral"), out / "dev.jsonl", comparators={"gold": gold.select("example_id", F.col("label").alias("pred"))}, bootstrap=50)
    assert report["vs"]["gold"]["delta"] < 0


def test_guards(spark, frozen, tmp_path):
    out, _ = frozen
    with pytest.raises(AssertionError, match="has changed"):
        harness.score(spark, Always("neutral"), out / "dev.jsonl", "sha256:0")
    with pytest.raises(AssertionError, match="every row needs one"):
        harness.score(spark, Always("neutral", short=True), out / "dev.jsonl")
    writers.write_rows(pool(spark, 3, label_source="weak"), tmp_path / "weak.jsonl")
    with pytest.raises(AssertionError, match="no person gave"):
        harness.score(spark, Always("neutral"), tmp_path / "weak.jsonl", "sha256:0")
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no rows to score"):
        harness.score(spark, Always("neutral"), tmp_path / "none.jsonl")


def test_registry(spark, tmp_path):
    path = f"{tmp_path}/r/runs.jsonl"
    assert registry.runs(path) == [] and readers.run_lines(spark, path).columns == []
    for grade in ("supported", "reported"):
        run = registry.add(path, registry.begin("baseline", "a floor", {"seed": 1}, seed=1, evidence_grade=grade))
    assert [r["evidence_grade"] for r in registry.runs(path)] == ["supported", "reported"]
    assert readers.run_lines(spark, path).count() == 2
    assert run["run_id"].split("-")[1] == settings.config_hash({"seed": 1})[7:13] and run["finished_at"] >= run["started_at"]
    for wrong, match in (({"hypothesis": " "}, "hypothesis"), ({"evidence_grade": "sure"}, "grade"), ({"colour": 1}, "unknown")):
        with pytest.raises(ValueError, match=match):
            registry.add(path, run | wrong)
    assert len(registry.runs(path)) == 2


def test_commands(spark, tmp_path, capsys):
    """build-data, baselines, aspect-audit and registry over small files."""
    rng, names = random.Random(3), readers.POOL_FILES
    (tmp_path / "pool").mkdir()
    words = {"positive": "profit rose", "negative": "profit fell", "neutral": "the board met"}
    lines = [f"{words[y]} {rng.randrange(10**6)} in {rng.randrange(10**6)} at {rng.randrange(10**6)}@{y}" for y in rng.choices(sorted(words), k=120)]
    for k, name in enumerate(names.values()):
        (tmp_path / "pool" / name).write_text("\n".join(lines[k * 20 :]), encoding="latin-1")
    (tmp_path / "fiqa.csv").write_text("sentence,sentiment_score\nup,0.5\ndown,-0.5\ndown,0.6\n")
    (tmp_path / "henry.txt").write_text("# list\n[positive]\nrose\n[negative]\nfell\n")
    span = lambda c: {"content": c, "annotations": [{"value": "Ab", "label": "Positive", "start": 0, "end": 2}, {"value": "Cd", "label": "Negative", "start": 3, "end": 5}]}
    (tmp_path / "spans.json").write_text(json.dumps([span("Ab Cd"), span("Ab Cd ef")]))
    changes = [f"data.primary_path={tmp_path}/pool", f"data.secondary_paths={tmp_path}/fiqa.csv", f"data.out_dir={tmp_path}/out/pool", "data.n_test=20", "data.n_dev=10", f"lexicons.reported_path={tmp_path}/henry.txt"]
    changes += [f"runs.registry={tmp_path}/runs.jsonl", f"runs.reports={tmp_path}/reports", "eval.bootstrap=50", f"data.spans_path={tmp_path}/spans.json"]
    call = lambda name, *more: cli.main([name, *(x for c in [*changes, *more] for x in ("--set", c))])
    assert call("registry") == 0 and "no run" in capsys.readouterr().out
    assert call("build-data") == 0
    assert (tmp_path / "out" / "scored" / "conflicted.jsonl").read_text().count("\n") == 1
    assert call("baselines") == 0
    assert {r["notes"] for r in registry.runs(f"{tmp_path}/runs.jsonl")} >= {"system=lexicon-henry"} and len(registry.runs(f"{tmp_path}/runs.jsonl")) == 3
    assert call("registry") == 0 and "baseline" in capsys.readouterr().out
    assert call("aspect-audit") == 1 and call("aspect-audit", "gate.least_multi_label=2") == 0


def test_settings():
    one = settings.resolve()
    one["data"]["n_test"] = 5
    assert settings.resolve()["data"]["n_test"] == 1000
    assert settings.config_hash({"a": 1, "b": {"c": 2, "d": 3}}) == settings.config_hash({"b": {"d": 3, "c": 2}, "a": 1})
    base = settings.resolve()
    got = settings.override(base, ["a.b.c=1", "eval.alpha=0.1", "x=True", "y=plain word", "z=~", "l=[1, 2]", "e=a=b"])
    assert (got["a"]["b"]["c"], got["eval"]["alpha"], got["x"], got["y"], got["z"], got["l"], got["e"]) == (1, 0.1, True, "plain word", None, [1, 2], "a=b")
    assert base == settings.resolve() and settings.config_hash(got) != settings.config_hash(base)
    with pytest.raises(ValueError):
        settings.override(base, ["novalue"])


# -- TF-IDF -------------------------------------------------------------------------------------


def test_grams(spark):
    df = spark.createDataFrame([("The cat a sat_1 é!",)], "t string")
    assert df.select(tfidf.word_grams(F.col("t"))).first()[0] == ["the", "cat", "sat_1", "the cat", "cat sat_1"]
    got = spark.createDataFrame([(" Ab  x ",)], "t string").select(tfidf.char_grams(F.col("t"))).first()[0]
    assert got == [" ab", "ab ", " ab ", " x "]


@pytest.mark.parametrize("k, looked_up", [(3, 10_000), (12, 10_000), (12, 2), (500, 10_000)])
def test_top_terms_against_brute_force(spark, monkeypatch, k, looked_up):
    monkeypatch.setattr(tfidf, "LOOKED_UP", looked_up)
    rng = random.Random(2)
    rows = [(f"r{i % 70:02d}", " ".join(rng.choice(["an", "be", "cat", "do", "e", "fish"]) for _ in range(rng.randint(0, 9)))) for i in range(75)] + [("x", None)]
    terms = {}
    for i, t in rows:
        w = [x for x in (t or "").split() if len(x) > 1]
        for term in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            terms.setdefault(term, set()).add(i)
    want = sorted(((len(ids), t) for t, ids in terms.items() if len(ids) > 1), key=lambda x: (-x[0], x[1]))[:k]
    got = tfidf.top_terms(spark.createDataFrame(rows, "example_id string, text string"), k).collect()
    assert sorted(((r["df"], r["term"]) for r in got), key=lambda x: (-x[0], x[1])) == want
    assert all(abs(r["idf"] - math.log(77 / (1 + r["df"])) - 1) < 1e-12 for r in got)


def test_tfidf_learns_and_explains(spark):
    rng = random.Random(0)
    texts = {"positive": "profit rose strongly", "negative": "losses widened badly", "neutral": "the board met today"}
    rows = [(f"r{i:03d}", f"{texts[LABELS[i % 3]]} in {rng.choice(['may', 'june', 'july'])} {rng.randint(1, 30)}", LABELS[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "example_id string, text string, label string")
    with pytest.raises(RuntimeError):
        tfidf.TfidfSystem().predict(df)
    system = tfidf.TfidfSystem(max_iter=50).fit(df)
    new = spark.createDataFrame([("a", "profit rose"), ("b", "losses widened"), ("c", ""), ("d", "the board met")], "example_id string, text string")
    got = {r["example_id"]: r["pred"] for r in system.predict(new).collect()}
    assert (got["a"], got["b"], got["d"]) == ("positive", "negative", "neutral") and got["c"] in LABELS
    cells = tfidf.weights(tfidf.term_counts(df), system.vocabulary).groupBy("id").agg(F.collect_list(F.struct("at", "value")).alias("cells"))
    y = df.select(F.col("example_id").alias("id"), F.substring("example_id", 2, 3).cast("double").alias("y"))
    ml = system.model.transform(tfidf.vectors(y.join(cells, "id", "left"), system.vocabulary.count(), Scratch(spark, "test")))
    assert {f"r{int(r['y']):03d}": LABELS[int(r["prediction"])] for r in ml.collect()} == {r["example_id"]: r["pred"] for r in system.predict(df).collect()}
    top = system.top_features(5).collect()
    assert len(top) == 15 and any("profit" in r["term"] for r in top if r["label"] == "positive")
    w = tfidf.weights(tfidf.term_counts(df), system.vocabulary).groupBy("id", "block").agg(F.sum(F.col("value") ** 2).alias("s"))
    assert w.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
