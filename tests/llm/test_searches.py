import numpy as np
import pytest
from pyspark.sql import functions as F

from goldpan.llm import ann, topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, score string")


def made(n=400, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    x = (centres[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], "a", "b") for i in range(n)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None, 1.0], [float("inf"), 1.0]]
    rows += [(n + k, v, None, None) for k, v in enumerate(odd)] + [(None, rows[0][1], None, None)]
    rows += [(n + 50 + k, rows[3][1], None, None) for k in range(9)] + [rows[5]]  # copies, and a repeated row
    return rows


def valid(rows):
    ok = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    return [i for i, _ in ok], np.array([[*v, *[0.0] * (24 - len(v))] for _, v in ok])


def brute_cosine(rows, step, k):
    ids, x = valid(rows)
    keep = [j for j in range(len(ids)) if x[j].any()]
    out = {}
    for j in keep:
        if ids[j] % step:
            continue
        best = {}
        for m in keep:
            if ids[m] != ids[j]:
                c = float((x[j] @ x[m]) / np.sqrt((x[j] @ x[j]) * (x[m] @ x[m])))
                best[ids[m]] = max(best.get(ids[m], -2), round(c, 12))
        out[ids[j]] = sorted(best, key=lambda i: (-best[i], i))[:k]
    return out


def brute_integer(rows, step, k):
    ids, x = valid(rows)
    x = np.floor(1024 * x).astype(int).tolist()
    out = {}
    for i, v in zip(ids, x):
        if i % step == 0:
            best = {}
            for j, w in zip(ids, x):
                if i != j:
                    best[j] = max(best.get(j, -(10**12)), sum(a * b for a, b in zip(v, w)))
            out[i] = [(j, best[j]) for j in sorted(best, key=lambda j: (-best[j], j))[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    rows = made()
    found = ann.neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    want = brute_cosine(rows, 10, 5)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_all_probes_are_exact(spark):
    rows = made()
    found = ann.neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, probes=1 << 20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_cosine(rows, 10, 5)


@pytest.mark.parametrize("probes", [None, 1 << 20])
def test_repeated_ids_take_one_place(spark, probes):
    rows = made(120)
    rows += [rows[7]] * 12 + [rows[20]] * 8  # one id, one vector; rows[20] is a query too
    rows += [(33, [c + 0.001 * j for c in rows[10][1]], None, None) for j in range(9)]  # one id, vectors nearly alike
    rows += [(900 + j, rows[7][1], None, None) for j in range(3)]
    found = ann.neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, probes=probes).collect()
    want, got = brute_cosine(rows, 10, 5), {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(set(v)) == 5 for v in got.values()) and set(got) == set(want)
    assert got == want if probes else sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_a_task_keeps_k_distinct_ids():
    x = np.array([[1.0, 0.1]] * 8 + [[1.0, 0.2], [1.0, 0.3], [1.0, 0.11], [1.0, 0.12]])
    ids = np.array([3] * 8 + [4, 5, 3, 3])
    near = ann.Nearest(np.array([1]), np.array([[1.0, 0.0]]), None, 3)
    for low in range(0, 12, 5):
        near.add(ids[low : low + 5], ann.unit_rows(x[low : low + 5]), np.zeros((len(x[low : low + 5]), 1), int))
    cosine, found = near.best[0]
    assert found.tolist() == [3, 4, 5] and abs(cosine[0] - 1 / np.hypot(1, 0.1)) < 1e-12


def test_candidates_are_the_probed_buckets():
    h, rng = ann.Hashes(24, 4), np.random.default_rng(1)
    unit, x = ann.unit_rows(rng.standard_normal((70, 24))), ann.unit_rows(rng.standard_normal((500, 24)))
    probed = np.stack([h.probes(unit, t, 40) for t in range(4)], axis=1)
    codes = np.stack([h.bucket(x, t) for t in range(4)], axis=1)
    found = ann.Nearest(np.arange(70), unit, ann.bit_table(probed, h.buckets), 5).candidates(codes)
    want = (probed[:, None, :, :] == codes[None, :, :, None]).any(axis=(2, 3))
    assert (found == want).all() and 0 < want.mean() < 0.5


def test_blocks_of_queries(spark, monkeypatch):
    rows = made()
    whole = ann.neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, probes=30).collect()
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "ROWS", 50)
    small = ann.neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, probes=30).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, small)) and whole


def test_few_or_no_vectors(spark):
    rows = [(0, [1.0, 2.0], "", ""), (50, [1.0, 2.0], "", ""), (7, [-1.0, 0.5], "", "")]
    found = ann.neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 50), (0, 7), (50, 0), (50, 7)]
    assert ann.neighbours(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, 10).count() == 4


@pytest.mark.parametrize("small", [False, True])
def test_top_k_is_exact(spark, small, monkeypatch):
    if small:  # several blocks of queries and looks at the bounds
        for name, n in (("QUERIES", 8), ("ROWS", 16), ("FIRST", 3), ("STEP", 4), ("SAMPLE", 30)):
            monkeypatch.setattr(topk, name, n)
    rows = made()
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 10, n_pivots=16 if small else topk.PIVOTS).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_integer(rows, 20, 10)


def test_bounds_hold_and_stop_early():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (12, 3))
    x = centres[rng.integers(0, 12, 3000)] + rng.integers(-5, 5, (3000, 3))
    q = x[:20]
    pivots = topk.Pivots(x[:500], 12)
    bound = topk.upper_bounds(q, pivots.table(q), x, pivots.table(x), pivots.width)
    true = q @ x.T
    assert (bound >= true).all()
    ids, none = np.arange(3000), np.full(20, np.iinfo(np.int64).min)
    *found, first = topk.top_in_batch(ids[:20], q, ids, x, bound, none, 5, 32)
    kth = np.array([np.sort(found[2][found[0] == i])[-5] for i in range(20)])
    *found, scored = topk.top_in_batch(ids[:20], q, ids, x, bound, kth, 5)
    true[np.arange(20), np.arange(20)] = np.iinfo(np.int64).min
    for i in range(20):
        assert sorted(found[2][found[0] == i])[-5:] == sorted(true[i])[-5:]
    assert first <= 20 * 32 and scored < 0.3 * 20 * 3000  # in clusters the pivots settle most


def test_scores_beyond_doubles_are_exact_or_an_error():
    a = np.array([[1 << 30, 3]])
    assert topk.inner(a, a)[0, 0] == (1 << 60) + 9
    with pytest.raises(OverflowError):
        topk.inner(a * 8, a * 8)


def test_rotation_keeps_lengths():
    x = ann.unit_rows(np.random.default_rng(0).standard_normal((50, 24)))
    y = ann.Hashes(24).rotated(x, 0, 0)
    assert np.allclose(y @ y.T, x @ x.T)
