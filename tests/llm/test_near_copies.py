import random

import numpy as np
import xxhash

from goldpan.llm import line_dedup, simhash, substrings

WS = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for ch in text + " ":
        if ch in WS:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def documents(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Éa", "ñu", "ΣΑΣ"]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    common = line(9)
    texts = []
    for _ in range(60):
        body = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body) + 1), common)
        texts.append("\n".join(body))
    for t in texts[:12]:  # near copies: a word changed
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = "\n".join(line(20) for _ in range(4))
    texts += [f"{line(5)}\n{passage}\n{line(5)}", f"{passage}\n{line(30)}"]
    texts += [texts[0], texts[0], "", None, None, "\n\n", " \t ", "ONE two three", "one TWO three", "a b", "x " * 30_000]
    rows = [(i, t, None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[2], (None, texts[4], 3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, s long")


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None]
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted((r[0], f"{prints[i]:016x}", least[find(i)]) for i, r in enumerate(rows))
    got = sorted(tuple(r)[:3] for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == want


def test_bit_slices_find_every_link(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4, 5) for _ in range(40)]
    f = np.unique(np.concatenate([base, np.tile(base, 6) ^ np.array(flips)]))
    want = {(i, j) for i in range(len(f)) for j in range(i) if bin(int(f[i] ^ f[j])).count("1") <= 3}
    root = simhash.forest(f, np.zeros(len(f), int), np.full(len(f), len(f)), 3)

    def joined(pairs):
        r = list(range(len(f)))
        for a, b in pairs:
            while r[a] != a:
                a = r[a]
            while r[b] != b:
                b = r[b]
            r[max(a, b)] = min(a, b)
        return [min_root(r, i) for i in range(len(f))]

    def min_root(r, i):
        while r[i] != i:
            i = r[i]
        return i

    assert root.tolist() == joined(want)
    nodes = spark.createDataFrame([(int(x.astype(np.int64)), int(x.astype(np.int64))) for x in f], "node long, f long")
    at = {int(x.astype(np.int64)): i for i, x in enumerate(f)}
    for agree in (1, 3):
        for chunk in (simhash.CHUNK, 8):  # buckets dealt in pairs of chunks too
            edges = {(at[r["a"]], at[r["b"]]) for r in simhash.links(nodes, 3, agree, chunk).collect()}
            assert joined(edges) == joined(want)


def test_one_document_of_each_group_stays(spark):
    rows = documents()
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "s"]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {c for c in found.values()}


def brute_lines(rows):
    """{(doc_id, text): removed line numbers}"""
    docs = sorted({(-1 if i is None else i, t) for i, t, _ in rows if t is not None}, key=lambda x: x[0])
    seen, out = [], {}
    for i, t in docs:
        gone = []
        for no, line in enumerate(t.split("\n")):
            s = set(words(line.lower()))
            if not s:
                continue
            if any(len(s & o) * 5 >= len(s | o) * 4 for o in seen):
                gone.append(no)
            seen.append(s)
        out[i] = gone
    return out


def test_line_dedup_against_brute_force(spark):
    rows = documents()
    want = {i: g for i, g in brute_lines(rows).items()}
    for crowd in (line_dedup.CROWD, 2):  # with the pairs of tokens and the hubs, too
        found = line_dedup.find_lines(frame(spark, rows), crowd=crowd).where("removed").collect()
        got = {i: [] for i in want}
        for r in found:
            got[-1 if r["o"] == line_dedup.FIRST else r["o"]].append(r["no"])
        # A row that repeats has its lines twice.
        assert {i: sorted(set(g)) for i, g in got.items()} == want


def test_line_dedup_query_with_repeated_rows(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    twice = frame(spark, rows + rows)
    twice.write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()
    want = brute_lines(rows)
    texts = {i: t for i, t, _ in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)  # rows that repeat are one document
    for r in got:
        text = texts[r["doc_id"]]
        assert r["n_lines"] == (0 if text is None else text.count("\n") + 1)
        assert r["removed"] == ",".join(map(str, want.get(r["doc_id"], []))) and r["n_removed"] == len(want.get(r["doc_id"], []))


def test_near_copies_of_a_hub_that_is_not_one(spark):
    """Every set is near the earliest by its signature bound, but some only to each other."""
    rng = random.Random(4)
    base = ["t%d" % i for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(40), rng.randint(3, 6)):
            w[k] = "x%d" % rng.randrange(30)
        rows.append((i, " ".join(w), 0))
    want = {i for i, g in brute_lines(rows).items() if g}
    for crowd in (line_dedup.CROWD, 4):
        found = line_dedup.find_lines(frame(spark, rows), crowd=crowd).where("removed").collect()
        assert {r["o"] for r in found} == want


def test_crowded_near_copies(spark):
    rng = random.Random(9)
    base = ["t%d" % i for i in range(30)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(30)] = "x%d" % rng.randrange(1000)
        rows.append((i, " ".join(w), 0))
    want = brute_lines(rows)
    found = line_dedup.find_lines(frame(spark, rows), crowd=8).where("removed").collect()
    assert {r["o"] for r in found} == {i for i, g in want.items() if g}


def test_line_dedup_counts_a_share_of_the_words(spark, monkeypatch):
    """The order of tokens is taken from a share of the texts, the last join reads the sets that matter, all lines are held against all."""
    rows = [r for r in documents() if len(r[1] or "") < 5000]
    real, cells = line_dedup.marks.byte_table, {}

    def byte_table(table, value, empty, bits, scratch, name):
        cells[name] = table.count()
        return real(table, value, empty, bits, scratch, name)

    monkeypatch.setattr(line_dedup.marks, "byte_table", byte_table)
    scratch = line_dedup.Scratch(spark, "line-dedup")
    lines, found = line_dedup.find_sets(frame(spark, rows), 80, "doc_id", "text", line_dedup.CROWD, scratch)
    assert 0 < cells["counts"] < sum(len(words(t or "")) for _, t, _ in rows) / 3
    sets = lines.where("s is not null").groupBy("s").count().collect()
    repeated, held = {r["s"] for r in sets if r["count"] > 1}, found.collect()
    assert {r["s"] for r in held} == repeated | {r["s"] for r in held if r["gone"]} and len(held) < len(sets)
    got = {i: set() for i in brute_lines(rows)}
    for r in line_dedup.find_lines(frame(spark, rows)).where("removed").collect():
        got[-1 if r["o"] == line_dedup.FIRST else r["o"]].add(r["no"])
    assert {i: sorted(g) for i, g in got.items()} == brute_lines(rows)


def test_deduped_texts_keep_columns(spark):
    rows = documents()
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "s"] and out.count() == len(rows)
    gone = brute_lines(rows)
    for r in out.collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        if text is None:
            assert r["text"] is None
        else:
            drop = gone[-1 if r["doc_id"] is None else r["doc_id"]]
            assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)


def plain_units(text):
    """(start, words) of the lines' sentences."""
    out, start = [], 0
    for i, ch in enumerate(text):
        last = i + 1 == len(text)
        if ch == "\n" or last or (ch in ".!?" and text[i + 1] in WS):
            piece = text[start : i + (ch != "\n")]
            if words(piece):
                lead = len(piece) - len(piece.lstrip(WS))
                out.append((start + lead, len(piece.strip(WS)), words(piece.lower())))
            start = i + 1
    return out


def brute_repeats(rows, least=30):
    seen, out = set(), set()
    for i, t in sorted({(i, t) for i, t, _ in rows if t is not None and i is not None}):
        run = []
        for k, (at, length, w) in enumerate([*plain_units(t), (None, None, None)]):
            if w is not None and " ".join(w) in seen:
                run.append((i, k, at, length, len(w)))
                continue
            if sum(r[4] for r in run) >= least:
                out |= set(run)
            run = []
            if w is not None:
                seen.add(" ".join(w))
    return out


def test_substrings_against_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None]
    found = substrings.find_repeats(frame(spark, rows)).collect()
    assert {(r["o"], r["unit"], r["start"], r["length"], r["words"]) for r in found} == brute_repeats(rows) and len(found) == len(brute_repeats(rows))
    texts = {i: t for i, t, _ in rows}
    for r in found:
        one = texts[r["o"]][r["start"] : r["start"] + r["length"]]
        keeper = next(u for u in plain_units(texts[r["keeper_id"]]) if u[0] == r["keeper_start"])
        assert words(one.lower()) == keeper[2]
    out = substrings.remove(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "s"] and out.count() == len(rows)
    gone = {}
    for r in found:
        gone.setdefault(r["o"], []).append((r["start"], r["length"]))
    for r in out.collect():
        t = texts[r["doc_id"]]
        for start, length in sorted(gone.get(r["doc_id"], []), reverse=True):
            t = t[:start] + t[start + length :]
        assert r["text"] == t


def test_passages_inside_lines(spark):
    rng = random.Random(6)

    def sentence(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)).capitalize() + "."

    passage = " ".join(sentence(n) for n in (9, 12, 7, 11, 8, 13))
    rows = [(k, f"{sentence(9)} {sentence(12)}", 0) for k in range(4)]
    rows += [(10, f"{sentence(8)} {passage}", 0), (11, f"{sentence(5)} {passage}", 0), (12, f"{sentence(4)[:-1]} {passage} {sentence(6)}\n{sentence(7)}", 0)]
    found = substrings.find_repeats(frame(spark, rows)).collect()
    taken = {}
    for r in found:
        taken[r["o"]] = taken.get(r["o"], 0) + r["words"]
    assert taken == {11: 60, 12: 51}  # in the middle of a sentence its first sentence can't be told
    left = {r["doc_id"]: r["text"].strip() for r in substrings.remove(frame(spark, rows)).collect()}
    assert left[11] == rows[5][1].replace(passage, "").strip() and left[0] == rows[0][1]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert line_dedup.find_lines(none).count() == 0
    assert substrings.find_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
