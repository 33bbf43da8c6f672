import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from goldpan.llm import language, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=8):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "th", "sh"], "es": ["ción", "os", "ar", "ñe"]}

    def line(lang):
        return " ".join("".join(rng.choice(parts[lang]) + rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 25)))

    rows = []
    for i in range(120):
        lang = rng.choice(sorted(parts))
        rows.append([i, "\n".join(line(lang) for _ in range(rng.randint(1, 5))), lang, rng.choice(["a", "a", "a", "b", "c", None])])
    rows += [[200, rows[3][1], "en", "b"], [201, rows[5][1] + "\n" + line("en"), "en", "c"], [202, None, "en", "a"], [203, "", "en", "a"], [204, "123 456", "en", "a"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's rows, as the one before it left them."""
    root = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{root}/sf/documents.parquet")
    docs = spark.read.parquet(f"{root}/sf/documents.parquet")
    out = [[tuple(r) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"{root}/sf").write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append([r if name == "packing" else tuple(r) for r in docs.collect()])
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out, f"{root}/sf"


def test_language_stage(staged, spark):
    before, after = staged[0][0], staged[0][1]
    gone = set(before) - set(after)
    assert {r[0] for r in gone} >= {202, 203, 204}
    model = language.fit(spark.createDataFrame(before, SCHEMA))
    for r in before:
        name, score = model.predict(r[1])
        assert (r in after) == (name != "und" and score >= 0.5)
    assert len(after) >= 0.97 * (len(before) - 3)


def test_line_stage(staged):
    before, after = staged[0][1], {r[0]: r for r in staged[0][2]}
    seen = []
    for r in sorted(before):
        keep = []
        for line in r[1].split("\n"):
            s = set(WORD.findall(line.lower()))
            if s and any(len(s & o) * 5 >= len(s | o) * 4 for o in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            keep.append(line)
        text = "\n".join(keep)
        assert after[r[0]] == (r[0], text, r[2], r[3], len(text))


def test_near_duplicate_stage(staged):
    before, after = staged[0][2], staged[0][3]
    prints = {r[0]: simhash.fingerprint(r[1]) for r in before}
    groups = {i: i for i in prints}

    def find(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                groups[b] = a
    assert sorted(after) == sorted(r for r in before if find(r[0]) == r[0])


def test_mixing_stage(staged):
    before, after = staged[0][3], Counter(staged[0][4])
    size = {r: len(WORD.findall(r[1])) for r in before}
    assert set(after) <= set(before) and max(after.values()) <= 3
    total = sum(size.values())
    taken = sum(size[r] * n for r, n in after.items())
    assert total - max(size.values()) <= taken <= total
    weights, per = {"a": 1, "b": 2, "c": 3, None: 1}, Counter()
    for r in before:
        per[r[3]] += size[r]
    for source, words in per.items():
        got = sum(size[r] * n for r, n in after.items() if r[3] == source)
        assert got <= 3 * words and abs(got - min(3 * words, total * weights[source] / 7)) < 0.35 * total


def test_packing_stage_and_run(staged, spark):
    (*_, mixed, packed), sf = staged
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in mixed)
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def staged_rows(spark, root, docs):
    docs.write.parquet(f"{root}/sf/documents.parquet")
    docs = spark.read.parquet(f"{root}/sf/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"{root}/sf").write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs.collect())
    return out


def test_stages_on_an_empty_table(spark, tmp_path):
    assert [len(x) for x in staged_rows(spark, tmp_path, spark.createDataFrame([], SCHEMA))] == [0] * 5


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    """Null ids and sources, rows that repeat, a very long text, columns named as the operators' own."""
    names = ["o", "h", "s", "t", "c", "f", "no", "node", "unit", "start", "_key", "copies", "length", "file", "row", "row_id", "size"]
    rows = [r for r in documents() if r[1]]
    long = " ".join(rows[k % 100][1] for k in range(3000))
    rows += [(None, rows[7][1] + " x1", "en", None, 3), (None, None, None, None, None), rows[9], rows[9], (900, long, "en", "a", len(long))]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} int" for n in names))
    *out, packed = staged_rows(spark, tmp_path, docs)
    for found in out:
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in found) and found
    assert all(any(r["doc_id"] == 900 for r in found) for found in out[:3])
    assert any(r["doc_id"] is None for r in out[2]) or not any(r["doc_id"] is None for r in out[1])
    assert sum(r["doc_id"] == rows[9][0] for r in out[0]) == 3  # rows that repeat stay, as one document in the line stage
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in out[3])
