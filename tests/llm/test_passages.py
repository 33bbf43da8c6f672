import random
import re

import pytest

from goldpan.llm import passages, substrings


def spans(text):
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def brute(rows, least):
    """(doc_id, start, length, words) of the passages, window by window."""
    seen, out = set(), set()
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        at = spans(t)
        words = [t[a:b].lower() for a, b in at]
        covered = [False] * len(words)
        joined = [False] * (len(words) + 1)  # before a word: does a passage go on?
        for k in range(len(words) - least + 1):
            window = tuple(words[k : k + least])
            if window in seen:
                for j in range(k, k + least):
                    covered[j] = True
            seen.add(window)
        k = 0
        while k < len(words):
            if covered[k]:
                end = k
                while end < len(words) and covered[end]:
                    end += 1
                out.add((i, at[k][0], at[end - 1][1] - at[k][0], end - k))
                k = end
            else:
                k += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")


def found(spark, rows, least):
    return sorted((r["o"] is not None, r["o"] or 0, r["start"], r["length"], r["words"]) for r in passages.find_passages(frame(spark, rows), least).collect())


def told(out):
    return sorted((i is not None, i or 0, *rest) for i, *rest in out)


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    text = lambda k: [word() for _ in range(k)]
    pool = [text(rng.randint(15, 90)) for _ in range(6)] + [["la"] * 70, ["na", "nu", "ni"] * 25]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            out += text(rng.randint(0, 20))
            part = rng.choice(pool)
            low = rng.randint(0, len(part) // 3)
            out += part[low : len(part) - rng.randint(0, len(part) // 3)]
        rows.append((i, "".join(w.upper() + "\n" if rng.random() < 0.1 else w + rng.choice([" ", "  ", ". "[1:]]) for w in out)))
    return [*rows, (100, rows[3][1]), (101, rows[3][1]), rows[5], (102, None), (103, ""), (None, rows[7][1]), (104, "la " * 400)]


@pytest.mark.parametrize("least", [17, 20, 51])
def test_passages_against_brute_force(spark, least):
    for seed in range(2):
        rows = made(seed)
        want = told(brute(rows, least))
        assert len(want) > 10 and found(spark, rows, least) == want


def test_a_passage_in_the_middle_of_sentences(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = f"{text(25)}. {text(8)}. {text(27)}"  # whole sentences in it: 8 words
    rows = [(1, f"{text(9)} {passage} {text(4)}."), (2, f"{text(30)}. {text(3)} {passage} {text(9)}.\n{text(60)}"), (3, text(80))]
    assert substrings.find_repeats(frame(spark, rows)).count() == 0
    assert found(spark, rows, 51) == [(True, 2, rows[1][1].index(passage), len(passage), 60)]


def test_none(spark):
    assert passages.find_passages(frame(spark, [])).count() == 0
    assert passages.find_passages(frame(spark, [(1, "a b"), (2, "a b")])).count() == 0
