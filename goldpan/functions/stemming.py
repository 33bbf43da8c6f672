"""Porter's suffix stripping (1980), with the usual extensions of its Python implementations.

The extensions: a table of irregular forms, words of one or two letters stay, ``ies`` and ``ied``
give ``ie`` after one letter, ``y`` becomes ``i`` only after a consonant that isn't the first
letter, and a few more endings. ``stems`` maps a vocabulary, each distinct word once.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Irregular forms of the extended algorithm, stem -> words.
IRREGULAR = {
    "sky": ["sky", "skies"], "die": ["dying"], "lie": ["lying"], "tie": ["tying"], "news": ["news"],
    "inning": ["innings", "inning"], "outing": ["outings", "outing"], "canning": ["cannings", "canning"],
    "howe": ["howe"], "proceed": ["proceed"], "exceed": ["exceed"], "succeed": ["succeed"],
}
FORMS = {word: stem for stem, words in IRREGULAR.items() for word in words}

#: The endings of steps 2, 3 and 4 and what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v or c for every letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return shape(stem).count("vc")


def has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or a vowel and a consonant alone."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or (len(word) == 2 and s == "vc")


def longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def plurals(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def past_forms(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    end = next((e for e in ("ed", "ing") if w.endswith(e) and has_vowel(w[: -len(e)])), None)
    if end is None:
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if doubled(w):
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if measure(w) == 1 and short_end(w) else w


def final_y(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c":
        return w[:-1] + "i"
    return w


def double_suffixes(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return double_suffixes(w[:-2])
    end = longest(w, STEP2)
    if end:
        return w[: -len(end)] + STEP2[end] if measure(w[: -len(end)]) > 0 else w
    # The letter before the ending counts for its measure.
    return w[:-1] if w.endswith("logi") and measure(w[:-3]) > 0 else w


def derivations(w: str) -> str:
    end = longest(w, STEP3)
    return w[: -len(end)] + STEP3[end] if end and measure(w[: -len(end)]) > 0 else w


def residues(w: str) -> str:
    end = longest(w, STEP4)
    if not end:
        return w
    stem = w[: -len(end)]
    if measure(stem) <= 1 or (end == "ion" and not stem.endswith(("s", "t"))):
        return w
    return stem


def final_e(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not short_end(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    word = word.lower()
    if word in FORMS:
        return FORMS[word]
    if len(word) <= 2:
        return word
    for step in (plurals, past_forms, final_y, double_suffixes, derivations, residues, final_e):
        word = step(word)
    return word


def identity(word: str) -> str:
    return word


def stems(vocabulary: DataFrame, stemmer=stem, col: str = "word") -> DataFrame:
    """(word) -> (word, stem), by a vectorised function on distinct words."""
    if stemmer is identity:
        return vocabulary.select(col).distinct().withColumn("stem", F.col(col))

    @F.pandas_udf("string")
    def mapped(words: pd.Series) -> pd.Series:
        return words.map(stemmer)

    return vocabulary.select(col).distinct().withColumn("stem", mapped(col))
