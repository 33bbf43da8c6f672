r"""Licence scan with a trained paragraph classifier.

Paragraphs are lines with a word ``\w+``. A line's features are its word n-grams, one to three
words, lower-cased, as far as the training texts have them (single stop words aside), each taken
once and the vector scaled to length 1. Multinomial logistic regression tells the licence families
(``licence_texts``), ``unknown`` (licence wording that several families share) and ``none``.
Lines in a row that aren't ``none`` are one paragraph, so a wrapped text is judged as a whole. It ends
at a blank line, and before a line that alone is surely of another family than a line before it: at
the bar or above, confirmed, and nearer to its family's templates than to any other's.

Training, in numpy: sentences of the templates, whole, in runs of two or three and in windows as
wrapped lines have them, with words dropped or replaced; against them sentences of like words,
the training words in random order, and up to ``sample`` lines of the corpus, those with the least hashes, of longer ones a run of
``span`` words (documented bounds of the training rows alone; a line that a template covers is left out). A fifth is held out to calibrate: a temperature by likelihood, then
the least probability ``bar`` at which 98 % of the held-out paragraphs that pass are right. What
is below the bar, or isn't confirmed, is reported as ``unknown``.

Confirmation: the share of the paragraph's word pairs that the family's templates have, or the
share of some template's pairs that the paragraph has, is 0.6 or more. Where this is under 0.25 for
all families and the shared wording, nothing is reported. A confirmed paragraph may name more families:
each counts that has a template of whose word pairs, without those of the families already found, the
paragraph has 0.6 and two at least. Each has a row, and their probabilities together meet the bar.

Edges: a null or empty text has no paragraph. Rows that repeat are reported as often. Ids may be
null. Very long lines are classified whole. An empty table gives no rows; the model is then trained
on the templates alone. Other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm.licence_texts import OTHERS, SHARED, TEMPLATES

WORD = re.compile(r"\w+")
STOP = frozenset("a an and any as at be by for from has have if in is it may no not of on or that the this to was which will with you your".split())
STOPS = sorted(STOP)
UNKNOWN, NONE = "unknown", "none"
CLASSES = [*TEMPLATES, UNKNOWN, NONE]
OVERLAP, LEAST = 0.6, 0.25


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:])) or {(w, "") for w in words}


class Templates:
    """Word pairs of each family's sentences."""

    def __init__(self, templates: dict[str, list[str]]):
        self.single = {f: [pairs_of(words_of(t)) for t in texts] for f, texts in templates.items()}
        self.all = {f: set().union(*sets) for f, sets in self.single.items()}

    def overlap(self, words: list[str], family: str) -> float:
        own = pairs_of(words)
        if not own or family not in self.all:
            return 0.0
        inside = len(own & self.all[family]) / len(own)
        return max(inside, *(len(own & t) / len(t) for t in self.single[family]))

    def surely(self, words: list[str], family: str) -> bool:
        """Confirmed, and nearer than any other family."""
        own = self.overlap(words, family)
        return own >= OVERLAP and all(self.overlap(words, f) < own for f in self.all if f != family)

    def others(self, words: list[str], family: str) -> list[str]:
        """The families besides a confirmed one that the words not explained by it confirm, the nearest first."""
        found, known = [], set(self.all[family])
        while True:
            left, best = pairs_of(words) - known, (0.0, "")
            for f in self.single:
                if f in (family, UNKNOWN, *found):
                    continue
                for t in self.single[f]:
                    both = len(left & t)
                    if both > 1 and (share := both / len(t - known)) >= OVERLAP:
                        best = max(best, (share, f))
            if not best[1]:
                return found
            found.append(best[1])
            known |= self.all[best[1]]


class Features:
    """n-grams of one to three words as columns; unseen ones are left out."""

    def __init__(self, texts: list[list[str]]):
        self.word = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.size = len(self.word) + 1
        self.single = np.array([False, *(w not in STOP for w in self.word)])
        ids = [np.array([self.word[w] for w in t], np.int64) for t in texts]
        self.keys = np.unique(np.concatenate([k for x in ids for _, k in self.grams(np.concatenate([x, [0]]))]))

    def grams(self, row: np.ndarray):
        """(places, keys) of the n-grams in a row of word numbers; 0 parts texts."""
        at = np.flatnonzero(self.single[row])
        yield at, row[at]
        two = np.flatnonzero((row[:-1] > 0) & (row[1:] > 0))
        yield two, row[two] * self.size + row[two + 1] + self.size
        three = two[row[np.minimum(two + 2, len(row) - 1)] > 0]
        three = three[three + 2 < len(row)]
        yield three, (row[three] * self.size + row[three + 1]) * self.size + row[three + 2] + self.size * (self.size + 1)

    def numbers(self, words: list[str]) -> list[int]:
        get = self.word.get
        return [get(w, 0) for w in words]

    def rows(self, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, column, value) of the matrix of some texts of word numbers."""
        sizes = np.array([len(t) + 1 for t in texts])
        row = np.fromiter((x for t in texts for x in (*t, 0)), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(texts)), sizes)
        found = list(self.grams(row))
        at, keys = np.concatenate([a for a, _ in found]), np.concatenate([k for _, k in found])
        col = np.searchsorted(self.keys, keys)
        known = (col < len(self.keys)) & (self.keys[np.minimum(col, len(self.keys) - 1)] == keys)
        cell = np.unique(owner[at[known]] * len(self.keys) + col[known])
        text, col = cell // len(self.keys), cell % len(self.keys)
        n = np.bincount(text, minlength=len(texts))
        return text, col, 1 / np.sqrt(n[text])


class Classifier:
    """Weights, temperature and bar; ``none`` has weight 0 on an empty row."""

    def __init__(self, features: Features, classes: list[str]):
        self.features, self.classes = features, classes
        self.w = np.zeros((len(features.keys), len(classes)))
        self.b = np.zeros(len(classes))
        self.heat, self.bar = 1.0, 0.5

    def logits(self, texts: list[list[int]]) -> np.ndarray:
        text, col, value = self.features.rows(texts)
        z = np.tile(self.b, (len(texts), 1))
        if len(text):
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            z[text[first]] += np.add.reduceat(self.w[col] * value[:, None], first)
        return z

    def probabilities(self, texts: list[list[int]]) -> np.ndarray:
        return softmax(self.logits(texts) / self.heat)

    def fit(self, texts: list[list[int]], y: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-5) -> None:
        """Full-batch Adagrad on the log loss, classes weighted alike."""
        text, col, value = self.features.rows(texts)
        weight = 1 / np.bincount(y, minlength=len(self.classes)).clip(1)[y]
        weight /= weight.sum()
        gw, gb = np.full_like(self.w, 1e-8), np.full_like(self.b, 1e-8)
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        order = np.argsort(col, kind="stable")
        starts = np.flatnonzero(np.r_[True, col[order][1:] != col[order][:-1]])
        for _ in range(steps):
            z = np.tile(self.b, (len(texts), 1))
            z[text[first]] += np.add.reduceat(self.w[col] * value[:, None], first)
            p = softmax(z)
            p[np.arange(len(y)), y] -= 1
            p *= weight[:, None]
            g = decay * self.w
            g[col[order][starts]] += np.add.reduceat(p[text[order]] * value[order, None], starts)
            gw += g * g
            gb += p.sum(0) ** 2
            self.w -= rate * g / np.sqrt(gw)
            self.b -= rate * p.sum(0) / np.sqrt(gb)

    def calibrate(self, texts: list[list[int]], y: np.ndarray, right: float = 0.98) -> None:
        z = self.logits(texts)
        heats = np.geomspace(0.1, 10, 41)
        self.heat = float(heats[np.argmin([-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-300).mean() for t in heats])])
        p = softmax(z / self.heat)[:, :-2]
        best, hit = p.max(1), p.argmax(1) == y
        for bar in np.linspace(0.3, 0.95, 66):
            passed = best >= bar
            if not passed.any() or hit[passed].mean() >= right:
                self.bar = float(bar)
                return
        self.bar = 0.95


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def examples(lines: list[str], seed: int = 11, copies: int = 24) -> tuple[list[list[str]], list[int]]:
    """Training paragraphs as words, and their classes. lines: of the corpus, all ``none``."""
    rng = np.random.default_rng(seed)
    filler = [w for line in lines for w in words_of(line)] or words_of(" ".join(OTHERS))

    def varied(words: list[str]) -> list[str]:
        out = [w for w in words if rng.random() > 0.06] or words
        return [filler[rng.integers(len(filler))] if rng.random() < 0.03 else w for w in out]

    texts, y = [], []
    groups = {**TEMPLATES, UNKNOWN: SHARED, NONE: OTHERS}
    for k, family in enumerate(CLASSES):
        sentences = [words_of(t) for t in groups[family]]
        for s, words in enumerate(sentences):
            texts += [words] * 4
            y += [k] * 4
            for _ in range(copies // (2 if family == NONE else 1)):
                run = list(words)
                if rng.random() < 0.3 and family != NONE:
                    run = [w for t in sentences[s : s + int(rng.integers(2, 4))] for w in t]
                if len(run) > 14 and rng.random() < 0.4:
                    low = int(rng.integers(0, len(run) - 10))
                    run = run[low : low + int(rng.integers(8, 15))]
                texts.append(varied(run))
                y.append(k)
    known = sorted({w for group in groups.values() for t in group for w in words_of(t)} | STOP)
    for n in rng.integers(2, 30, 400):
        texts.append([known[i] for i in rng.integers(0, len(known), n)])
        y.append(len(CLASSES) - 1)
        texts.append([STOPS[i] for i in rng.integers(0, len(STOPS), n)])
        y.append(len(CLASSES) - 1)
    templates = Templates({"all": [t for texts in TEMPLATES.values() for t in texts] + SHARED})
    for line in lines:
        words = words_of(line)
        if words and templates.overlap(words, "all") < 0.5:
            texts.append(words)
            y.append(len(CLASSES) - 1)
    return texts, y


def train(lines: list[str]) -> Classifier:
    """lines: of the corpus. The features are those of the template sentences and the like."""
    texts, y = examples(lines)
    own = [words_of(t) for group in (*TEMPLATES.values(), SHARED, OTHERS) for t in group]
    model = Classifier(Features(own), CLASSES)
    rows = [model.features.numbers(t) for t in texts]
    held = np.random.default_rng(3).random(len(rows)) < 0.2
    y = np.array(y)
    fit, check = np.flatnonzero(~held), np.flatnonzero(held)
    model.fit([rows[i] for i in fit], y[fit])
    model.calibrate([rows[i] for i in check], y[check])
    return model


def paragraphs(text: str, model: Classifier) -> list[tuple[int, int, list[int]]]:
    """(start, length, word numbers) of the lines that hold any feature's words."""
    out, start = [], 0
    for line in text.split("\n"):
        row = model.features.numbers(words_of(line))
        if any(row):
            out.append((start, len(line), row))
        start += len(line) + 1
    return out


def scan_texts(texts: list[str | None], model: Classifier, templates: Templates) -> list[list[tuple]]:
    """Of each text the paragraphs found: (start, length, licence, family, probability, overlap, confirmed)."""
    lines = [(i, *p) for i, t in enumerate(texts) for p in (paragraphs(t, model) if t else [])]
    out: list[list[tuple]] = [[] for _ in texts]
    if not lines:
        return out
    p = model.probabilities([row for *_, row in lines])
    runs: list[list] = []
    for (i, start, length, row), q in zip(lines, p):
        if q[-1] < 0.5:
            last, best = runs[-1] if runs else None, int(np.argmax(q[:-2]))
            sure = q[best] >= model.bar and templates.surely(words_of(texts[i][start : start + length]), CLASSES[best])
            family = CLASSES[best] if sure else None
            between = texts[i][last[2] : start] if last and last[0] == i else None
            # One line feed and nothing else but white space may lie between two lines of a paragraph.
            if between is not None and not between.strip() and between.count("\n") == 1 and (not family or last[4] in (None, family)):
                last[2:] = start + length, [*last[3], *row], last[4] or family
            else:
                runs.append([i, start, start + length, row, family])
    if not runs:
        return out
    for (i, start, end, *_), q in zip(runs, model.probabilities([r[3] for r in runs])):
        best = int(np.argmax(q[:-2]))
        family, words = CLASSES[best], words_of(texts[i][start:end])
        overlap = templates.overlap(words, family)
        confirmed = overlap >= OVERLAP
        like = overlap if confirmed else max(overlap, *(templates.overlap(words, f) for f in templates.all))
        if like < (OVERLAP if q[-1] >= 0.5 else LEAST):
            continue
        families = [family, *(templates.others(words, family) if confirmed else [])]
        sure = confirmed and sum(q[CLASSES.index(f)] for f in families) >= model.bar
        for f in families:
            out[i].append((start, end - start, f if sure else UNKNOWN, f, float(q[CLASSES.index(f)]), templates.overlap(words, f), confirmed))
    return out


FOUND = "start long, length long, licence string, family string, probability double, overlap double, confirmed boolean"


def scan(docs: DataFrame, sample: int = 2000, span: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each family of each paragraph found: doc_id, start, length, licence, family, probability, overlap, confirmed."""
    spark = docs.sparkSession
    # One line of each of the sampled texts, or a run of ``span`` words of it; which ones, only hashes tell.
    heads = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("k"), F.col(text_col).alias("t"))
    last = heads.select("k").distinct().orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    pick, words = F.split("t", "\n"), F.split("line", " ")
    heads = heads.where(F.col("k") <= F.lit(last)).select("k", F.element_at(pick, (F.pmod("k", F.size(pick)) + 1).cast("int")).alias("line"))
    begin = F.pmod(F.xxhash64("k"), F.greatest(F.size(words) - span, F.lit(0)) + 1).cast("int") + 1
    heads = heads.select("k", F.array_join(F.slice(words, begin, F.lit(span)), " ").alias("line"))
    lines = [r["line"] for r in heads.groupBy("k").agg(F.min("line").alias("line")).orderBy("k").collect()]
    shared = spark.sparkContext.broadcast((train(lines), Templates({**TEMPLATES, UNKNOWN: SHARED})))  # the templates set its size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model, templates = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = scan_texts(part.column(1).to_pylist(), model, templates)
                rows = [r for x in found for r in x]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
                columns = zip(*rows) if rows else [[]] * len(types)
                names = ["doc_id", "start", "length", "licence", "family", "probability", "overlap", "confirmed"]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {FOUND}")


def op3_licences(spark, sf_dir: str) -> DataFrame:
    """Every licence paragraph of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
