r"""Language ID by word-first backoff.

A word (a run of letters, lower-cased) that the model knows adds its log frequency in every
language. An unknown word falls back to its character n-grams, five letters first, with ``^`` and
``$`` at its ends: the first order of which any n-gram is known adds the mean of their log
frequencies; a word of which not even a letter is known adds nothing. The sum decides. The score is
the softmax of the mean per word, taken ``SHARP`` times (fewer for shorter texts): 0 to 1.

Training rows are the labelled rows outside the held-out fold, at most about ``per_lang`` of each
language, drawn by a hash of the id; that bound is a parameter, and all words of those rows count.
The model keeps the ``top`` most frequent words of each language and as many n-grams of each order,
each with its counts in all languages, so what is sent to the executors doesn't grow with the input. Language, source and id are never
inputs of a prediction.

Edges: a null text or one without a letter is ``und`` with score 0. If no known word or letter
occurs, all languages score alike and the first by code point is returned. Without training rows
all is ``und``. Null languages aren't learned. A null id counts as the empty text for the fold.
Rows that repeat are predicted alike. An empty table gives no rows. Other columns are kept by
``reject`` whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
SHARP = 20
#: Counts that a task holds before it sends them on; words whose scores a task keeps.
FLUSH, CACHE = 200_000, 100_000


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether the row is in fold 0 of crc32(id as text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def grams(word: str, n: int) -> list[str]:
    word = f"^{word}$" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Log frequencies of words and n-grams, a row for each and a column for each language."""

    def __init__(self, langs: list[str], rows: Iterable[tuple[int, str, str, int]]):
        """rows: (order, gram, lang, count); order 0 is words."""
        self.langs = langs
        lang_at = {lang: i for i, lang in enumerate(langs)}
        self.at: list[dict[str, int]] = [{} for _ in range(max(ORDERS) + 1)]
        cells: list[list[tuple[int, int, int]]] = [[] for _ in self.at]
        for order, gram, lang, n in rows:
            known = self.at[order]
            cells[order].append((known.setdefault(gram, len(known)), lang_at[lang], n))
        self.scores = []
        for known, found in zip(self.at, cells):
            counts = np.zeros((len(known), len(langs)))
            row, col, n = np.array(found, dtype=np.int64).reshape(-1, 3).T
            np.add.at(counts, (row, col), n)
            self.scores.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(known))))

    def known(self, order: int, gram: str) -> np.ndarray | None:
        at = self.at[order].get(gram)
        return None if at is None else self.scores[order][at]

    def word(self, word: str) -> np.ndarray | None:
        """The word's score in every language, None if nothing of it is known."""
        known = self.known(0, word)
        if known is not None:
            return known
        for n in ORDERS:
            found = [s for g in grams(word, n) if (s := self.known(n, g)) is not None]
            if found:
                return np.mean(found, axis=0)
        return None

    def decide(self, total: np.ndarray, n: int) -> tuple[str, float]:
        """Language and score from a sum of scores over n words."""
        mean = total / max(n, 1) * min(max(n, 1), SHARP)
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(mean))
        return self.langs[best], float(odds[best] / odds.sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """The plain way, word by word."""
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        found = [s for w in words if (s := self.word(w)) is not None]
        return self.decide(np.sum(found, axis=0) if found else np.zeros(len(self.langs)), len(found))


class Cached:
    """A model whose words' scores are rows of one matrix; the words met last are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows = np.zeros((CACHE + 1, len(self.model.langs)))
        self.at = {}

    def row(self, word: str) -> int:
        k = len(self.at) + 1
        score = self.model.word(word)
        if score is None:
            return 0
        self.rows[k] = score
        self.at[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return "und", 0.0
        total, n = np.zeros(len(self.model.langs)), 0
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            if len(self.at) + len(part) > CACHE:
                self.clear()
            get, row = self.at.get, self.row
            ids = np.array([get(w) or row(w) for w in part])
            ids = ids[ids > 0]
            total += self.rows[ids].sum(axis=0)
            n += len(ids)
        return self.model.decide(total, n)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, order, gram, n)."""

    def run(batches):
        words: dict[str, Counter] = {}

        def told(lang: str, order: int, seen: Counter):
            pairs = iter(seen.items())
            while part := list(itertools.islice(pairs, 50_000)):
                grams_of, n = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([order] * len(n), pa.int32()), pa.array(grams_of, pa.string()), pa.array(n, pa.int64())], names=["lang", "order", "gram", "n"])

        def sums():
            for lang in list(words):
                seen = words.pop(lang)
                yield from told(lang, 0, seen)
                for order in ORDERS:  # one order at a time is held
                    inside: Counter = Counter()
                    for w, n in seen.items():
                        for g in grams(w, order):
                            inside[g] += n
                    yield from told(lang, order, inside)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words.setdefault(lang, Counter()).update(LETTERS.findall((text.as_py() or "").lower()))
                if sum(map(len, words.values())) > FLUSH:
                    yield from sums()
        yield from sums()

    return labelled.mapInArrow(run, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_lang: int = 5000, top: int = 30_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [])
    # The share drawn of each language, in millionths.
    share = F.lit(1_000_000)
    for lang, n in sizes.items():
        if n > per_lang:
            share = F.when(F.col("lang") == lang, math.ceil(per_lang / n * 1_000_000)).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < share).select("lang", "text")
    best = Window.partitionBy("lang", "order").orderBy(F.col("n").desc(), "gram")
    ranked = count_grams(drawn).withColumn("_r", F.row_number().over(best))
    # A gram that any language keeps keeps its counts in all of them.
    rows = ranked.withColumn("_r", F.min("_r").over(Window.partitionBy("order", "gram"))).where(F.col("_r") <= top).select("order", "gram", "lang", "n").toArrow()
    # Small parts of the table at a time are Python objects.
    parts = (zip(*(c.to_pylist() for c in batch.columns)) for batch in rows.to_batches(max_chunksize=10_000))
    return Model(sorted(sizes, key=lambda s: s.encode()), itertools.chain.from_iterable(parts))


def predict(docs: DataFrame, model: Model, text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """The columns ``extra`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most top rows for each language and order
    given = docs.select(*extra, F.col(text_col).alias("_goldpan_text"))
    schema = given.drop("_goldpan_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        cached = Cached(shared.value)
        for batch in batches:
            *keep, texts = batch.columns
            found = [cached.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names)

    return given.mapInArrow(run, schema)


def reject(docs: DataFrame, least: float = 0.5, langs: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is told, with a score of ``least`` or more, and is one of langs."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        cached = Cached(shared.value)
        for batch in batches:
            found = [cached.predict(t.as_py()) for t in batch.column(at)]
            good = [p != "und" and s >= least and (langs is None or p in langs) for p, s in found]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs), extra=(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")))
