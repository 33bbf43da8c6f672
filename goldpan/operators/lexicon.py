"""Word-list scoring: positive hits less negative hits, turned round after a negator.

A word list is two sets of stems. Which words of the corpus have those stems is found once, over
the distinct vocabulary; these words become a hash set in the expression that scores a text, so
scoring has no shuffle and no join. A word in both lists is positive. A hit counts the other way if
any of the three words before it is a negator. A null text scores 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.functions import stemming
from goldpan.functions.text import list_words

#: Fixed values.
NEGATORS = ("not", "no", "never", "none", "cannot", "without", "nor", "neither", "hardly", "barely")
WINDOW = 3


@dataclass(frozen=True)
class Lexicon:
    name: str
    positive: frozenset[str]
    negative: frozenset[str]
    source: str = ""
    evidence_grade: str = "supported"


@dataclass(frozen=True)
class Matcher:
    """The surface words of a list."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(list_words(F.col(text_col))).alias("word")).distinct()


def matcher(lexicon: Lexicon, docs: DataFrame, text_col: str = "text", stemmer=stemming.stem) -> Matcher:
    """The words of docs that the list hits. They are inflections of its stems, so a list bounds them."""
    wanted = sorted(lexicon.positive | lexicon.negative)
    if stemmer is stemming.identity:
        return Matcher(tuple(sorted(lexicon.positive)), tuple(sorted(lexicon.negative - lexicon.positive)))
    found = stemming.stems(vocabulary(docs, text_col), stemmer).where(F.col("stem").isin(wanted)).collect()
    positive = {r["word"] for r in found if r["stem"] in lexicon.positive}
    return Matcher(tuple(sorted(positive)), tuple(sorted({r["word"] for r in found} - positive)))


def _among(word: Column, words: tuple[str, ...]) -> Column:
    return word.isin(*words) if words else F.lit(False)


def score(text: Column, match: Matcher) -> Column:
    """The integer score of a text."""
    words = list_words(F.coalesce(text, F.lit("")))
    # The list is computed once for a text: the outer transform binds it.
    def total(w: Column) -> Column:
        def weight(x: Column, i: Column) -> Column:
            side = F.when(_among(x, match.positive), 1).when(_among(x, match.negative), -1).otherwise(0)
            before = F.slice(w, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)))
            turned = F.exists(before, lambda y: y.isin(*NEGATORS))
            return F.when(side == 0, 0).when(turned, -side).otherwise(side)

        return F.aggregate(F.transform(w, weight), F.lit(0), lambda a, b: a + b)

    return F.element_at(F.transform(F.array(words), total), 1)


def classify(value: Column) -> Column:
    """The sign of a score; 0 is neutral."""
    return F.when(value > 0, "positive").when(value < 0, "negative").otherwise("neutral")


def abstention_rate(scored: DataFrame, col: str = "score") -> DataFrame:
    """One row, abstention_rate: the share of scores that are 0; 0 for no rows."""
    return scored.agg(F.coalesce(F.avg(F.when(F.col(col) == 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("abstention_rate"))


class LexiconSystem:
    """A word list as a system that the harness scores; nothing is fitted."""

    def __init__(self, lexicon: Lexicon, stemmer=stemming.stem):
        self.lexicon, self.stemmer = lexicon, stemmer
        self.name, self.evidence_grade = f"lexicon-{lexicon.name}", lexicon.evidence_grade

    def scores(self, docs: DataFrame) -> DataFrame:
        return docs.select("example_id", score(F.col("text"), matcher(self.lexicon, docs, stemmer=self.stemmer)).alias("score"))

    def predict(self, docs: DataFrame) -> DataFrame:
        return self.scores(docs).select("example_id", classify(F.col("score")).alias("pred"))
