"""Column expressions over text: tokens, shingles, overlap, trimming, span repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token patterns of near-duplicate search and of word-list scoring.
PLAIN_WORD = "[a-z0-9]+"
LIST_WORD = "[a-z][a-z']*"


def lowered(text: Column) -> Column:
    """Lower case code point by code point, as SQL has it: Java makes two of a capital I with a dot and looks at what follows a sigma."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(PLAIN_WORD), F.lit(0))


def list_words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(LIST_WORD), F.lit(0))


def shingles(words: Column, size: int = 5) -> Column:
    """The distinct runs of ``size`` words; all words as one where there are fewer; none of none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 0 where either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's and the four ASCII separators."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def nearest_offset(content: Column, value: Column, start: Column) -> Column:
    """The offset at which value stands in content: start if it does there, else the nearest, the
    earlier of two as near, null if none. Offsets count code points from 0; occurrences may overlap.

    The content is split before each occurrence, so the pieces' lengths are the offsets; one fold
    over the pieces keeps the nearest. Linear in the content. A negative start never matches itself.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(content, quoted)
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, piece: Column) -> Column:
        here = (acc["at"] > 0) | content.startswith(value)
        nearer = acc["best"].isNull() | (F.abs(acc["at"] - start) < F.abs(acc["best"] - start))
        best = F.when(here & nearer & (F.length(piece) > 0), acc["at"]).otherwise(acc["best"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), best.alias("best"))

    exact = (start >= 0) & (F.substring(content, start + 1, F.length(value)) == value)
    search = F.when(F.length(value) > 0, F.aggregate(pieces, begin, step, lambda acc: acc["best"]))
    return F.when(exact, start).otherwise(search).cast("int")
