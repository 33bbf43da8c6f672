import pytest
from pyspark.sql import functions as F

from goldpan import model
from goldpan.functions import stemming, text
from goldpan.operators import conflicts, lexicon
from goldpan.scratch import Scratch


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("t, n", [("", 0), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a", 1)])
def test_shingles(spark, t, n):
    assert len(one(spark, text.shingles(text.plain_words(F.col("t"))), t=t)) == n


def test_jaccard(spark):
    a, b = (F.split(F.col(c), ",") for c in "ab")
    assert one(spark, text.jaccard(a, b), a="x,y,z", b="y,z,w") == 0.5
    assert one(spark, text.jaccard(F.array(), F.array()), a="", b="") == 0


def test_tokens_and_strip(spark):
    assert one(spark, text.list_words(F.col("t")), t="Don't STOP-loss 3rd é") == ["don't", "stop", "loss", "rd"]
    assert one(spark, text.plain_words(F.col("t")), t="Q3 2008, EBITDA!") == ["q3", "2008", "ebitda"]
    assert one(spark, text.strip(F.col("t")), t=" \t x y \n\x1c") == "x y"


@pytest.mark.parametrize("content, value, start, want", [
    ("abc abc abc", "abc", 4, 4), ("abc abc abc", "abc", 5, 4), ("abc abc abc", "abc", 6, 4), ("abc abc abc", "abc", 7, 8),
    ("xaaax", "aa", 4, 2), ("xaaax", "aa", 0, 1), ("abab", "ab", 1, 0), ("😀ab😀ab", "ab", 5, 4), ("abc", "zz", 0, None),
    (r"a.\Eb.\E", r".\E", 3, 1), ("ab", "ab", -5, 0), ("a", "", 0, 0),
])
def test_nearest_offset(spark, content, value, start, want):
    assert one(spark, text.nearest_offset(F.col("c"), F.col("v"), F.col("s")), c=content, v=value, s=start) == want


def test_nearest_offset_takes_the_earlier_of_two_as_near(spark):
    assert one(spark, text.nearest_offset(F.col("c"), F.col("v"), F.col("s")), c="ab..ab", v="ab", s=2) == 0


def test_ids_are_stable_and_by_source(spark):
    got = spark.createDataFrame([("profit rose",)], "t string").select(model.make_id("a", F.col("t")), model.make_id("a", F.col("t")), model.make_id("b", F.col("t"))).first()
    assert got[0] == got[1] != got[2] and got[0].startswith("a:") and len(got[0]) == 18


@pytest.mark.parametrize("word, want", [
    ("improving", "improv"), ("improvement", "improv"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
    ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"),
    ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("enjoy", "enjoy"), ("say", "say"),
    ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("hopefulness", "hope"), ("triplicate", "triplic"),
    ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"), ("adoption", "adopt"), ("effective", "effect"),
    ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controlling", "control"), ("roll", "roll"), ("dying", "die"), ("be", "be"), ("geology", "geolog"),
])
def test_porter(word, want):
    assert stemming.stem(word) == want


def test_stems_of_a_vocabulary(spark):
    words = spark.createDataFrame([("gains",), ("gains",), ("gained",)], "word string")
    assert sorted(map(tuple, stemming.stems(words).collect())) == [("gained", "gain"), ("gains", "gain")]


LIST = lexicon.Lexicon("l", frozenset({"strong", "gain"}), frozenset({"weak", "gain"}))


@pytest.mark.parametrize("t, want", [
    ("strong and weak and strong", 1), ("strong", 1), ("strong " + "filler " * 50, 1), ("not strong", -1), ("not a very strong", -1), ("not at all very strong", 1),
    ("not never strong", -1), ("gains", 1), ("weak", -1), ("not weak", 1), ("strong weak", 0), ("", 0), (None, 0), ("no x y strong weak", -2),
])
def test_word_list_score(spark, t, want):
    docs = spark.createDataFrame([("a", t), ("b", "gains gained strong weak")], "example_id string, text string")
    system = lexicon.LexiconSystem(LIST)
    got = {r["example_id"]: r["score"] for r in system.scores(docs).collect()}
    assert got["a"] == want
    assert {r["example_id"]: r["pred"] for r in system.predict(docs).collect()}["a"] == ("positive" if want > 0 else "negative" if want < 0 else "neutral")


def test_abstention_counts_scores_of_zero(spark):
    docs = spark.createDataFrame([("a", "strong"), ("b", "x"), ("c", "strong weak"), ("d", "weak")], "example_id string, text string")
    scores = lexicon.LexiconSystem(LIST).scores(docs)
    assert lexicon.abstention_rate(scores).first()[0] == 0.5
    assert lexicon.abstention_rate(scores.limit(0)).first()[0] == 0.0
    assert not hasattr(lexicon.LexiconSystem, "fit")


def test_score_bounds_are_exclusive(spark):
    scores = [-0.11, -0.1, 0.0, 0.1, 0.11, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").select(conflicts.score_to_label(F.col("s"))).collect()]
    assert got == ["negative", "neutral", "neutral", "neutral", "positive", "neutral", "neutral"]


def test_scratch_tables_are_in_the_shared_folder(spark, tmp_path):
    scratch = Scratch(spark, "t")
    t = scratch.table(spark.range(3))
    assert t.count() == 3 and t._goldpan_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.drop(t)
