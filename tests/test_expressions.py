"""Missing values, rounding, filters and cleaning on hand-written rows."""

import itertools

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from tallyscribe.functions import hashing, nulls, text
from tallyscribe.functions.stemming import stem_word
from tallyscribe.operators import prep, tokens
from tallyscribe.sources.tables import pseudonym


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_na_if_else_keeps_missing(spark):
    assert column(spark, [(1,), (0,), (None,)], "a int", nulls.na_if_else(F.col("a") == 1, "y", "n")) == ["y", "n", None]


def python_and(values):
    if 0 in values:
        return 0
    return None if None in values else 1


def test_intersections_follow_three_valued_logic(spark):
    rows = list(itertools.product([0, 1, None], repeat=3))
    got = column(spark, rows, "a int, b int, c int", nulls.intersect_flags(["a", "b", "c"]))
    assert got == [python_and(r) for r in rows]


LEVELS = ["h1", "h2", "h3", "h4", "h5"]


@pytest.mark.parametrize(
    ("row", "scale", "scale6", "binary"),
    [
        ((0, 0, 0, 0, 1, 0), 5, 5, 1),
        ((1, 0, 1, 0, 0, 0), 3, 3, 1),
        ((1, 0, 0, 0, 0, 0), 1, 1, 0),
        ((0, 0, 0, 0, 0, 1), None, 0, None),
        ((0, 0, 0, 0, 0, 0), None, None, None),
        ((1, 0, 0, 0, None, 0), None, None, None),
        ((None, 0, 0, 1, 0, 0), 4, 4, 1),
    ],
)
def test_indicators(spark, row, scale, scale6, binary):
    df = spark.createDataFrame([row], "h1 int, h2 int, h3 int, h4 int, h5 int, dk int")
    got = df.select(
        nulls.indicators_to_scale(LEVELS, "dk"), nulls.indicators_to_scale(LEVELS, "dk", 0), nulls.indicators_to_binary(LEVELS, "dk")
    ).first()
    assert tuple(got) == (scale, scale6, binary)


def test_clamp_round_share(spark):
    assert column(spark, [(0.2,), (9.0,), (3.5,), (None,)], "v double", nulls.clamp(F.col("v"), 1.0, 5.0)) == [1.0, 5.0, 3.5, None]
    assert column(spark, [(0.5,), (1.5,), (2.5,), (-0.5,)], "v double", nulls.half_even(F.col("v"))) == [0.0, 2.0, 2.0, 0.0]
    assert column(spark, [(1, 4), (1, 0), (None, 2)], "a int, b int", nulls.share(F.col("a"), F.col("b"))) == [0.25, None, None]
    assert column(spark, [(100,), (0,)], "v int", nulls.log10_positive(F.col("v"))) == [2.0, None]


def test_copy_suffix(spark):
    got = column(spark, [("12",), ("12.3",), ("a.12.5",), ("a.b",)], "v string", nulls.strip_copy_suffix(F.col("v")))
    assert got == ["12", "12", "a.5", "ab"]


def test_language_precedence(spark):
    rows = [("en", "fr"), ("und", "fr"), (None, "en"), (None, "fr"), ("fr", "en"), (None, None)]
    df = spark.createDataFrame(rows, "lang string, detected_lang string")
    assert [tuple(r) for r in prep.filter_language(df).collect()] == rows[:3]


def test_scope_precedence(spark):
    rows = [(None, None), (0, None), (1, 1), (1, 0), (1, None), (99, 1)]
    df = spark.createDataFrame(rows, "y int, t int")
    assert [tuple(r) for r in prep.scope_filter(df, "y", "t").collect()] == rows[:3]


def test_reposts(spark):
    rows = [("RT @a b", None), ("RTs", None), ("ok", "{}"), (None, None), ("RT", None)]
    df = spark.createDataFrame(rows, "text string, retweeted_status string")
    assert [r.text for r in prep.drop_reposts(df).collect()] == ["RTs", "RT"]


def test_invalidate(spark):
    df = spark.createDataFrame([(1, 3, 1, 0), (1, 1, 1, 1), (2, 3, 1, 0), (None, 3, 1, 0)], "rater int, scale int, two int, one int")
    got = prep.invalidate_labels(df, [1], keep_one=["one"], null=["two"], scale="scale").collect()
    assert [tuple(r) for r in got] == [(1, None, None, None), (1, 1, None, 1), (2, 3, 1, 0), (None, 3, 1, 0)]


def test_mark_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, i int")
    got = {r.i: r.is_copy for r in prep.mark_duplicates(df, ["k"], ["i"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("hi @éric_1!x you", "hi  you"),
        ("a <b>x</b> c", "a   c"),
        ("a <b c> d", "a <b c> d"),
        ("donâ€™t", "don't"),
        ("ðŸ€x", "x"),
        ("see http://t.co/aB1). ok", "see  )  ok"),
        ("shttps://x.org/é end", "  end"),
        ("pic.twitter.com/Zz9! ok", " ! ok"),
        ("1,5. x", "1 5  x"),
        (None, None),
    ],
)
def test_cleaning(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "text string")
    assert tokens.with_clean_text(df).first()[0] == clean


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Don't 'quote' #Tag 42 a_b http://x.y/z — École, 3rd!")], "doc_id int, text string")
    got = [r.token for r in tokens.tokenize(df).orderBy("pos").collect()]
    assert got == ["don't", "quote", "#tag", "a_b", "école", "3rd"]
    assert [r.token for r in tokens.remove_stopwords(tokens.tokenize(df)).orderBy("pos").collect()] == ["quote", "#tag", "a_b", "école", "3rd"]


def test_stop_words_are_those_of_spark(spark):
    assert list(text.STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("agreed", "agre"),
        ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"), ("happy", "happi"), ("say", "say"), ("by", "by"),
        ("relational", "relat"), ("national", "nation"), ("generously", "generous"), ("communication", "communic"),
        ("knightly", "knight"), ("adjustment", "adjust"), ("controlling", "control"), ("rate", "rate"), ("skies", "sky"),
        ("news", "news"), ("dying", "die"), ("proceed", "proceed"), ("consistency", "consist"), ("beautiful", "beauti"),
        ("running", "run"), ("bed", "bed"), ("feed", "feed"), ("yelling", "yell"), ("apology", "apolog"), ("cat's", "cat"),
    ],
)
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_hash_is_bounded_for_any_key(spark):
    df = spark.createDataFrame([(0,), (2**62,), (-5,)], "k long")
    for purpose in (hashing.SPLIT, hashing.FOLD, hashing.SAMPLE, hashing.UPSAMPLE, hashing.PERMUTE):
        assert all(0 <= r[0] < hashing.SPAN for r in df.select(hashing.key_hash(F.col("k"), purpose)).collect())


def test_pseudonym_hides_the_key(spark):
    got = column(spark, [("A@x.org ",), ("a@x.org",)], "k string", pseudonym(F.col("k"), "salt"))
    assert got[0] == got[1] and "@" not in got[0]
