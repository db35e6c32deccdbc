from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.functions.stopwords import ENGLISH


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").collect()]


def test_clean_name(spark):
    got = values(spark, ["A.B, Inc.-X & Y", "café  bar", "", None, "O'Hare-Smith"], X.clean_name("c"))
    assert got == ["AB Inc X AND Y", "café bar", "", None, "O Hare Smith"]


def test_normal_form(spark):
    assert values(spark, ["  A.B.,  c-D ", "É#1", "...", None], X.normal_form("c")) == ["ab c d", "é 1", "", None]


def test_words_after_preposition(spark):
    got = values(spark, ["TRADED AND FISH LLC", "BANK OF", "NO PREP", "", None], X.words_after_preposition("c"))
    assert got == [2, 0, None, None, None]


def test_endings(spark):
    texts = ["a b c d", "a b", "", None]
    assert values(spark, texts, X.last_words("c", 3)) == ["b c d", "a b", "", None]
    assert values(spark, texts, X.without_last_words("c", 3)) == ["a", "", "", None]
    assert values(spark, texts, X.residual_length("c", 3)) == [1, 0, 0, None]
    assert values(spark, texts, X.nth_word_from_right("c", 2)) == ["c", "a", None, None]


def test_removed_text(spark):
    df = spark.createDataFrame([("ACME LLC", "ACME"), ("ACME", "ACME"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(X.removed_text("a", "b")).collect()] == [" LLC", None, None]


def test_tokens_and_ngrams(spark):
    assert values(spark, ["x1y22 ٣", "", None], X.digit_runs("c")) == [["1", "22", "٣"], [], None]
    assert values(spark, ["one two three", "one", ""], X.word_ngrams("c", 2, 3)) == [["one two", "two three", "one two three"], [], []]
    assert values(spark, ["THE cat the dog"], X.word_ngrams("c", 2, 2, ENGLISH)) == [["THE cat", "cat dog"]]
    assert values(spark, ["aB  c", "x", "", None], X.char_ngrams("c", 2)) == [["ab", "b ", " c"], [], [], None]


def test_missing_and_first(spark):
    texts = ["a", "", "nan", "None", None, "N/A"]
    assert values(spark, texts, X.is_present("c")) == [True, False, False, False, False, True]
    assert values(spark, ["éa", "", None], X.first_character("c")) == ["é", None, None]


def test_affix_trigrams(spark):
    got = values(spark, ["big inc"], X.affix_trigrams("c", ["inc"], weight=2))[0]
    assert got.count("big") == 2 and got.count("inc") == 1 and got.count(" in") == 1


def test_hover_text(spark):
    df = spark.createDataFrame([(1, "x", None)], "n int, a string, b string")
    assert df.select(X.hover_text("n", ["a", "b"])).first()[0] == "Node: 1<br>a: x<br>b: "


def test_stop_words_equal_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert sorted(ENGLISH) == sorted(StopWordsRemover.loadDefaultStopWords("english"))
    assert spark.range(1).select(F.lit("the").isin(*ENGLISH)).first()[0]
