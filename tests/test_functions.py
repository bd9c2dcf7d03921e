"""Column functions on edge tables with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import labels, lines, mixed, text
from opinara.functions.themes import canonical_themes, is_failed, named_themes


def values(spark, inputs, column, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {dtype}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


STARS = ["5", "4", "3", "3.5", "2", None, "nan", "inf", "abc", " 4 ", "3d", "1_0", "", "1e1", "-inf"]


def test_three_class(spark):
    assert values(spark, STARS, labels.sentiment_from_stars) == [
        "positive", "positive", "neutral/mixed", "negative", "negative", "negative", "negative",
        "positive", None, "positive", None, None, None, "positive", "negative",
    ]


def test_binary(spark):
    assert values(spark, STARS, lambda c: labels.sentiment_from_stars(c, "binary")) == [
        "positive", "positive", None, None, "negative", None, None, "positive", None, "positive",
        None, None, None, "positive", "negative",
    ]


def test_numeric_stars(spark):
    assert values(spark, [5.0, 3.0, float("nan"), None], labels.sentiment_from_stars, "double") == [
        "positive", "neutral/mixed", "negative", "negative",
    ]


def test_unknown_scheme():
    with pytest.raises(ValueError):
        labels.sentiment_from_stars(F.lit(1), "four_class")


def test_contrast(spark):
    texts = ["ok but slow", "ok but, slow", "but slow", "slow but", "slow but\n", "butter", "BUT no", None]
    assert values(spark, texts, mixed.has_contrast) == [
        True, False, True, True, False, False, True, False,
    ]


def test_dual_polarity(spark):
    texts = ["good but bad", "good's bad", "GOOD, bad!", "good", "", None]
    assert values(spark, texts, mixed.has_dual_polarity) == [True, False, True, False, False, False]


def test_mixed_rule(spark):
    pairs = [(0.30, 0.30), (0.29, 0.40), (0.56, 0.30), (0.50, 0.30), (None, 0.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p double, n double")
    rule = mixed.mixed_rule(F.lit("so but so"), F.col("p"), F.col("n"))
    got = [r[0] for r in df.orderBy("i").select(rule).collect()]
    assert got == [True, False, False, True, False]
    absent = mixed.mixed_rule(F.lit("good but bad"), None, None)
    assert df.select(absent).first()[0]


def test_is_mixed_only_in_middle(spark):
    flags = values(
        spark, ["positive", "neutral", "neutral/mixed", None],
        lambda c: mixed.is_mixed(c, F.lit("good but bad"), None, None),
    )
    assert flags == [False, True, True, False]


def test_named_themes(spark):
    assert values(spark, ["a, b", "a,b,,", None, " x ", "FAILED", "NOT PROCESSED,a, a", " y\t"], named_themes) == [
        ["a", "b"], ["a", "b"], None, ["x"], [], ["a", "a"], ["y"],
    ]
    assert values(spark, ["FAILED", "x, FAILED (TIMEOUT)", "x", None], is_failed) == [
        True, True, False, False,
    ]


def test_canonical_themes(spark):
    given = [["customer service", " PRICE and value\n", "Parking", "Customer Service"], [], None]
    assert values(spark, given, canonical_themes, "array<string>") == [
        ["Customer Service", "Price and Value"], [], None,
    ]


def test_text(spark):
    assert values(spark, ["é€😀x", "plain"], text.latin1) == ["é??x", "plain"]
    assert values(spark, ["* **Bold** *"], text.strip_markdown) == ["- Bold -"]
    assert values(spark, [" \t a b\n\x1f"], text.strip) == ["a b"]
    assert values(spark, ["A b2 _c, Été x_1 ½é"], text.tokens) == [["b2", "_c", "été", "x_1", "½é"]]
    assert values(spark, [None, "ÀB"], text.clean) == ["", "àb"]


def test_percent(spark):
    assert values(spark, [0.0625, 0.9125, 1.0], lines.percent, "double") == ["6.2%", "91.2%", "100.0%"]
    assert values(spark, [1234, 5], lines.whole_number, "int") == ["1,234", "5"]


def test_feed_and_report_lines(spark):
    from opinara.plans.report import feed_lines, report_lines

    rows = [
        (1, "positive", "4.7", "2024-01-31 10:00:00", "a, b", 0.9, True, "Nice ☕"),
        (2, None, "abc", None, None, None, None, ""),
        (3, "negative", "inf", "2024-01-31 10:00:00.25", "**x**", 0.5, False, "t"),
        (4, "negative", "nan", "2024-02-01 00:00:00", None, 0.25, False, "t"),
    ]
    df = spark.createDataFrame(
        rows, "i int, predicted_sentiment string, stars string, date string, themes string, "
        "confidence double, is_mixed boolean, clean_text string",
    ).withColumn("date", F.col("date").cast("timestamp_ntz"))
    feed = [tuple(r) for r in feed_lines(df).orderBy("i").select("header", "tags").collect()]
    assert feed == [
        ("**POSITIVE** | ★★★★ | Date: 2024-01-31 10:00:00", "**a, b** • Conf: 90.0% • Mixed"),
        ("**UNKNOWN**", None),
        ("**NEGATIVE** | Date: 2024-01-31 10:00:00.250000", "****x**** • Conf: 50.0%"),
        ("**NEGATIVE** | Date: 2024-02-01 00:00:00", "Conf: 25.0%"),
    ]
    report = report_lines(df.withColumn("s", F.lit("x")), ["s"], ["i"]).orderBy("number")
    assert [tuple(r)[1:] for r in report.collect()] == [
        (1, "Review 1: POSITIVE | 4 stars | Date: 2024-01-31 10:00:00", '"Nice ?"',
         "Theme: a, b | Confidence: 90.0% | Mixed Sentiment"),
        (2, "Review 2: UNKNOWN", '""', None),
        (3, "Review 3: NEGATIVE | Date: 2024-01-31 10:00:00.250000", '"t"', "Theme: x | Confidence: 50.0%"),
        (4, "Review 4: NEGATIVE | Date: 2024-02-01 00:00:00", '"t"', "Confidence: 25.0%"),
    ]
    bare = df.select("i", "clean_text")
    assert feed_lines(bare).filter("i = 1").select("header", "tags").first() == ("**UNKNOWN**", None)


def test_vocabularies(spark):
    assert len(vocab.THEMES) == 8
    english = vocab.ENGLISH_STOP_WORDS
    assert len(english) == 318
    assert {"isn't", "theirs", "did"}.isdisjoint(english)
    assert len(vocab.default_stop_words()) == 325
