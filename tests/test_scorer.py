"""The relational scorer against the pipeline model and against plain arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from opinara.operators import scorer
from opinara.operators.model import classes_of, fit_classifier, predict
from opinara.session import local_table, new_path


def rows(spark, classes):
    words = ("good", "bad", "slow", "fast", "coffee", "line", "app", "staff")
    texts = [" ".join(words[(i * j + j) % 8] for j in range(1, 2 + i % 6)) for i in range(120)]
    data = [(f"r{i % 100}", t, classes[(i * 7 + len(t)) % len(classes)]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, (None, "bad app", classes[0])], "review_id string, clean_text string, sentiment string")


@pytest.mark.parametrize("classes", [("negative", "positive"), ("negative", "neutral/mixed", "positive")])
def test_same_as_the_pipeline(spark, classes):
    df = rows(spark, classes)
    model = fit_classifier(df)
    path = new_path(spark, "weights")
    scorer.weight_tables(spark, model, classes_of(model)).save(path)
    unknown = spark.createDataFrame([("u1", ""), ("u2", None), ("u3", "zebra")], "review_id string, clean_text string")
    given = df.select("review_id", "clean_text").unionByName(unknown)
    got = scorer.class_probabilities(given, scorer.WeightTables.load(spark, path)).collect()
    own = predict(given.withColumn("clean_text", F.coalesce("clean_text", F.lit(""))), model).collect()
    want = sorted((str(r["review_id"]), tuple(r[f"prob_{c}"] for c in classes)) for r in own)
    have = sorted((str(r["review_id"]), tuple(r["probabilities"][c] for c in classes)) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want] and len(have) == given.count()
    for (_, a), (_, b) in zip(have, want):
        assert a == pytest.approx(b, abs=1e-9) and sum(a) == pytest.approx(1)
    for r in got:
        top = max(r["probabilities"].values())
        assert r["confidence"] == top and r["probabilities"][r["predicted_sentiment"]] == top


def test_by_hand(spark):
    tables = scorer.WeightTables(
        local_table(spark, term=["good", "bad", "good bad", "dull"], idf=[1.0, 2.0, 3.0, 4.0]),
        local_table(spark, **{"class": ["p", "p", "n"], "term": ["good", "good bad", "bad"], "weight": [2.0, 800.0, 900.0]}),
        local_table(spark, **{"class": ["n", "p"], "intercept": [0.5, 0.0]}),
    )
    given = spark.createDataFrame(
        [(1, "good good"), (2, "good bad zebra"), (3, "dull"), (4, "")], "review_id long, clean_text string"
    )
    got = {r["review_id"]: r for r in scorer.class_probabilities(given, tables, "review_id").collect()}
    # Row 1: only "good", so its weight is 1. Row 2: 1, 2 and 3 over the root of 14.
    n, p = 0.5 + 900 * 2 / 14**0.5, (2 + 800 * 3) / 14**0.5
    want = {1: (0.5, 2.0), 2: (n, p), 3: (0.5, 0.0), 4: (0.5, 0.0)}
    for i, (a, b) in want.items():
        share = 1 / (1 + math.exp(b - a)) if b - a < 700 else 0.0
        assert got[i]["probabilities"]["n"] == pytest.approx(share, abs=1e-12)
    assert scorer.class_probabilities(given.limit(0), tables).count() == 0
