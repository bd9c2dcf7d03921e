"""Sentiment classifier: stratified split, training, prediction columns, accuracy."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara.functions.mixed import is_mixed
from opinara.operators import features as f
from opinara.operators.prepare import training_rows
from opinara.operators.ranking import order_statistics, seeded_key, unused, with_row_index
from opinara.session import pin, spread

# Split and solver settings.
TEST_SHARE = 0.2
SEED = 2016
INVERSE_PENALTY = 0.8
MAX_ITERATIONS = 1000

# Columns that the stages add, before they are dropped.
RAW, PROBABILITY, PREDICTION = "_model_raw", "_model_probability", "_model_prediction"
_STAGE_COLUMNS = (
    f.TOKENS, f.WORDS, f.PAIRS, f.TERMS, f.COUNTS, f.WEIGHTED, f.FEATURES, RAW, PROBABILITY, PREDICTION,
)


class Trained(NamedTuple):
    model: PipelineModel
    accuracy: float


def test_sizes(sizes: DataFrame, label: str = "sentiment", share: float = TEST_SHARE) -> DataFrame:
    """Test rows per class of (label, n): `share` of all rows rounded up, by largest remainder.

    Gives (label, `test_rows`). The windows are over one row per class, enough for millions of them.
    """
    every = Window.partitionBy()
    whole = F.sum("n").over(every)
    total = F.ceil(F.lit(share) * whole)
    exact = F.col("n") * total.cast("double") / whole
    parts = sizes.select(
        F.col(label).alias("label"), F.floor(exact).alias("least"), (F.floor(exact) - exact).alias("rest"),
        total.alias("total"),
    )
    place = F.row_number().over(Window.orderBy("rest", "label"))
    one_more = (place <= F.col("total") - F.sum("least").over(every)).cast("bigint")
    return parts.select(F.col("label").alias(label), (F.col("least") + one_more).alias("test_rows"))


def stratified_split(
    df: DataFrame,
    label: str = "sentiment",
    id_column: str = "review_id",
    share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add `is_test`: per class, the rows with the smallest seeded keys.

    The key of the last test row of each class is found by counting, so that a class of any
    size is split without sorting it in one task. Rows with one id stay on one side; where
    ids may repeat, give a column of row positions. Rows without a label are in neither part
    and get null.
    """
    own, limit = unused(df, "_key"), unused(df, "_limit")
    keyed = df.withColumn(own, seeded_key(F.col(id_column), seed))
    # Keys are made of text; two scans read the numbers that are written here.
    keys = keyed.select(F.col(label).alias("label"), F.col(own).alias("key")).filter("label IS NOT NULL")

    def last(sizes: DataFrame) -> DataFrame:
        tests = test_sizes(sizes, "label", share).filter("test_rows > 0")
        return tests.select("label", (F.col("test_rows") - 1).alias("rank"))

    limits = order_statistics(pin(keys, "split-keys"), "label", F.col("key"), F.col("key"), last)
    # Limits are written, so Spark knows their size; a class without test rows has none.
    limits = limits.select(F.col("label").alias(label), F.col("value").alias(limit))
    inside = F.coalesce(F.col(own) <= F.col(limit), F.lit(False))
    split = keyed.join(limits, label, "left").withColumn("is_test", F.when(F.col(label).isNotNull(), inside))
    return split.select(*[F.col(f"`{c}`") for c in df.columns], "is_test")


def fit_classifier(
    df: DataFrame, stop_words: Sequence[str] | None = None, label: str = "sentiment", **limits
) -> PipelineModel:
    """Fit TF-IDF and multinomial logistic regression on `clean_text` and labels.

    The penalty is that of the C-objective: 1 / (C * rows). Classes are in alphabetical order.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n_rows = sum(sizes.values())
    features = f.fit_tfidf(df, stop_words, n_rows, **limits)
    classes = sorted(sizes)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = features.transform(df).select(f.FEATURES, index.cast("double").alias("label"))
    regression = LogisticRegression(
        featuresCol=f.FEATURES,
        rawPredictionCol=RAW,
        probabilityCol=PROBABILITY,
        predictionCol=PREDICTION,
        maxIter=MAX_ITERATIONS,
        regParam=1.0 / (INVERSE_PENALTY * n_rows),
        elasticNetParam=0.0,
        standardization=False,
        family="auto",
    ).fit(rows)
    names = IndexToString(
        inputCol=PREDICTION, outputCol="predicted_sentiment", labels=classes
    )
    return PipelineModel([*features.stages, regression, names])


def train(df: DataFrame, stop_words: Sequence[str] | None = None, **limits) -> Trained:
    """Label, clean and split the reviews, fit on 80 % and measure on the rest.

    Rows are split by their position, so ids are not needed and copies do not matter.
    """
    text = F.coalesce("clean_text", F.lit("")).alias("clean_text")
    given = training_rows(df).select(text, "sentiment")
    # The index writes the rows, which split and fit read many times.
    rows = with_row_index(spread(given), "row", stored=False)
    # Written, as every pass of the fit would make the keys and look up the limits again.
    rows = pin(stratified_split(rows, id_column="row"), "split")
    model = fit_classifier(rows.filter(~F.col("is_test")), stop_words, **limits)
    tested = model.transform(rows.filter("is_test"))
    return Trained(model, accuracy(tested).first()["accuracy"])


def accuracy(
    df: DataFrame, label: str = "sentiment", predicted: str = "predicted_sentiment"
) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = (F.col(label) == F.col(predicted)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def classes_of(model: PipelineModel) -> list[str]:
    names = next(s for s in model.stages if isinstance(s, IndexToString))
    return list(names.getLabels())


def probability_columns(df: DataFrame, probabilities: Column, classes: Sequence[str]) -> DataFrame:
    """From an array in class order: `predicted_sentiment`, `confidence`, `prob_<class>`.

    The first class wins a tie.
    """
    top = F.array_max(probabilities)
    names = F.array(*[F.lit(c) for c in classes])
    columns = {
        "predicted_sentiment": F.get(names, F.array_position(probabilities, top).cast("int") - 1),
        "confidence": top,
    }
    for i, name in enumerate(classes):
        columns[f"prob_{name}"] = probabilities[i]
    return df.withColumns(columns)


def mixed_flag(df: DataFrame) -> DataFrame:
    """Add `is_mixed` from prediction, text and the two outer probabilities."""

    def probability(name: str) -> Column | None:
        return F.col(name) if name in df.columns else None

    flag = is_mixed(
        F.col("predicted_sentiment"),
        F.col("clean_text"),
        probability("prob_positive"),
        probability("prob_negative"),
    )
    return df.withColumn("is_mixed", flag)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Score `clean_text`: prediction, confidence, one probability per class, mixed flag.

    Columns of these names that `df` brings are replaced.
    """
    made = {"predicted_sentiment", "confidence", "is_mixed", *(f"prob_{c}" for c in classes_of(model))}
    scored = model.transform(df.drop(*made))
    array = scored.withColumn("_p", vector_to_array(PROBABILITY))
    flat = probability_columns(array, F.col("_p"), classes_of(model))
    return mixed_flag(flat.drop("_p", *_STAGE_COLUMNS))
