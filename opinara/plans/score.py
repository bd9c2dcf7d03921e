"""Scoring of a review file without a user interface."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from opinara.operators.model import predict
from opinara.operators.prepare import parse_dates, with_clean_text, with_review_id
from opinara.session import spread
from opinara.sources.models import load_or_train
from opinara.sources.reports import write_scored
from opinara.sources.reviews import read_reviews, read_training


def score(reviews: DataFrame, model: PipelineModel, fill_ids: bool = False) -> DataFrame:
    """Ids, clean text and predictions for raw reviews.

    Ids are made where the column is absent; `fill_ids` also replaces missing ones, which
    writes the reviews once.
    """
    rows = with_clean_text(with_review_id(reviews, fill_null=fill_ids))
    return predict(spread(rows), model)


def score_job(
    spark: SparkSession,
    input_path: str,
    model_path: str,
    output_path: str,
    training_folder: str | None = None,
    multi_line: bool = True,
    fill_ids: bool = False,
) -> float | None:
    """Read a CSV, score it with the saved or a newly trained model, write the result.

    Returns the accuracy if a model was trained.
    """
    training = None if training_folder is None else read_training(spark, training_folder)
    model, accuracy = load_or_train(spark, model_path, training)
    reviews = read_reviews(spark, input_path, multi_line)
    if "date" in reviews.columns:
        reviews = parse_dates(reviews)
    write_scored(score(reviews, model, fill_ids), output_path)
    return accuracy
