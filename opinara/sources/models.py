"""Saved classifiers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from opinara.operators.model import train


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def model_exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole model is saved: its metadata is readable."""
    try:
        return not spark.read.text(f"{path}/metadata").limit(1).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def load_or_train(
    spark: SparkSession, path: str, training: DataFrame | None = None, force: bool = False, **options
) -> tuple[PipelineModel, float | None]:
    """The saved model, or a newly trained and saved one with its accuracy.

    A saved model is used as it is, without accuracy, unless `force` asks for a new one.
    """
    if not force and model_exists(spark, path):
        return PipelineModel.load(path), None
    if training is None:
        raise ValueError(f"no model in {path} and no training data given")
    model, accuracy = train(training, **options)
    save_model(model, path)
    return model, accuracy
