"""Score each newly arrived review file once.

All scoring steps are row functions, so the batch code runs unchanged on a stream. Files
already scored are remembered in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from opinara.operators.model import predict
from opinara.operators.prepare import with_clean_text
from opinara.sources.reviews import marked_missing


def arriving_reviews(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """Stream of the review CSVs in a folder; `columns` are those of the files, in order.

    A file with other columns, or another order, ends the stream with an error. Row positions do
    not exist in a stream, so the files must bring `review_id`.
    """
    if "review_id" not in columns:
        raise ValueError("streamed reviews need a review_id")
    raw = (
        spark.readStream.schema(", ".join(f"`{c}` string" for c in columns))
        .options(header=True, multiLine=True, escape='"', enforceSchema=False)
        .csv(folder)
    )
    return marked_missing(raw)


def score_arrivals(
    reviews: DataFrame, model: PipelineModel, output: str, checkpoint: str
) -> StreamingQuery:
    """Score what has arrived since the last run and append it to `output`."""
    return (
        predict(with_clean_text(reviews), model)
        .writeStream.partitionBy("predicted_sentiment")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
