"""A linear text classifier as tables, and scoring as joins with them.

A fitted model is three small tables: terms with their document weights, a weight per term and
class, and an intercept per class. They can be stored, inspected and joined like any other table.
A row's terms meet the weights in a join, logits are sums, and softmax goes by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.operators import features as f
from opinara.session import local_table


@dataclass(frozen=True)
class WeightTables:
    """`terms`: (term, idf); `weights`: (class, term, weight); `intercepts`: (class, intercept).

    A term without a weight for a class counts as zero there, and still in the length of a row.
    """

    terms: DataFrame
    weights: DataFrame
    intercepts: DataFrame

    def save(self, path: str) -> None:
        for name in ("terms", "weights", "intercepts"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> WeightTables:
        return WeightTables(*[spark.read.parquet(f"{path}/{n}") for n in ("terms", "weights", "intercepts")])


def weight_tables(spark: SparkSession, model: PipelineModel, classes: list[str]) -> WeightTables:
    """The tables of a fitted classifier, at most `max_terms` rows per class.

    A model of two classes has one row of coefficients; its first class then has zeros, which gives
    the same probabilities.
    """
    regression = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    words = list(next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary)
    idf = next(s for s in model.stages if isinstance(s, ElementwiseProduct)).getScalingVec().toArray().tolist()
    rows = regression.coefficientMatrix.toArray().tolist()
    intercepts = regression.interceptVector.toArray().tolist()
    if len(rows) < len(classes):
        rows, intercepts = [[0.0] * len(words), *rows], [0.0, *intercepts]
    weights = local_table(
        spark, **{"class": [c for c in classes for _ in words], "term": words * len(classes),
                  "weight": [w for row in rows for w in row]},
    )
    return WeightTables(
        local_table(spark, term=words, idf=idf), weights,
        local_table(spark, **{"class": list(classes), "intercept": intercepts}),
    )


def term_rows(df: DataFrame, id_column: str) -> DataFrame:
    """Rows (row, id, term, tf) of the words and pairs of `clean_text`, one of a null term if there are none.

    Terms are counted within their row, so nothing is shuffled. `row` tells rows of one id apart.
    """
    text = F.coalesce("clean_text", F.lit("")).alias("clean_text")
    rows = f.text_terms(df.select(F.col(id_column).alias("id"), text))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.array_sort(f.TERMS).alias("terms"))
    # Equal terms follow each other: a term's count is the distance to the next first one.
    n = F.size("terms")
    places = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (i < n) & ((i == 0) | (F.get("terms", i) != F.get("terms", i - 1))),
    )
    ends = F.concat(F.slice("places", 2, F.size("places")), F.array(n))
    counted = F.zip_with(
        "places", ends, lambda a, b: F.struct(F.get("terms", a).alias("term"), (b - a).alias("tf"))
    )
    rows = rows.withColumn("places", places)
    return rows.select("row", "id", F.inline_outer(F.when(n > 0, counted)))


def logits(df: DataFrame, tables: WeightTables, id_column: str = "review_id") -> DataFrame:
    """Rows (row, id, class, logit): every row with every class.

    Weights are TF-IDF of unit length. Sums are partial in the map tasks, where all terms of a row
    are, so that one row per input row and class is shuffled.
    """
    known = term_rows(df, id_column).join(tables.terms, "term", "left")
    known = known.withColumn("x", F.col("tf") * F.col("idf"))
    # One row of the weights per term: the classes side by side.
    by_term = tables.weights.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("class", "weight"))).alias("w"))
    bias = tables.intercepts.agg(F.map_from_entries(F.collect_list(F.struct("class", "intercept"))).alias("bias"))
    met = known.join(by_term, "term", "left")
    length = met.groupBy("row", "id").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    products = met.select("row", F.col("x"), F.explode("w").alias("class", "weight")).groupBy("row", "class").agg(
        F.sum(F.col("x") * F.col("weight")).alias("product")
    )
    # One row of intercepts.
    every = length.join(F.broadcast(bias), F.lit(True)).select("row", "id", "square", F.explode("bias").alias("class", "intercept"))
    joined = every.join(products, ["row", "class"], "left")
    product = F.coalesce(F.try_divide("product", F.sqrt("square")), F.lit(0.0))
    return joined.select("row", "id", "class", (F.col("intercept") + product).alias("logit"))


def class_probabilities(df: DataFrame, tables: WeightTables, id_column: str = "review_id") -> DataFrame:
    """Per row of `df`: the id, `predicted_sentiment`, `confidence` and `probabilities`, a map by class.

    Softmax is taken from the largest logit, so that none runs over; of equal ones the class that is
    first in the alphabet is predicted. A row without known terms has the intercepts alone. Null and
    repeated ids give a row each; an empty table gives none.
    """
    by_row = logits(df, tables, id_column).groupBy("row", "id").agg(
        F.array_sort(F.collect_list(F.struct("class", "logit"))).alias("all")
    )
    largest = F.array_max(F.transform("all", lambda x: x["logit"]))
    raised = by_row.withColumn("largest", largest).withColumn(
        "raised", F.transform("all", lambda x: F.exp(x["logit"] - F.col("largest")))
    )
    total = F.aggregate("raised", F.lit(0.0), lambda a, b: a + b)
    shares = raised.withColumn("total", total).withColumn(
        "shares", F.transform("raised", lambda x: x / F.col("total"))
    )
    names = F.transform("all", lambda x: x["class"])
    top = F.array_max("shares")
    return shares.select(
        F.col("id").alias(id_column),
        F.get(names, F.array_position("shares", top).cast("int") - 1).alias("predicted_sentiment"),
        top.alias("confidence"),
        F.map_from_arrays(names, F.col("shares")).alias("probabilities"),
    )
