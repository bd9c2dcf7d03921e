"""Registration of queries and the review tables they run on.

The given tables hold no reviews with ratings and themes, so `orders` carries them: one
review per order, its parts chosen by the order key. The same SQL makes them in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.operators.model import mixed_flag
from opinara.operators.prepare import with_clean_text
from opinara.session import new_path
from opinara.vocab import CONTRAST_WORDS, NEGATIVE_CUES, POSITIVE_CUES, THEMES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REVIEWS = """
SELECT o_orderkey AS k, concat('r', CAST(o_orderkey AS VARCHAR(20))) AS review_id,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS date,
 CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN 'abc'
      WHEN o_orderkey % 61 = 0 THEN '3.5' WHEN o_orderkey % 67 = 0 THEN 'nan'
      ELSE CAST(1 + (o_orderkey * 7 + CAST(FLOOR(o_orderkey / 11) AS BIGINT)) % 5 AS VARCHAR(20))
      END AS stars,
 CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat(
  CASE o_orderkey % 6 WHEN 0 THEN 'The staff were friendly and the coffee was GREAT'
   WHEN 1 THEN 'Terrible wait, my order was wrong' WHEN 2 THEN 'Prices went up again'
   WHEN 3 THEN 'Love the rewards app' WHEN 4 THEN 'The store was dirty and the line was slow'
   ELSE 'Nice place to sit' END,
  CASE CAST(FLOOR(o_orderkey / 6) AS BIGINT) % 5 WHEN 0 THEN ' but ' WHEN 1 THEN '. '
   WHEN 2 THEN ', however ' WHEN 3 THEN ' but, ' ELSE ' and ' END,
  CASE CAST(FLOOR(o_orderkey / 30) AS BIGINT) % 5 WHEN 0 THEN 'the drink was bad'
   WHEN 1 THEN 'they fixed the issue' WHEN 2 THEN 'service was excellent'
   WHEN 3 THEN 'nothing was in stock' ELSE 'overall it is fine' END) END AS text
FROM {orders}"""

SCORED = """
SELECT r.*, a*1.0E0/(a+b+c) AS prob_positive, b*1.0E0/(a+b+c) AS prob_negative,
 c*1.0E0/(a+b+c) AS prob_neutral,
 CASE WHEN c >= a AND c >= b THEN 'neutral/mixed' WHEN b >= a THEN 'negative'
      ELSE 'positive' END AS predicted_sentiment,
 CASE k % 9 WHEN 0 THEN 'Product Quality, Customer Service' WHEN 1 THEN 'Speed of Service'
  WHEN 2 THEN 'Price and Value,Policies and Safety' WHEN 3 THEN 'Digital and Rewards'
  WHEN 4 THEN 'Store Environment,  Speed of Service' WHEN 5 THEN 'FAILED' WHEN 6 THEN NULL
  WHEN 7 THEN 'NOT PROCESSED' ELSE 'Product Availability, ' END AS themes
FROM (SELECT x.*, (k*37)%100+1 AS a, (k*53)%100+1 AS b, (k*71)%100+1 AS c
      FROM {reviews} x) r"""

_THEME_LIST = ", ".join(f"'{t}'" for t in THEMES)


def _any_word(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def contrast_sql(text: str) -> str:
    return "(" + " OR ".join(
        f"contains(concat(' ', lower({text}), ' '), ' {w} ')" for w in CONTRAST_WORDS
    ) + ")"


def polarity_sql(text: str) -> str:
    found = f"regexp_extract_all(lower({text}), '[a-z'']+')"
    return (f"(list_has_any({found}, {_any_word(POSITIVE_CUES)})"
            f" AND list_has_any({found}, {_any_word(NEGATIVE_CUES)}))")


CLOSE_SQL = ("(prob_positive >= 0.3 AND prob_negative >= 0.3"
             " AND abs(prob_positive - prob_negative) <= 0.25)")

_REVIEWS_SQL = REVIEWS.format(orders="orders")
_SCORED_SQL = f"""
SELECT s.*, greatest(prob_positive, prob_negative, prob_neutral) AS confidence,
 lower(coalesce(text, '')) AS clean_text,
 CASE WHEN predicted_sentiment = 'neutral/mixed'
      THEN {contrast_sql("coalesce(text, '')")}
           AND ({CLOSE_SQL} OR {polarity_sql("coalesce(text, '')")})
      ELSE FALSE END AS is_mixed
FROM ({SCORED.format(reviews="reviews")}) s"""
_EXPLODED_SQL = """
SELECT s.*, trim(name) AS Theme
FROM (SELECT scored.*, unnest(regexp_split_to_array(themes, ',\\s*')) AS name FROM scored) s
WHERE trim(name) NOT IN ('FAILED', '', 'NOT PROCESSED') AND predicted_sentiment IS NOT NULL"""
_CHOICES_SQL = """
SELECT DISTINCT e.review_id, e.Theme, unnest([predicted_sentiment, 'All']) AS sentiment
FROM exploded e"""

# Reviews with more classes, and with ids that are missing or repeated.
_MORE_CLASSES_SQL = """
SELECT scored.* REPLACE (CASE WHEN k % 7 = 0 THEN 'neutral' WHEN k % 11 = 0 THEN 'unsure'
 ELSE predicted_sentiment END AS predicted_sentiment) FROM scored"""
MORE_VIEWS = {
    "classed": _MORE_CLASSES_SQL,
    "classed_exploded": _EXPLODED_SQL.replace("scored", "classed"),
}

# Common table expressions of the oracles, in order of dependence.
_VIEWS = {
    "reviews": _REVIEWS_SQL,
    "scored": _SCORED_SQL,
    "exploded": _EXPLODED_SQL,
    "choices": _CHOICES_SQL,
}


def with_views(last: str, sql: str, **more: str) -> str:
    """`sql` after the views up to `last` and further ones."""
    names = list(_VIEWS)
    parts = [f"{n} AS ({_VIEWS[n]})" for n in names[: names.index(last) + 1]]
    parts += [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def query(name: str, sql: str | None = None):
    """Register a query and, where plain SQL can say it, its counterpart."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REVIEWS, orders=table(spark, sf_dir, "orders"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with predictions and themes, as scoring and extraction leave them."""
    df = spark.sql(SCORED, reviews=reviews(spark, sf_dir))
    top = F.greatest("prob_positive", "prob_negative", "prob_neutral")
    df = mixed_flag(with_clean_text(df.withColumn("confidence", top)))
    return df.withColumnRenamed("prob_neutral", "prob_neutral/mixed")


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reviews with the classes neutral and unsure besides the usual ones."""
    named = F.when(F.col("k") % 7 == 0, "neutral").when(F.col("k") % 11 == 0, "unsure")
    return scored(spark, sf_dir).withColumn(
        "predicted_sentiment", named.otherwise(F.col("predicted_sentiment"))
    )


def without_ids(df: DataFrame) -> DataFrame:
    """Ids that are missing for a third of the reviews and the same for the others of a customer."""
    own = F.concat(F.lit("c"), (F.col("k") % 10).cast("string"))
    return df.withColumn("review_id", F.when(F.col("k") % 3 > 0, own))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name beside the intermediate tables."""
    return new_path(spark, label)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
