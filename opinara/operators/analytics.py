"""Aggregates behind the charts and tables.

Every operator takes reviews or exploded reviews, or, with `weight`, a table already counted
by `sentiment_cube` / `theme_cube`: one pass over the data then serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara.functions.lines import filter_line, percent, whole_number
from opinara.operators.filters import Day, in_date_range
from opinara.operators.ranking import order_statistics
from opinara.operators.themes import explode_themes
from opinara.session import pin
from opinara.vocab import ALL_SENTIMENTS, SHOWN_CLASSES

# Rows of the theme ranking, name of the comparison row, whisker length.
TOP_THEMES = 20
TOTAL_ROW = "Total Raw Reviews"
WHISKER = 1.5


def _count(weight: str | None) -> Column:
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("count")


def sentiment_cube(df: DataFrame, date: str | None = "date") -> DataFrame:
    """Reviews counted by month end and, where they have one, predicted class, as `n`.

    Where the reviews have them, also the sums behind the key figures: `confidence_sum`,
    `confidence_n`, `mixed`.
    """
    month = F.last_day(date) if date else F.lit(None).cast("date")
    classes = [c for c in df.columns if c == "predicted_sentiment"]
    sums = [F.count(F.lit(1)).alias("n")]
    if "confidence" in df.columns:
        sums += [F.sum("confidence").alias("confidence_sum"), F.count("confidence").alias("confidence_n")]
    if "is_mixed" in df.columns:
        sums.append(F.sum(F.col("is_mixed").cast("int")).alias("mixed"))
    return df.groupBy(month.alias("month"), *classes).agg(*sums)


def theme_cube(exploded: DataFrame, date: str | None = "date") -> DataFrame:
    """Exploded reviews counted by month end, theme and predicted class, as `n`."""
    month = F.last_day(date) if date else F.lit(None).cast("date")
    return exploded.groupBy(month.alias("month"), "Theme", "predicted_sentiment").agg(
        F.count(F.lit(1)).alias("n")
    )


def key_figures(df: DataFrame) -> DataFrame:
    """Number of reviews, mean confidence, share of mixed reviews in percent (null if empty).

    The latter two are there only if their column is.
    """
    return figures_of_cube(sentiment_cube(df, None))


def figures_of_cube(cube: DataFrame) -> DataFrame:
    """The key figures from the sums of a `sentiment_cube`."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    figures = [n.alias("reviews")]
    if "confidence_sum" in cube.columns:
        mean = F.try_divide(F.sum("confidence_sum"), F.sum("confidence_n"))
        figures.append(mean.alias("avg_confidence"))
    if "mixed" in cube.columns:
        figures.append((100 * F.try_divide(F.sum("mixed"), n)).alias("mixed_rate"))
    return cube.agg(*figures)


def key_figure_texts(figures: DataFrame) -> DataFrame:
    """The key figures as displayed."""
    texts = {
        "reviews": whole_number(F.col("reviews")),
        "avg_confidence": percent(F.col("avg_confidence")),
        "mixed_rate": F.concat(F.format_number("mixed_rate", 1), F.lit("%")),
    }
    return figures.select(*[texts[c].alias(c) for c in figures.columns])


def sentiment_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Reviews per predicted class, most frequent first; null classes left out."""
    return (
        df.filter(F.col("predicted_sentiment").isNotNull())
        .groupBy(F.col("predicted_sentiment").alias("sentiment"))
        .agg(_count(weight))
        .orderBy(F.desc("count"), "sentiment")
    )


def sentiment_shares(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of every predicted class."""
    # The window is over one row per class, whatever the input.
    total = F.sum("count").over(Window.partitionBy())
    return sentiment_counts(df, weight).withColumn("share", F.col("count") / total)


def confidence_boxes(df: DataFrame, exact: bool = True) -> DataFrame:
    """Box-plot figures of the confidence per predicted class.

    Quartiles interpolate between the order statistics at n * p - 1/2, as the chart does;
    whiskers end at the last value within 1.5 interquartile ranges of the box. Without `exact`
    the quartiles come from one pass that keeps a bounded summary per class.
    """
    rows = df.select(F.col("predicted_sentiment").alias("sentiment"), "confidence").dropna()
    boxes = _exact_quartiles(rows) if exact else _summary_quartiles(rows)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = F.col("confidence").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.join(boxes, "sentiment")
        .groupBy("sentiment", "q1", "median", "q3")
        .agg(
            F.min("confidence").alias("min"),
            F.max("confidence").alias("max"),
            F.min(F.when(inside, F.col("confidence"))).alias("_low"),
            F.max(F.when(inside, F.col("confidence"))).alias("_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(
            "sentiment", "min", F.least("q1", "_low").alias("lower_fence"), "q1", "median", "q3",
            F.greatest("q3", "_high").alias("upper_fence"), "max", "outliers",
        )
        .orderBy("sentiment")
    )


def _summary_quartiles(rows: DataFrame) -> DataFrame:
    q = F.percentile_approx("confidence", [0.25, 0.5, 0.75], 10_000)
    return rows.groupBy("sentiment").agg(q.alias("q")).select(
        "sentiment", *[F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    )


def _exact_quartiles(rows: DataFrame) -> DataFrame:
    """Quartiles per class: the ranks around each come from `order_statistics`."""
    at = F.greatest(F.least(F.col("n") * F.col("q") / 4 - 0.5, F.col("n") - 1.0), F.lit(0.0))
    low = F.floor("at")
    around = None

    def wanted(sizes: DataFrame) -> DataFrame:
        nonlocal around
        around = (
            sizes.withColumn("q", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
            .withColumn("at", at)
            .select(
                "sentiment", "q", low.alias("low"), F.least(low + 1, F.col("n") - 1).alias("high"),
                (F.col("at") - low).alias("part"),
            )
        )
        return around.select("sentiment", F.explode(F.array("low", "high")).alias("rank")).distinct()

    key = F.floor(F.col("confidence") * float(1 << 62)).cast("bigint")
    found = order_statistics(rows, "sentiment", F.col("confidence"), key, wanted)
    low_value = found.withColumnsRenamed({"rank": "low", "value": "low_value"})
    high_value = found.withColumnsRenamed({"rank": "high", "value": "high_value"})
    values = around.join(low_value, ["sentiment", "low"]).join(high_value, ["sentiment", "high"])
    between = (1 - F.col("part")) * F.col("low_value") + F.col("part") * F.col("high_value")
    quartile = {
        name: F.max(F.when(F.col("q") == q, between)) for q, name in ((1, "q1"), (2, "median"), (3, "q3"))
    }
    return pin(values.groupBy("sentiment").agg(*[v.alias(n) for n, v in quartile.items()]), "quartiles")


def monthly_sentiment(df: DataFrame, date: str = "date", weight: str | None = None) -> DataFrame:
    """Reviews per month end and predicted class, for the pairs that occur."""
    return (
        df.filter(F.col(date).isNotNull() & F.col("predicted_sentiment").isNotNull())
        .groupBy(F.last_day(date).alias("date"), "predicted_sentiment")
        .agg(_count(weight))
    )


def monthly_themes(
    exploded: DataFrame, date: str = "date", weight: str | None = None
) -> DataFrame:
    """Exploded reviews per month end and theme."""
    return (
        exploded.filter(F.col(date).isNotNull())
        .groupBy(F.last_day(date).alias("date"), "Theme")
        .agg(_count(weight))
    )


def enough_to_plot(monthly: DataFrame) -> bool:
    """More than one point; reads no more than two rows."""
    return len(monthly.take(2)) > 1


def theme_counts(exploded: DataFrame, weight: str | None = None) -> DataFrame:
    """Reviews per theme."""
    return exploded.groupBy("Theme").agg(_count(weight))


def top_themes(
    exploded: DataFrame, n: int = TOP_THEMES, weight: str | None = None
) -> DataFrame:
    """The most frequent themes, ties by name."""
    return theme_counts(exploded, weight).orderBy(F.desc("count"), "Theme").limit(n)


def themes_for_chart(top: DataFrame) -> DataFrame:
    """The ranking in ascending order, as a bar chart draws it from below."""
    return top.orderBy("count", F.desc("Theme"))


def theme_names(exploded: DataFrame) -> DataFrame:
    """Distinct themes in order."""
    return exploded.select("Theme").distinct().orderBy("Theme")


def theme_sentiment(exploded: DataFrame, weight: str | None = None) -> DataFrame:
    """Reviews per theme and predicted class, for all themes at once."""
    return exploded.groupBy("Theme", "predicted_sentiment").agg(_count(weight))


def classes_of(table: DataFrame) -> list[str]:
    """Class columns of a crosstab."""
    return [c for c in table.columns if c not in ("Theme", "Total")]


def crosstab(exploded: DataFrame, weight: str | None = None) -> DataFrame:
    """Theme x predicted class with row totals; pairs that do not occur are 0.

    The classes are those of the data, in alphabetical order. They are read from the counts,
    which are written first.
    """
    counted = pin(theme_sentiment(exploded, weight), "theme-classes")
    found = counted.select("predicted_sentiment").distinct().orderBy("predicted_sentiment").collect()
    own = {
        c: F.coalesce(F.sum(F.when(F.col("predicted_sentiment") == c, F.col("count"))), F.lit(0))
        for (c,) in found
    }
    return counted.groupBy("Theme").agg(
        *[count.alias(c) for c, count in own.items()], F.sum("count").alias("Total")
    )


def total_row(table: DataFrame, df: DataFrame, weight: str | None = None) -> DataFrame:
    """Counts of the reviews themselves, before exploding, as one row of the crosstab `table`.

    Only classes of the crosstab count, that is, those that some themed review has.
    """
    classes = classes_of(table)
    number = F.lit(1) if weight is None else F.col(weight)
    own = [
        F.coalesce(F.sum(F.when(F.col("predicted_sentiment") == c, number)), F.lit(0)).cast("bigint").alias(c)
        for c in classes
    ]
    row = df.agg(F.lit(TOTAL_ROW).alias("Theme"), *own)
    return row.withColumn("Total", sum((F.col(f"`{c}`") for c in classes), F.lit(0).cast("bigint")))


def with_percent(table: DataFrame, shown: Sequence[str] = SHOWN_CLASSES) -> DataFrame:
    """Class, class (%), ..., Total; percentages have one decimal, half-even.

    Only classes among `shown` have columns; `Total` counts all.
    """
    columns = []
    for c in (c for c in shown if c in classes_of(table)):
        share = F.try_divide(F.col(f"`{c}`"), F.col("Total")) * 100
        columns += [F.col(f"`{c}`"), (F.rint(share * 10) / 10).alias(f"{c} (%)")]
    return table.select("Theme", *columns, "Total")


def theme_table(
    exploded: DataFrame, df: DataFrame, theme: str | None = None, weight: str | None = None
) -> DataFrame:
    """Crosstab with percentages and the comparison row, for one theme or all."""
    table = crosstab(exploded, weight)
    both = with_percent(table.unionByName(total_row(table, df, weight)))
    return both if theme is None else both.filter(F.col("Theme").isin(theme, TOTAL_ROW))


def date_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    """First and last date."""
    return df.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def filter_summary(
    df: DataFrame, start: Day | None = None, end: Day | None = None, date: str = "date"
) -> DataFrame:
    """How many reviews a date range keeps, counted in one pass."""
    kept = F.count_if(in_date_range(df, start, end, date))
    counts = df.agg(F.count(F.lit(1)).alias("original"), kept.alias("kept"))
    return counts.withColumn("message", filter_line(F.col("kept"), F.col("original")))


def matching_reviews(df: DataFrame) -> DataFrame:
    """Number of reviews per theme and sentiment choice, "All" included, in one pass.

    A review counts once per theme: repeats are removed in its own theme array, so the
    count needs no distinct shuffle.
    """
    own = theme_sentiment(explode_themes(df, distinct=True))
    # The sets are formed from the counts, not from the rows.
    sets = [["Theme"], ["Theme", "predicted_sentiment"]]
    sentiment = F.coalesce("predicted_sentiment", F.lit(ALL_SENTIMENTS))
    return (
        own.groupingSets(sets, "Theme", "predicted_sentiment")
        .agg(F.sum("count").alias("reviews"))
        .select("Theme", sentiment.alias("sentiment"), "reviews")
    )
