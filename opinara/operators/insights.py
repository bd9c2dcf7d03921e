"""Insights per theme and sentiment: sampled reviews, one prompt per pair, cited reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from opinara.functions.replies import cited_positions, insight_text
from opinara.operators.filters import sampled_text
from opinara.operators.ranking import FEED_SIZE, row_hash, sample_per_group
from opinara.operators.themes import PARALLEL_CALLS, explode_themes, raise_outage, written_replies
from opinara.session import pin
from opinara.vocab import ALL_SENTIMENTS

# Fixed value: reviews shown to the model per theme and sentiment.
SAMPLE_SIZE = 50

GROUP = ["Theme", "sentiment"]

INSIGHT_INSTRUCTIONS = """Read these {sentiment}customer reviews about the theme '{theme}'.
First, list three to five concrete reasons for the customers' view as short bullets. Name
what happened; avoid general phrases.
Then name the three reviews, by number, that show these reasons best.
Use exactly this form:
INSIGHTS:
[bullets]
RELEVANT_IDS:
[number, number, number]

{reviews}"""


def theme_choices(df: DataFrame) -> DataFrame:
    """Reviews once per theme they carry and per choice of sentiment: their own and "All"."""
    choices = F.array(F.col("predicted_sentiment"), F.lit(ALL_SENTIMENTS))
    return explode_themes(df.drop("sentiment"), distinct=True).withColumn(
        "sentiment", F.explode(choices)
    )


def random_feeds(
    df: DataFrame, n: int = FEED_SIZE, seed: int = 0, id_column: str = "review_id"
) -> DataFrame:
    """The random feed of every theme and sentiment at once, with 0-based `position`.

    Rows are picked and fetched by a hash of all their columns, so ids may be missing or
    repeated. Of rows that are alike one is fetched and stands for all that were picked.
    """
    df = df.drop("sentiment")
    rows = df.withColumn("_row", row_hash(df))
    picked = sample_per_group(theme_choices(rows), GROUP, n, seed, id_column, "_row")
    wanted = rows.join(picked.select("_row").distinct(), "_row", "left_semi").dropDuplicates(["_row"])
    return wanted.join(picked.drop(id_column), "_row").drop("_row")


def insight_samples(
    df: DataFrame, n: int = SAMPLE_SIZE, seed: int = 0, id_column: str = "review_id"
) -> DataFrame:
    """Up to n reviews with text per theme and sentiment, picked like a random feed."""
    return random_feeds(sampled_text(df), n, seed, id_column)


def insight_prompts(samples: DataFrame, template: str = INSIGHT_INSTRUCTIONS) -> DataFrame:
    """One prompt per theme and sentiment: (Theme, sentiment, sample_size, prompt).

    A group holds the sample only. The template names {sentiment}, {theme} and {reviews}.
    """
    entry = F.struct("position", "clean_text")
    grouped = samples.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("sample_size"), F.collect_list(entry).alias("entries")
    )
    numbered = F.transform(
        F.array_sort("entries"),
        lambda e: F.concat(
            F.lit("Review "), e["position"].cast("string"), F.lit(": "), e["clean_text"]
        ),
    )
    word = F.when(F.col("sentiment") == ALL_SENTIMENTS, "").otherwise(
        F.concat("sentiment", F.lit(" "))
    )
    head, tail = template.split("{reviews}")

    def filled(text: str):
        named = F.replace(F.lit(text), F.lit("{theme}"), F.col("Theme"))
        return F.replace(named, F.lit("{sentiment}"), word)

    prompt = F.concat(filled(head), F.array_join(numbered, "\n"), filled(tail))
    return grouped.select(*GROUP, "sample_size", prompt.alias("prompt"))


def parsed_insights(replies: DataFrame) -> DataFrame:
    """(Theme, sentiment, insights, cited, error): text and cited sample positions of each reply.

    A group whose call failed stays, without insights and with its error.
    """
    return replies.select(
        *GROUP,
        insight_text(F.col("raw")).alias("insights"),
        F.coalesce(cited_positions(F.col("raw"), F.col("sample_size")), F.array().cast("array<bigint>")).alias("cited"),
        "error",
    )


def cited_reviews(insights: DataFrame, samples: DataFrame) -> DataFrame:
    """Sampled reviews an insight cites, with their 1-based `citation` order."""
    cited = insights.select(*GROUP, F.posexplode("cited").alias("citation", "position"))
    return cited.withColumn("citation", F.col("citation") + 1).join(
        samples, [*GROUP, "position"]
    )


def insights(
    df: DataFrame,
    ask: Callable[[str], str],
    n: int = SAMPLE_SIZE,
    seed: int = 0,
    parallel_calls: int = PARALLEL_CALLS,
    id_column: str = "review_id",
) -> tuple[DataFrame, DataFrame]:
    """Insights of every theme and sentiment, and the reviews they cite.

    Samples and replies are written before use: both the prompt and the citations must see
    the same sample, and a call is never repeated for one. A group whose call failed has its
    error in place of insights; if all calls fail alike, this raises.
    """
    samples = pin(insight_samples(df, n, seed, id_column), "insight-samples")
    replies = written_replies(insight_prompts(samples), ask, parallel_calls)
    raise_outage(replies)
    found = parsed_insights(replies)
    return found, cited_reviews(found, samples)
