"""Physical plans: pushed filters, pruned columns, no Python and no unbounded single task."""

import re

import pytest
from pyspark.sql import functions as F

import registry
from opinara.operators import analytics as a, filters, insights as ins, ranking, themes as th
from opinara.operators.prepare import with_clean_text
from registry.core import scored, table

QUERIES = registry.QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# The literal fallback and the model call are the two places that need Python.
PYTHON = re.compile(r"thm_(4|6|8|11)|jon_4|udf_2")


@pytest.mark.parametrize("name", sorted(
    n for n in QUERIES if not re.match(r"snk|mdl|src|thm_1[02]|ins_4|jon_[25]|udf_1|set_3|prj_11", n)
))
def test_python_only_where_needed(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    uses = bool(re.search(r"EvalPython|InPandas|PythonMapInArrow|MapInArrow", text))
    assert uses == bool(PYTHON.match(name))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)


def test_date_range_is_pushed(spark, sf_dir):
    df = filters.date_range(table(spark, sf_dir, "orders"), "1996-03-01", "1996-03-31", "o_orderdate")
    text = df.select("o_orderkey")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderdate.*LessThan\(o_orderdate", text)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", text)


def test_scans_read_needed_columns_only(spark, sf_dir):
    text = plan(a.theme_counts(th.explode_themes(scored(spark, sf_dir))))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


def test_one_shuffle_for_counts(spark, sf_dir):
    df = scored(spark, sf_dir)
    for result in (a.theme_sentiment(th.explode_themes(df)), a.monthly_sentiment(df)):
        text = plan(result)
        assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text
    choices = plan(a.matching_reviews(df))
    assert choices.index("Expand") < choices.rindex("HashAggregate") < choices.index("Generate")


def test_drill_down_needs_no_shuffle(spark, sf_dir):
    assert "Exchange" not in plan(filters.drill_down(scored(spark, sf_dir), "Price and Value"))


def test_reply_checks_need_no_shuffle(spark):
    df = spark.range(10).select(F.col("id").alias("batch_id"), F.lit(2).alias("size"), F.lit("{}").alias("raw"))
    assert "Exchange" not in plan(th.review_themes(th.parsed_replies(df)))


def test_top_lists_need_no_full_sort(spark, sf_dir):
    top = plan(a.top_themes(th.explode_themes(scored(spark, sf_dir))))
    first = plan(ranking.first_rows(with_clean_text(table(spark, sf_dir, "documents")), 50, "doc_id"))
    for text in (top, first):
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_group_samples_are_cut_before_each_shuffle(spark, sf_dir):
    df = scored(spark, sf_dir).select("review_id", "predicted_sentiment")
    text = plan(ranking.top_k_per_group(df, ["predicted_sentiment"], ["review_id"], 50))
    assert text.count("WindowGroupLimit") == 4
    assert "SinglePartition" not in text


def test_windows_over_data_are_partitioned(spark, sf_dir):
    """Unpartitioned windows run on written tables of one row per partition only."""
    df = with_clean_text(table(spark, sf_dir, "documents"))
    text = plan(ranking.with_row_index(df.select("doc_id"), "i", ["doc_id"]))
    before = text[text.index("Window [") :]
    assert "_part" in before.splitlines()[0] and "part-sizes" in before


def test_picked_ids_fetch_their_reviews_without_shuffle(spark, sf_dir):
    text = plan(ins.insight_samples(scored(spark, sf_dir)))
    assert text.count("BroadcastHashJoin") + text.count("SortMergeJoin") == 2 and "LeftSemi" in text
    assert not re.search("Window|Generate", text)
