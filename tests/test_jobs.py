"""Readers, writers, extraction with retries, insights, report."""

import sys

import pytest
from pyspark.sql import functions as F

from opinara import __main__ as cli
from opinara.operators import insights as ins, themes as th
from opinara.plans.extract import themed_reviews
from opinara.plans.report import SECTIONS, SUMMARY, TOP, insight_sections, report_bundle
from opinara.session import run_dir, shared_dir
from opinara.sources.reviews import read_reviews, read_training, resolve_training_file
from opinara.vocab import THEMES
from registry.core import scored


def test_read_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('review_id,text,stars\n1,"two\nlines, ""quoted""",5\nNA,null,n/a\n3,"",nan\n4,Na, 4 \n')
    rows = [tuple(r) for r in read_reviews(spark, str(path)).collect()]
    assert rows == [
        ("1", 'two\nlines, "quoted"', "5"), (None, None, None), ("3", None, None), ("4", "Na", " 4 "),
    ]


def test_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review_id,text,stars\n1,good,5\n")
    (tmp_path / "b.csv").write_text("stars,text,review_id\n2,bad place,7\n")
    (tmp_path / "c.csv").write_text("text,review_id\nno rating,9\n")
    rows = read_reviews(spark, str(tmp_path)).select("review_id", "text", "stars").collect()
    assert sorted(map(tuple, rows)) == [("1", "good", "5"), ("7", "bad place", "2"), ("9", "no rating", None)]


def test_training_file_choice(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        resolve_training_file(spark, str(tmp_path))
    for name in ("b.csv", "a.csv", "0.txt"):
        (tmp_path / name).write_text("text,stars\nx,5\n")
    assert resolve_training_file(spark, str(tmp_path)).endswith("/a.csv")
    (tmp_path / "training_testing_data.csv").write_text("text,stars\nfixed,1\n")
    assert read_training(spark, str(tmp_path)).first()["text"] == "fixed"


def test_shared_dir(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert run_dir(spark).startswith(shared_dir(spark))


def extraction_input(spark, n=47):
    return spark.range(0, n, 1, 4).select(
        F.concat(F.lit("r"), "id").alias("review_id"), "id",
        F.when(F.col("id") != 5, F.concat(F.lit("text "), "id")).alias("clean_text"),
    )


def replies_of(theme, log=None, fail=None):
    def ask(prompt):
        import json
        import re

        numbers = re.findall(r"^Review (\d+):$", prompt, flags=re.M)
        if log:
            with open(log, "a") as f:
                f.write(f"{len(numbers)}\n")
        if fail and fail in prompt:
            raise RuntimeError(fail)
        return json.dumps({n: [theme] for n in numbers})

    return ask


def test_extract_themes(spark, tmp_path):
    log = str(tmp_path / "calls")
    out = th.extract_themes(extraction_input(spark), replies_of(THEMES[3].upper(), log), pause=0)
    rows = out.collect()
    assert len(rows) == 47 and {r["themes"] for r in rows} == {THEMES[3]}
    assert out.columns == ["review_id", "id", "clean_text", "themes"]
    out.count()
    assert sorted(open(log).read().split()) == ["10"] * 4 + ["7"]


def test_failing_batch_is_asked_again_and_dropped(spark, tmp_path):
    log = str(tmp_path / "calls")
    ask = replies_of(THEMES[0], log, fail="text 12\n")
    out = th.extract_themes(extraction_input(spark), ask, attempts=3, pause=0)
    assert sorted(r["id"] for r in out.collect()) == [i for i in range(47) if not 10 <= i < 20]
    assert len(open(log).read().split()) == 5 + 2
    kept = th.extract_themes(extraction_input(spark), ask, attempts=1, keep_failed=True)
    assert th.failed_count(kept).first()["dropped"] == 10


def test_batch_recovers_on_a_later_attempt(spark, tmp_path):
    log = str(tmp_path / "calls")

    def ask(prompt):
        import json
        import os
        import re

        numbers = re.findall(r"^Review (\d+):$", prompt, flags=re.M)
        first = not os.path.exists(log)
        open(log, "a").close()
        return "no idea" if first else json.dumps({n: "customer service" for n in numbers})

    out = th.extract_themes(extraction_input(spark), ask, pause=0, parallel_calls=1)
    assert out.count() == 47


def test_prompt(spark):
    df = extraction_input(spark, 12).withColumn(
        "clean_text", F.when(F.col("id") == 0, F.repeat(F.lit("é"), 300)).otherwise(F.col("clean_text"))
    )
    prompts = th.batch_prompts(th.with_batches(df)).orderBy("batch_id").collect()
    assert [p["size"] for p in prompts] == [10, 2]
    first = prompts[0]["prompt"]
    assert "Review 1:\n" + "é" * 250 + "\nReview 2:\ntext 1\n" in first
    assert "Review 6:\n\nReview 7:" in first and all(t in first for t in THEMES)
    own = th.batch_prompts(th.with_batches(df), ["x"], "{size} of {themes}: {reviews}")
    assert own.filter("batch_id = 1").first()["prompt"] == "2 of x: Review 1:\ntext 10\nReview 2:\ntext 11"


@pytest.mark.parametrize("before", [0, 245, 250, 5000])
def test_extraction_uses_whole_texts(spark, before):
    """What decides a theme, or makes a call fail, may stand anywhere in a text."""
    from registry.themes import _model

    word = F.when(F.col("id") % 3 == 0, "slow").when(F.col("id") == 13, "dirty").otherwise("fine")
    df = extraction_input(spark).withColumn("clean_text", F.concat(F.repeat(F.lit("é"), before), F.lit(" "), word))
    df = df.withColumn("clean_text", F.when(F.col("id") != 5, F.col("clean_text")))
    out = th.extract_themes(df, _model("dirty"), attempts=1, keep_failed=True, order_by=["id"])
    assert {r["id"]: r["themes"] for r in out.collect()} == {
        i: "FAILED" if 10 <= i < 20 else "Product Quality" if i % 3 else "Speed of Service" for i in range(47)
    }


def test_insights(spark, sf_dir):
    def ask(prompt):
        return "INSIGHTS:\n- **queue**\nRELEVANT_IDS:\n[2, 0, 2]"

    df = scored(spark, sf_dir)
    found, cited = ins.insights(df, ask)
    pairs = df.filter("themes is not null").count()
    assert pairs and found.filter("sentiment = 'All'").count() == 8
    assert {r["insights"] for r in found.collect()} == {"- **queue**"}
    one = cited.filter("Theme = 'Price and Value' and sentiment = 'negative'").orderBy("citation")
    assert [(r["citation"], r["position"], r["predicted_sentiment"]) for r in one.collect()] == [
        (1, 2, "negative"), (2, 0, "negative"),
    ]
    text = insight_sections(found).first()
    assert text["title"].startswith("Insights: ") and text["text"] == "- queue"
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        ins.insights(df, lambda prompt: 1 / 0)


def test_report_bundle(spark, sf_dir):
    df = scored(spark, sf_dir)
    tables = report_bundle(df)
    assert list(tables) == [
        "key_figures", "sentiment_shares", "confidence_boxes", "raw_output", "monthly_sentiment",
        "top_themes", "theme_sentiment", "theme_table", "monthly_themes", "matching_reviews",
    ]
    assert all(t.count() for t in tables.values())
    assert list(report_bundle(df, [TOP, SUMMARY]))[0] == "top_themes"
    dated = df.filter("date is not null").count()
    assert tables["sentiment_shares"].agg(F.sum("count")).first()[0] == dated < df.count()
    some = report_bundle(df, [TOP], start="1997-01-01", end="1997-12-31")["top_themes"]
    assert some.agg(F.sum("count")).first()[0] < tables["top_themes"].agg(F.sum("count")).first()[0]
    for pattern in ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy"):
        text_dates = report_bundle(df.withColumn("date", F.date_format("date", pattern)))
        assert list(text_dates) == list(tables)
        for name in ("monthly_sentiment", "monthly_themes"):
            assert text_dates[name].exceptAll(tables[name]).isEmpty()
    with pytest.warns(UserWarning, match="no dates"):
        unread = report_bundle(df.withColumn("date", F.lit("some day")))
    assert "monthly_sentiment" not in unread and len(unread) == 8
    assert unread["sentiment_shares"].agg(F.sum("count")).first()[0] == df.count()
    bare = df.select("predicted_sentiment", "clean_text", "review_id")
    assert list(report_bundle(bare, SECTIONS)) == ["key_figures", "sentiment_shares", "raw_output"]
    with pytest.raises(ValueError):
        report_bundle(df, ["Weather"])


def test_extraction_is_skipped_where_done(spark):
    df = extraction_input(spark, 5).withColumn("themes", F.lit("a"))
    assert themed_reviews(df, None) is df
    failed = df.withColumn("themes", F.lit("FAILED"))
    out = themed_reviews(failed, replies_of(THEMES[1]), pause=0)
    assert {r["themes"] for r in out.collect()} == {THEMES[1]} and out.columns.count("themes") == 1


def test_missing_ids_are_filled(spark, sf_dir):
    from opinara.operators.model import train
    from opinara.plans.score import score
    from registry.core import reviews

    model = train(reviews(spark, sf_dir), max_terms=50).model
    df = spark.createDataFrame([("x", "a"), (None, "b")], "review_id string, text string").coalesce(1)
    assert sorted(r["review_id"] for r in score(df, model, fill_ids=True).collect()) == ["review_1", "x"]


def test_command_line(spark, sf_dir, tmp_path, monkeypatch):
    training, source = tmp_path / "training", tmp_path / "in.csv"
    training.mkdir()
    lines = [f'"{w} coffee number {i % 9}",{s}' for i in range(60) for w, s in
             (("great", 5), ("awful", 1), ("plain", 3))]
    (training / "t.csv").write_text("text,stars\n" + "\n".join(lines) + "\n")
    source.write_text('text,date\n"Great\ncoffee",2024-01-01\nAWFUL coffee,\n')
    options = ["--input", source, "--model", tmp_path / "model", "--output", tmp_path / "out",
               "--training", training]
    monkeypatch.setattr(sys, "argv", ["opinara", *map(str, options)])
    cli.main()
    rows = {r["review_id"]: r["predicted_sentiment"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"review_0": "positive", "review_1": "negative"}
