"""Replies kept between jobs, and calls that hang."""

import time

from pyspark.sql import functions as F

from opinara.operators import themes as th
from opinara.operators.reply_store import ReplyStore


def counting(path, bad=()):
    """A model that notes each prompt it is asked."""

    def ask(prompt):
        with open(path, "a") as calls:
            calls.write(f"{prompt}\n")
        if prompt in bad:
            raise ValueError("no")
        return f"to {prompt}"

    return ask


def calls(path):
    return sorted(path.read_text().split()) if path.exists() else []


def test_nothing_is_paid_twice(spark, tmp_path):
    log = tmp_path / "calls"
    prompts = spark.createDataFrame([(i, f"p{i % 7}", "x") for i in range(40)], "batch_id long, prompt string, digest string")
    store = ReplyStore(spark, str(tmp_path / "one" / "store"), 4)
    first = store.replies(prompts, counting(log, ("p3",)))
    assert first.columns == ["batch_id", "prompt", "digest", "raw", "error"] and first.count() == 40
    assert first.filter("prompt <> 'p3' AND (raw <> 'to ' || prompt OR error IS NOT NULL)").count() == 0
    assert first.filter("prompt = 'p3' AND raw IS NULL AND error = 'ValueError: no'").count() == 6
    assert calls(log) == [f"p{i}" for i in range(7)]
    again = ReplyStore(spark, str(tmp_path / "one" / "store"), 4).replies(prompts, counting(log))
    assert calls(log) == sorted([*(f"p{i}" for i in range(7)), "p3"])
    assert again.filter("raw = 'to ' || prompt AND error IS NULL").count() == 40
    assert store.replies(prompts.limit(0), counting(log)).count() == 0 and len(calls(log)) == 8
    # Another attempt and another store are questions of their own.
    store.replies(prompts, counting(log), attempt=1)
    assert len(calls(log)) == 15
    other = ReplyStore(spark, str(tmp_path / "two" / "store"), 4)
    assert other.known().count() == 0


def test_second_extraction_makes_no_calls(spark, tmp_path):
    log = tmp_path / "calls"
    reviews = spark.range(0, 45, 1, 3).select(F.col("id").cast("string").alias("review_id"), F.lit("Slow app").alias("clean_text"), F.lit("negative").alias("predicted_sentiment"), "id")
    names = ", ".join(f'"{i}": ["Price and Value"]' for i in range(1, 11))

    def ask(prompt):
        with open(log, "a") as noted:
            noted.write("call\n")
        return "{" + names + "}"

    store = ReplyStore(spark, str(tmp_path / "store"), 4)
    first = th.extract_themes(reviews, ask, order_by=["id"], store=store)
    # Four batches of ten equal texts are one prompt; the last, of five, is another.
    assert first.count() == 45 and len(calls(log)) == 2
    again = th.extract_themes(reviews, ask, order_by=["id"], store=store)
    assert again.count() == 45 and len(calls(log)) == 2


def test_a_hanging_call_is_an_error(spark):
    prompts = spark.createDataFrame([(i, "slow" if i == 2 else "fast") for i in range(5)], "batch_id long, prompt string")

    def ask(prompt):
        time.sleep(60 if prompt == "slow" else 0)
        return prompt

    begun = time.time()
    rows = {r["batch_id"]: r for r in th.written_replies(prompts, ask, seconds=1.0).collect()}
    assert time.time() - begun < 40
    assert rows[2]["raw"] is None and rows[2]["error"] == "TimeoutError: no reply in 1 s"
    assert all(rows[i]["raw"] == "fast" and rows[i]["error"] is None for i in (0, 1, 3, 4))
