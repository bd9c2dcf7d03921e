"""Theme extraction around a model call: prompts, calls, validation, attaching results."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opinara.functions.replies import (
    all_have_themes,
    json_span,
    literal_objects,
    native_objects,
    reply_entries,
    themes_by_position,
)
from opinara.functions.themes import is_failed, joined_themes, named_themes
from opinara.operators.filters import without_failed
from opinara.operators.ranking import BATCH_SIZE, with_batches
from opinara.session import pin
from opinara.vocab import FAILED, THEMES

# Characters of an excerpt of a review (extraction shows all of it), attempts, seconds
# between them, calls at a time.
REVIEW_CHARS = 250
ATTEMPTS = 5
PAUSE = 2.0
PARALLEL_CALLS = 2

# Calls of a task, which are lost with it, and tasks of a job. Of more calls than these make, each task
# takes more, as a task and its file cost as much as thousands of quick calls. A core has TASKS_PER_CORE
# of them, so that a lost one is a small part of its work, but a job has up to MANY_TASKS whatever
# cores there are as it begins, and never over MOST_TASKS.
CALLS_PER_TASK = 500
TASKS_PER_CORE = 16
MANY_TASKS = 256
MOST_TASKS = 2000
# Fixed value: seconds that a model call may take.
CALL_SECONDS = 180.0
# Seconds after which a call is taken to wait for its reply, so that another thread is of use.
WAITING_SECONDS = 0.005

_LOG = logging.getLogger(__name__)

THEME_INSTRUCTIONS = """Sort customer reviews into themes.
Use these themes only: {themes}
Give each of the {size} reviews at least one theme, the closest one if unsure.
Answer with one JSON object and nothing else. Its {size} keys are the review numbers as
strings, its values are lists of themes, for example {"1": ["{example}"]}.

{reviews}
"""


def review_excerpt(text: Column, chars: int | None = REVIEW_CHARS) -> Column:
    """What the model sees of a review: its first characters, or with None all of it, never null."""
    whole = F.coalesce(text, F.lit(""))
    return whole if chars is None else F.substring(whole, 1, chars)


def batch_prompts(
    batches: DataFrame, themes: Sequence[str] = THEMES, template: str = THEME_INSTRUCTIONS,
    chars: int | None = REVIEW_CHARS,
) -> DataFrame:
    """One prompt per batch: (batch_id, size, prompt).

    A batch holds at most the batch size, so the collected list is short. The template names
    {themes}, {size}, {example} and {reviews}. Of each review it shows the first `chars`
    characters, with None all of them.
    """
    entry = F.struct("position", review_excerpt(F.col("clean_text"), chars).alias("text"))
    grouped = batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).cast("int").alias("size"), F.collect_list(entry).alias("entries")
    )
    numbered = F.transform(
        F.array_sort("entries"),
        lambda e: F.concat(F.lit("Review "), e["position"].cast("string"), F.lit(":\n"), e["text"]),
    )
    fixed = template.replace("{themes}", ", ".join(themes)).replace("{example}", themes[0])
    head, tail = fixed.split("{reviews}")

    def sized(text: str) -> Column:
        return F.replace(F.lit(text), F.lit("{size}"), F.col("size").cast("string"))

    prompt = F.concat(sized(head), F.array_join(numbered, "\n"), sized(tail))
    return grouped.select("batch_id", "size", prompt.alias("prompt"))


def _replies(
    prompts: list, ask: Callable[[str], str], parallel_calls: int, seconds: float | None
) -> list[tuple[str | None, str | None]]:
    """Reply and error of each prompt, asked by up to `parallel_calls` threads that take one after the other.

    A thread of its own for each call costs more than a quick call. So only a thread whose call takes
    longer than `seconds` is left alone, and a new one goes on in its place. Threads that do not wait
    get in each other's way, so another one starts only as all calls under way wait for their replies.
    """
    from collections import deque
    from threading import Condition, Thread
    from time import monotonic

    late = (None, f"TimeoutError: no reply in {seconds:g} s") if seconds is not None else (None, None)
    out = [late] * len(prompts)
    todo = deque(range(len(prompts)))
    # The call that each thread is busy with, and when it began.
    busy = {}
    state = Condition()

    def work(own):
        while True:
            with state:
                if own not in busy:
                    return
                if not todo:
                    del busy[own]
                    state.notify_all()
                    return
                i = todo.popleft()
                busy[own] = i, monotonic()
            try:
                found = (ask(prompts[i]), None)
            except Exception as error:
                found = (None, f"{type(error).__name__}: {error}")
            except BaseException:
                found = late
            with state:
                if own in busy:
                    out[i] = found

    def start():
        own = object()
        busy[own] = None, monotonic()
        # It does not keep the process alive if a call hangs.
        Thread(target=work, args=(own,), daemon=True).start()

    with state:
        if todo and parallel_calls > 0:
            start()
        while busy:
            now = monotonic()
            if seconds is not None:
                for own in [o for o, (i, since) in busy.items() if i is not None and now - since >= seconds]:
                    del busy[own]
                    if todo:
                        start()
            pause = None
            if busy and seconds is not None:
                pause = max(0.001, min(since for _, since in busy.values()) + seconds - now)
            if busy and todo and len(busy) < parallel_calls:
                if all(i is not None and now - since >= WAITING_SECONDS for i, since in busy.values()):
                    start()
                pause = WAITING_SECONDS
            if busy:
                state.wait(pause)
    return out


def ask_model(
    prompts: DataFrame,
    ask: Callable[[str], str],
    parallel_calls: int = PARALLEL_CALLS,
    calls_per_task: int = CALLS_PER_TASK,
    seconds: float | None = CALL_SECONDS,
) -> DataFrame:
    """Add `raw`, the reply of `ask(prompt)`, and `error`, what it raised in its place.

    One job, whose tasks make about `calls_per_task` calls each (more, if that would be over
    TASKS_PER_CORE tasks for each core, or MOST_TASKS), up to `parallel_calls` of them at a time; how
    many tasks run at a time is the cluster's matter. A call that takes longer than
    `seconds` is left alone and has an error, so that none holds its task for ever. Replies are
    not repeatable: write the result before using it twice.
    """
    columns = prompts.columns
    cores = prompts.sparkSession.sparkContext.defaultParallelism
    most = min(MOST_TASKS, max(MANY_TASKS, TASKS_PER_CORE * cores))
    tasks = max(1, min(most, math.ceil(prompts.count() / calls_per_task)))

    def call(frames):
        for frame in frames:
            replies = _replies(frame["prompt"].tolist(), ask, parallel_calls, seconds)
            frame = frame.assign(raw=[r for r, _ in replies], error=[e for _, e in replies])
            yield frame[[*columns, "raw", "error"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", raw string, error string"
    return prompts.repartition(tasks).mapInPandas(call, schema)


def failed_calls(replies: DataFrame) -> DataFrame:
    """Calls that raised, counted by (error)."""
    return replies.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("calls"))


def written_replies(
    prompts: DataFrame,
    ask: Callable[[str], str],
    parallel_calls: int = PARALLEL_CALLS,
    calls_per_task: int = CALLS_PER_TASK,
    seconds: float | None = CALL_SECONDS,
) -> DataFrame:
    """Ask for every prompt and write the replies, each task its own part once.

    A lost executor costs the calls of its running tasks, no more. Failed calls are logged. With a
    `reply_store.ReplyStore` in place of this, a job that is run again pays nothing twice.
    """
    replies = pin(ask_model(prompts, ask, parallel_calls, calls_per_task, seconds), "replies")
    found = _failures(replies)
    if found["failed"]:
        _LOG.warning("%d of %d model calls failed, such as %s", found["failed"], found["calls"], found["error"])
    return replies


def _failures(replies: DataFrame):
    kind = F.substring_index("error", ":", 1)
    return replies.agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), F.min("error").alias("error"),
        (F.min(kind) == F.max(kind)).alias("one_kind"),
    ).first()


def raise_outage(replies: DataFrame) -> None:
    """Raise if every call failed with one type of error: that is no matter of single replies."""
    found = _failures(replies)
    if found["calls"] and found["failed"] == found["calls"] and found["one_kind"]:
        raise RuntimeError(f"all {found['calls']} model calls failed: {found['error']}")


def parsed_replies(
    replies: DataFrame, themes: Sequence[str] = THEMES, strict: bool = False
) -> DataFrame:
    """Validate replies (batch_id, size, raw): adds `by_position` and `ok`.

    `by_position` holds the allowed themes of each review of the batch. Reading and checking
    are per-row array expressions; no reply is shuffled.
    """
    span = json_span(F.col("raw"))
    native = native_objects(F.col("_span"), strict)
    unread = F.when(F.col("_native").isNull(), F.col("_span"))
    literal = F.from_json("_literal", "array<map<string,string>>")
    return (
        replies.withColumn("_span", span)
        .withColumn("_native", native)
        .withColumn("_literal", literal_objects(unread, strict))
        .withColumn("_entries", reply_entries(F.coalesce("_native", literal)))
        .withColumn(
            "by_position",
            themes_by_position(F.col("_entries"), F.col("size").cast("int"), themes),
        )
        .withColumn("ok", F.col("_entries").isNotNull() & all_have_themes(F.col("by_position")))
        .drop("_span", "_native", "_literal", "_entries")
    )


def review_themes(parsed: DataFrame) -> DataFrame:
    """(batch_id, position, themes) per review; all of a failed batch carry the marker."""
    positions = F.sequence(F.lit(1), F.col("size").cast("int"))
    names = joined_themes(F.get("by_position", F.col("position") - 1))
    return parsed.withColumn("position", F.explode(positions)).select(
        "batch_id", "position", F.when(F.col("ok"), names).otherwise(FAILED).alias("themes")
    )


def attach_themes(reviews: DataFrame, themes: DataFrame, on: list[str]) -> DataFrame:
    """Give every review its themes; one without a result counts as failed.

    Both sides have a row per review, and files of equal replies are far smaller than their rows. So
    the join is a sort-merge join, which Spark would not choose by the size of the files.
    """
    joined = reviews.drop("themes").join(themes.select(*on, "themes").hint("merge"), on, "left")
    return joined.withColumn("themes", F.coalesce("themes", F.lit(FAILED)))


def failed_count(df: DataFrame) -> DataFrame:
    """Number of reviews that extraction drops."""
    return df.agg(F.count_if(is_failed(F.col("themes"))).alias("dropped"))


def explode_themes(df: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per review and theme, as `Theme`, for reviews that have a prediction.

    A theme that a review names twice counts twice, unless `distinct`.
    """
    names = named_themes(F.col("themes"))
    if distinct:
        names = F.array_distinct(names)
    # The outer explode keeps Spark from computing the array again to test it for emptiness.
    exploded = df.filter(F.col("predicted_sentiment").isNotNull()).withColumn(
        "Theme", F.explode_outer(names)
    )
    return exploded.filter(F.col("Theme").isNotNull())


def _log_dropped(pending: DataFrame) -> None:
    dropped = pending.agg(F.sum("size").alias("n")).first()["n"]
    if dropped:
        _LOG.warning("%d reviews are left without themes, as their batches failed", dropped)


def extract_themes(
    reviews: DataFrame,
    ask: Callable[[str], str],
    themes: Sequence[str] = THEMES,
    batch_size: int = BATCH_SIZE,
    attempts: int = ATTEMPTS,
    pause: float = PAUSE,
    parallel_calls: int = PARALLEL_CALLS,
    strict: bool = False,
    keep_failed: bool = False,
    order_by: Sequence[str] | None = None,
    store=None,
) -> DataFrame:
    """Assign themes through `ask` and drop the reviews whose batch failed every attempt.

    The prompts hold the whole text of every review.
    With a `ReplyStore` as `store`, prompts that it has replies for are not asked again.

    Each attempt asks again only for the batches that failed so far. Its replies are written
    before they are read, so a lost executor never repeats a finished attempt. How many reviews
    failed is logged, and if no call ever answers, this raises; `failed_count` tells it of a result with `keep_failed`. `order_by` makes
    batches of consecutive rows; without it, of the rows as they are read.
    """
    batches = with_batches(reviews, batch_size, order_by)
    prompts = pin(batch_prompts(batches, themes, chars=None), "prompts")
    done = None
    pending = prompts
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause)
        if store is None:
            replies = written_replies(pending, ask, parallel_calls)
        else:
            replies = store.replies(pending, ask, parallel_calls, attempt)
        parsed = parsed_replies(replies, themes, strict).drop("raw", "error")
        # A failed batch keeps its prompt, so that the next attempt needs no join.
        parsed = pin(parsed.withColumn("prompt", F.when(~F.col("ok"), F.col("prompt"))), "parsed")
        good = parsed.filter("ok").drop("prompt")
        done = good if done is None else done.unionByName(good)
        pending = parsed.filter("NOT ok").select(*prompts.columns)
        if pending.isEmpty():
            break
    keys = ["batch_id", "position"]
    if done.isEmpty():
        raise_outage(replies)
    _log_dropped(pending)
    themed = attach_themes(batches, review_themes(done), keys).drop(*keys, "row_index")
    return themed if keep_failed else without_failed(themed)
