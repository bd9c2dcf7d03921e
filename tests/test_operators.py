"""DataFrame operators against brute force on small frames."""

import datetime as dt
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinara.operators import analytics as a, filters, insights as ins, prepare, ranking, themes as th
from opinara.session import pin
from opinara.vocab import THEMES


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_text_column_choice(spark):
    df = frame(spark, [("A", None, "C")], "text string, clean_text string, raw_text string")
    assert prepare.with_clean_text(df).first()["clean_text"] == ""
    assert prepare.with_clean_text(df, keep_existing=True).first()["clean_text"] is None
    assert prepare.with_clean_text(df.drop("clean_text")).first()["clean_text"] == "a"
    assert prepare.with_clean_text(df.select("raw_text")).first()["clean_text"] == "c"
    with pytest.raises(ValueError):
        prepare.with_clean_text(df.select(F.lit(1).alias("x")))


def test_review_ids(spark):
    df = spark.range(0, 25, 1, 4).select(F.concat(F.lit("t"), "id").alias("text"))
    ids = {r["text"]: r["review_id"] for r in prepare.with_review_id(df).collect()}
    assert ids == {f"t{i}": f"review_{i}" for i in range(25)}
    given = frame(spark, [("x", 1), (None, 2)], "review_id string, n int").coalesce(1)
    assert prepare.with_review_id(given) is given
    filled = prepare.with_review_id(given, ["n"], fill_null=True).orderBy("n").collect()
    assert [r["review_id"] for r in filled] == ["x", "review_1"]


def test_given_label_wins(spark):
    df = frame(spark, [("neutral", "5"), (None, "1")], "sentiment string, stars string")
    assert [r[0] for r in prepare.with_sentiment(df).select("sentiment").collect()] == ["neutral", None]
    assert prepare.labelled(df).count() == 1


def test_dates(spark):
    texts = ["2024-01-31 10:00:00", "2024-02-03", "31.01.2024", "soon", None]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, date string")

    def read(**options):
        out = prepare.parse_dates(df, **options).orderBy("i").collect()
        return [r["date"] for r in out]

    first, second = dt.datetime(2024, 1, 31, 10), dt.datetime(2024, 2, 3)
    assert read(on_invalid="null", formats=()) == [first, second, None, None, None]
    assert read(on_invalid="null") == [first, second, dt.datetime(2024, 1, 31), None, None]
    with pytest.warns(UserWarning):
        assert read() == texts
    with pytest.warns(UserWarning):
        assert not filters.has_dates(prepare.parse_dates(df, on_invalid="disable"))
    with pytest.raises(TypeError):
        filters.date_range(df, "2024-01-01")
    for written in (["1/31/2024", "2/3/2024"], ["31/1/2024", "3/2/2024"], ["31.1.2024", "3.2.2024"],
                    ["Jan 31, 2024", "Feb 3, 2024"], [" 2024-01-31", "2024-02-03 "]):
        usual = prepare.parse_dates(frame(spark, [(1, t) for t in [*written, None]], "i int, date string"))
        assert [r["date"] for r in usual.collect()] == [dt.datetime(2024, 1, 31), second, None]
    clean = prepare.parse_dates(df.filter("i < 2"), on_invalid="disable")
    assert filters.has_dates(clean) and clean.filter("date is null").count() == 0
    with pytest.raises(ValueError):
        prepare.parse_dates(df, on_invalid="x")


def test_date_range(spark):
    rows = [("2024-01-01 00:00:00",), ("2024-01-31 23:59:59",), ("2024-02-01 00:00:00",), (None,)]
    df = frame(spark, rows, "date string").withColumn("date", F.col("date").cast("timestamp_ntz"))
    assert filters.date_range(df, "2024-01-01", dt.date(2024, 1, 31)).count() == 2
    with pytest.raises(ValueError):
        filters.date_range(df, "2024-02-01", "2024-01-31")
    assert filters.date_range(df, "2024-02-01", "2024-01-31", on_invalid="ignore").count() == 4
    assert filters.date_range(df).count() == 3
    assert filters.date_range(df, start="2024-01-31").count() == 2
    summary = a.filter_summary(df, "2024-01-01", "2024-01-31").first()
    assert tuple(summary) == (4, 2, "Filtered: 2 of 4 reviews")
    dates = df.withColumn("date", F.col("date").cast("date"))
    assert filters.date_range(dates, "2024-01-31", "2024-02-01").count() == 2


def test_already_themed(spark):
    df = frame(spark, [("FAILED",), ("FAILED (ERROR)",)], "themes string")
    assert not filters.has_themes(df)
    assert filters.has_themes(df.union(frame(spark, [("x",)], "themes string")))
    assert not filters.has_themes(df.select(F.lit(1).alias("x")))


def test_monthly_and_empty(spark):
    rows = [("2024-01-31 10:00:00", "p"), ("2024-02-03 00:00:00", "p"), (None, "p"), ("2024-02-05 00:00:00", None)]
    df = frame(spark, rows, "date string, predicted_sentiment string").withColumn(
        "date", F.col("date").cast("timestamp_ntz")
    )
    got = {(str(r["date"]), r["count"]) for r in a.monthly_sentiment(df).collect()}
    assert got == {("2024-01-31", 1), ("2024-02-29", 1)}
    assert a.enough_to_plot(a.monthly_sentiment(df))
    assert not a.enough_to_plot(a.monthly_sentiment(df.limit(0)))
    scored = df.select(F.lit(0.5).alias("confidence"), F.lit(True).alias("is_mixed"))
    assert tuple(a.key_figures(scored.limit(0)).first()) == (0, None, None)


def test_percent_half_even(spark):
    rows = [("a", 1, 15, 0), ("b", 5, 795, 0), ("c", 25, 9975, 0)]
    df = frame(spark, rows, "Theme string, positive long, negative long, middle long")
    table = df.withColumnRenamed("middle", "neutral/mixed").withColumn(
        "Total", F.col("positive") + F.col("negative")
    )
    out = a.with_percent(table).orderBy("Theme")
    assert out.columns == [
        "Theme", "positive", "positive (%)", "negative", "negative (%)", "neutral/mixed",
        "neutral/mixed (%)", "Total",
    ]
    assert [r["positive (%)"] for r in out.collect()] == [6.2, 0.6, 0.2]


def themed(spark, n=3000, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        names = rng.choices([*THEMES, "FAILED", "", "NOT PROCESSED"], [60] + [3] * 10, k=rng.randint(0, 3))
        rows.append((f"r{i}", rng.choice(["positive", "negative", "neutral/mixed", None]),
                     ", ".join(names) if names else None, f"text {i}" if i % 7 else None))
    return rows, spark.createDataFrame(
        rows, "review_id string, predicted_sentiment string, themes string, clean_text string"
    ).repartition(6)


def valid(themes):
    return [t for t in (themes or "").split(", ") if t in THEMES]


def test_explode_crosstab_and_matches(spark):
    rows, df = themed(spark)
    exploded = th.explode_themes(df)
    pairs = [(t, s) for _, s, themes, _ in rows if s for t in valid(themes)]
    assert exploded.count() == len(pairs)
    table = {r["Theme"]: r["Total"] for r in a.crosstab(exploded).collect()}
    assert table == Counter(t for t, _ in pairs)
    counts = {(r["Theme"], r["sentiment"]): r["reviews"] for r in a.matching_reviews(df).collect()}
    want = Counter()
    for _, s, themes, _ in rows:
        for t in set(valid(themes)) if s else ():
            want[t, s] += 1
            want[t, "All"] += 1
    assert counts == want
    for theme, sentiment in [(THEMES[0], "All"), (THEMES[2], "negative")]:
        assert filters.drill_down(df, theme, sentiment).count() == want[theme, sentiment]
        matches = filters.of_sentiment(filters.of_theme(exploded, theme), sentiment)
        assert filters.reviews_matching(df, matches).count() == want[theme, sentiment]


def test_total_row_leaves_out_unseen_classes(spark):
    rows = [("1", "positive", "x"), ("2", "negative", None), ("3", "positive", None)]
    df = frame(spark, rows, "review_id string, predicted_sentiment string, themes string")
    out = a.theme_table(th.explode_themes(df), df).orderBy("Theme").collect()
    assert [(r["Theme"], r["positive"], r["Total"]) for r in out] == [("Total Raw Reviews", 2, 2), ("x", 1, 1)]
    assert "negative" not in out[0].asDict()
    assert a.theme_table(th.explode_themes(df.limit(0)), df).collect() == [("Total Raw Reviews", 0)]


def test_cubes_give_the_same_tables(spark):
    _, df = themed(spark)
    df = df.withColumn("date", F.expr("timestamp_ntz'2024-01-05' + make_interval(0, 0, 0, cast(substr(review_id, 2) as int) % 200)"))
    exploded = th.explode_themes(df)
    small, themes_small = a.sentiment_cube(df), a.theme_cube(exploded)

    def same(left, right):
        assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))

    same(a.sentiment_counts(df), a.sentiment_counts(small, "n"))
    same(a.monthly_sentiment(df), a.monthly_sentiment(small, "month", "n"))
    same(a.monthly_themes(exploded), a.monthly_themes(themes_small, "month", "n"))
    same(a.top_themes(exploded), a.top_themes(themes_small, weight="n"))
    same(a.theme_table(exploded, df), a.theme_table(themes_small, small, weight="n"))


def test_row_index_with_hot_key(spark):
    df = spark.range(0, 9000, 1, 7).select(
        "id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("k")
    )
    out = ranking.with_row_index(df, "i", ["k"]).select("i", "k").orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(9000))
    assert [r["k"] for r in out] == sorted(r["k"] for r in out)
    shuffled = df.repartition(5, "id")
    again = ranking.with_row_index(pin(shuffled, "rows"), "i", ["k"]).select("i", "k").orderBy("i")
    assert again.collect() == out
    as_read = ranking.with_row_index(df, "i")
    assert as_read.filter("i <> id").count() == 0


def test_batches(spark):
    out = ranking.with_batches(spark.range(0, 95, 1, 8), 10).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("position")).alias("p")
    ).orderBy("batch_id").collect()
    assert [r["n"] for r in out] == [10] * 9 + [5]
    assert out[0]["p"] == list(range(1, 11))


def test_top_k_with_hot_group(spark):
    df = spark.range(0, 6000, 1, 6).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("g")
    )
    out = ranking.top_k_per_group(df, ["g"], ["id"], 50)
    hot = out.filter("g = 'hot'").orderBy("rank").collect()
    assert [r["id"] for r in hot] == [i for i in range(6000) if i % 10 < 8][:50]
    assert [r["rank"] for r in hot] == list(range(1, 51))
    assert out.count() == 50 + 1200


def test_samples(spark):
    rows, df = themed(spark)
    samples = ins.insight_samples(df, 50)
    got = Counter((r["Theme"], r["sentiment"]) for r in samples.collect())
    want = Counter()
    for _, s, themes, text in rows:
        for t in set(valid(themes)) if s and text else ():
            want[t, s] += 1
            want[t, "All"] += 1
    assert got == {g: min(n, 50) for g, n in want.items()}
    assert samples.filter("clean_text is null").count() == 0
    again = ins.insight_samples(df.repartition(3), 50)
    key = lambda frame: sorted((r["Theme"], r["sentiment"], r["position"], r["review_id"]) for r in frame.collect())
    assert key(samples) == key(again)
    assert key(samples) != key(ins.insight_samples(df, 50, seed=1))


def test_replies_in_bounded_tasks(spark):
    prompts = spark.range(0, 100, 1, 4).select(
        F.col("id").alias("batch_id"), F.lit(1).alias("size"), F.col("id").cast("string").alias("prompt")
    )
    out = th.written_replies(prompts, lambda p: f"re {p}", parallel_calls=2, calls_per_task=7)
    assert len([p for p in out.inputFiles()]) > 2
    assert sorted((r["batch_id"], r["raw"]) for r in out.collect()) == [(i, f"re {i}") for i in range(100)]


def test_themes_of_reviews_are_not_broadcast(spark):
    """Equal themes make small files, whatever the number of reviews."""
    keyed = pin(spark.range(0, 1000, 1, 2).selectExpr("id AS batch_id", "1 AS position"), "keyed")
    themes = pin(keyed.filter("batch_id > 0").withColumn("themes", F.lit("a")), "themes")
    out = th.attach_themes(keyed, themes, ["batch_id", "position"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["themes"]: r["count"] for r in out.groupBy("themes").count().collect()} == {"a": 999, "FAILED": 1}


def test_tasks_and_threads_of_many_calls(spark, monkeypatch):
    def ask(prompt):
        import threading

        return threading.current_thread().name

    prompts = spark.range(0, 90, 1, 4).select(F.col("id").cast("string").alias("prompt"))
    monkeypatch.setattr(th, "MOST_TASKS", 3)
    out = th.written_replies(prompts, ask, parallel_calls=2, calls_per_task=5)
    assert out.count() == 90 and out.filter("raw IS NULL").isEmpty()
    assert len(out.inputFiles()) <= 3
    alone = th.written_replies(prompts, ask, parallel_calls=2, calls_per_task=90)
    assert alone.count() == 90 and alone.select("raw").distinct().count() <= 2


def test_tasks_of_calls_by_cores(spark, monkeypatch):
    """Few cores get no more tasks than keep them busy; each task costs as much as many quick calls."""
    prompts = spark.range(0, 900, 1, 4).select(F.col("id").cast("string").alias("prompt"))
    monkeypatch.setattr(th, "MANY_TASKS", 4)
    monkeypatch.setattr(th, "TASKS_PER_CORE", 1)
    out = th.written_replies(prompts, str, parallel_calls=2, calls_per_task=5)
    assert sorted(int(r["raw"]) for r in out.collect()) == [*range(900)]
    assert len(out.inputFiles()) <= max(4, spark.sparkContext.defaultParallelism)


def test_threads_start_as_calls_wait():
    import threading

    def name(prompt):
        return threading.current_thread().name

    # Calls that do not wait leave a thread or two; eight made each of them take several times as long.
    quick = th._replies(["x"] * 20000, name, 8, 180.0)
    assert len(quick) == 20000 and all(raw and error is None for raw, error in quick)
    assert len({raw for raw, _ in quick}) <= 4

    together = threading.Barrier(6)

    def wait(prompt):
        return f"{prompt} {together.wait(30) >= 0}"

    for seconds in (60.0, None):
        assert th._replies([*"abcdef"], wait, 6, seconds) == [(f"{p} True", None) for p in "abcdef"]
    assert th._replies([], name, 6, 60.0) == []


def test_failed_calls(spark):
    prompts = spark.range(0, 60, 1, 3).select(F.col("id").cast("string").alias("prompt"))

    def ask(prompt):
        if int(prompt) % 3 == 0:
            raise ValueError("bad")
        if int(prompt) % 3 == 1:
            raise KeyError(prompt)
        return "good"

    replies = th.written_replies(prompts, ask)
    assert {(r["raw"], (r["error"] or "").split(":")[0]) for r in replies.collect()} == {
        ("good", ""), (None, "ValueError"), (None, "KeyError"),
    }
    counts = {r["error"]: r["calls"] for r in th.failed_calls(replies).collect()}
    assert counts["ValueError: bad"] == 20 and sum(counts.values()) == 40
    th.raise_outage(replies)
    with pytest.raises(RuntimeError, match="all 20 model calls failed: ValueError: bad"):
        th.raise_outage(replies.filter("error LIKE 'Value%'"))


def test_jobs_do_not_grow_with_the_prompts(spark):
    def jobs(n):
        group = f"calls-{n}"
        spark.sparkContext.setJobGroup(group, group)
        prompts = spark.range(0, n, 1, 4).select(F.col("id").cast("string").alias("prompt"))
        th.written_replies(prompts, str, calls_per_task=5)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(20) == jobs(400)


def test_outage_raises(spark):
    def broken(prompt):
        raise NameError("no model")

    _, df = themed(spark, 60)
    with pytest.raises(RuntimeError, match="NameError"):
        th.extract_themes(df.drop("themes"), broken, attempts=2, pause=0)
    with pytest.raises(RuntimeError, match="NameError"):
        ins.insights(df, broken)


def test_failed_groups_stay(spark):
    _, df = themed(spark, 200)

    def ask(prompt):
        if "'Price and Value'" in prompt:
            raise ValueError("no")
        return "fine"

    found, cited = ins.insights(df, ask)
    rows = {(r["Theme"], r["sentiment"]): (r["insights"], r["error"]) for r in found.collect()}
    failed = {k for k, v in rows.items() if v == (None, "ValueError: no")}
    assert failed and {t for t, _ in failed} == {"Price and Value"}
    assert {v for k, v in rows.items() if k not in failed} == {("fine", None)} and cited.count() == 0


def test_samples_with_repeated_ids(spark):
    _, df = themed(spark, 800)
    twice = ranking.with_row_index(df.withColumn("review_id", F.lit("same")), "row")
    samples = ins.insight_samples(twice, 50, id_column="row")
    assert samples.select("Theme", "sentiment", "row").distinct().count() == samples.count()
    largest = samples.groupBy("Theme", "sentiment").count().agg(F.max("count")).first()[0]
    assert largest == 50


def test_samples_of_a_hot_group(spark):
    df = spark.range(0, 20000, 1, 8).select(
        F.col("id").cast("string").alias("review_id"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise((F.col("id") % 500).cast("string")).alias("g"),
    )
    keys = {}
    for r in df.withColumn("key", ranking.seeded_key(F.col("review_id"), 4)).collect():
        keys.setdefault(r["g"], []).append((r["key"], r["review_id"]))
    want = {(g, i, p) for g, ks in keys.items() for p, (_, i) in enumerate(sorted(ks)[:50])}
    got = ranking.sample_per_group(df, ["g"], 50, seed=4).collect()
    assert {(r["g"], r["review_id"], r["position"]) for r in got} == want and len(got) == len(want)
    feed = [r["review_id"] for r in ranking.random_feed(df.filter("g = 'hot'"), 20, seed=4).collect()]
    assert feed == [i for _, i in sorted(keys["hot"])[:20]]


def test_random_feed(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("review_id"))
    first, other = ranking.random_feed(df, seed=0), ranking.random_feed(df, seed=1)
    assert first.count() == 20 and first.collect() != other.collect()
    assert ranking.random_feed(df.limit(7)).count() == 7


def test_order_statistics(spark):
    rng = random.Random(3)
    groups = {
        "even": [rng.random() for _ in range(700)],
        "tight": [0.9 + rng.random() * 1e-9 for _ in range(500)],
        "copies": [0.4] * 600 + [1.0, 0.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    key = F.floor(F.col("v") * float(1 << 62)).cast("bigint")
    ranks = [(g, r) for g, vs in groups.items() for r in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1}]
    wanted = spark.createDataFrame(ranks, "g string, rank long")
    got = ranking.order_statistics(df, "g", F.col("v"), key, wanted).collect()
    assert {(r["g"], r["rank"]): r["value"] for r in got} == {(g, r): sorted(groups[g])[r] for g, r in ranks}
    assert len(got) == 12


def test_order_statistics_seek_again_and_narrow(spark, monkeypatch):
    rng = random.Random(5)
    groups = {"a": [rng.randrange(1 << 60) for _ in range(5000)], "b": [7] * 3000, "c": list(range(2000))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v long")
    ranks = [(g, r) for g, vs in groups.items() for r in {0, 1, len(vs) // 2, len(vs) - 1}]

    def wanted(sizes):
        assert {r["g"]: r["n"] for r in sizes.collect()} == {g: len(vs) for g, vs in groups.items()}
        return spark.createDataFrame(ranks + [("a", 5000), ("a", -1), ("z", 0)], "g string, rank long")

    want = {(g, r): sorted(groups[g])[r] for g, r in ranks}
    # Sketches too small for the margin, and brackets that are all narrowed.
    for sketch, margin, counted in ((8, 0.0001, 1 << 22), (64, 0.05, 100), (2048, 0.008, 10)):
        monkeypatch.setattr(ranking, "_SKETCH", sketch)
        monkeypatch.setattr(ranking, "_COUNTED", counted)
        got = ranking.order_statistics(df, "g", F.col("v"), F.col("v"), wanted, margin).collect()
        assert {(r["g"], r["rank"]): r["value"] for r in got} == want and len(got) == len(want)


def test_samples_where_one_id_holds_most_rows(spark):
    df = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 10 < 7, "same").otherwise(F.col("id").cast("string")).alias("review_id"),
        F.col("id").alias("own"), (F.col("id") % 2).cast("string").alias("g"),
    )
    for seed in range(4):
        got = ranking.sample_per_group(df, ["g"], 40, seed, row="own").collect()
        assert len(got) == len({(r["g"], r["own"]) for r in got}) == 80
        assert sorted(r["position"] for r in got) == sorted([*range(40)] * 2)


def test_stored_positions(spark, tmp_path):
    df = spark.range(0, 50_000, 1, 3).select("id", F.repeat(F.lit("x"), 40).alias("_file"), F.lit(1).alias("_slot"))
    df.write.parquet(str(tmp_path / "rows"), compression="none")
    stored = spark.read.parquet(str(tmp_path / "rows"))
    seen = set()
    for size in ("128m", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            indexed = ranking.with_row_index(spark.read.parquet(str(tmp_path / "rows")), "i")
            assert indexed.columns == ["id", "_file", "_slot", "i"] and indexed.filter("i <> id").count() == 0
            seen.add(indexed.rdd.getNumPartitions())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(seen) == 2
    assert ranking.with_row_index(stored.select("id"), "i").filter("i <> id").count() == 0
    # Rows that were filtered or repeated have no stored place; the copy numbers them.
    for other in (stored.filter("id % 3 = 0"), stored.filter("id <> 0"), stored.unionByName(stored)):
        assert ranking.stored_row_index(other) is None
        places = [r["i"] for r in ranking.with_row_index(other.select("id"), "i").select("i").collect()]
        assert sorted(places) == list(range(len(places))) and len(places) == other.count()
    assert ranking.with_row_index(stored.filter("id < 0"), "i").count() == 0


def test_confidence_boxes(spark):
    rng = random.Random(4)
    groups = {"positive": [round(rng.uniform(0.34, 1), 3) for _ in range(301)] + [0.01, 0.02],
              "negative": [0.5], "neutral/mixed": [0.4, 0.6]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("negative", None), (None, 0.9)]
    out = a.confidence_boxes(spark.createDataFrame(rows, "predicted_sentiment string, confidence double"))
    for r in out.collect():
        values = sorted(groups[r["sentiment"]])
        n = len(values)

        def quartile(p):
            at = min(max(n * p - 0.5, 0), n - 1)
            low = math.floor(at)
            return values[low] + (at - low) * (values[min(low + 1, n - 1)] - values[low])

        q1, q3 = quartile(0.25), quartile(0.75)
        assert r["q1"] == pytest.approx(q1) and r["q3"] == pytest.approx(q3)
        assert r["median"] == pytest.approx(statistics.median(values))
        inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert r["lower_fence"] == pytest.approx(min(inside[0], q1))
        assert r["upper_fence"] == pytest.approx(max(inside[-1], q3))
        assert r["outliers"] == n - len(inside)
        assert (r["min"], r["max"]) == (values[0], values[-1])


def test_raw_view(spark):
    df = spark.range(80).select(
        F.format_string("%03d", "id").alias("review_id"), F.lit("t").alias("clean_text"),
        F.lit(0.5).alias("confidence"),
    )
    view = prepare.raw_view(df)
    assert view.columns == ["confidence", "clean_text"] and view.count() == 50


def test_iso_dates_try_no_other_form(spark):
    df = frame(spark, [("2024-01-31",), (None,), ("2024-02-01T10:00:00",)], "date string")
    # A form that cannot be read shows that none is tried.
    out = prepare.parse_dates(df, formats=("'",))
    assert [r["date"] for r in out.collect()] == [dt.datetime(2024, 1, 31), None, dt.datetime(2024, 2, 1, 10)]
