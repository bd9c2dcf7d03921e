"""Features and classifier against brute force; scoring, saving, streaming."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opinara.operators import features, model as m
from opinara.operators.prepare import with_clean_text
from opinara.session import run_dir
from opinara.sources.models import load_or_train, save_model
from opinara.vocab import default_stop_words
from registry.core import reviews

WORDS = [f"w{i}" for i in range(60)] + ["the", "star", "but"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 40))) for _ in range(200)]


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, clean_text string")


def terms_of(text, stop):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stop]
    return words + [f"{x} {y}" for x, y in zip(words, words[1:])]


def brute_vocabulary(texts, stop, max_terms, min_docs=2, max_share=0.8):
    lists = [terms_of(t, stop) for t in texts]
    total = Counter(t for ts in lists for t in ts)
    docs = Counter(t for ts in lists for t in set(ts))
    fit = [t for t in total if min_docs <= docs[t] <= max_share * len(texts)]
    top = sorted(fit, key=lambda t: (-total[t], t))[:max_terms]
    return lists, {t: docs[t] for t in top}


@pytest.mark.parametrize("limits", [{}, {"max_terms": 70}, {"max_terms": 30, "max_share": 0.4},
                                    {"max_terms": 400, "min_docs": 5}])
def test_tfidf(spark, texts, documents, limits):
    stop = set(default_stop_words())
    options = {"max_terms": 5000, **limits}
    lists, docs = brute_vocabulary(texts, stop, **options)
    model = features.fit_tfidf(documents, **limits)
    counter = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    assert counter.vocabulary == sorted(docs)
    want = {}
    for i, terms in enumerate(lists):
        weights = {t: n * (math.log((1 + len(texts)) / (1 + docs[t])) + 1)
                   for t, n in Counter(terms).items() if t in docs}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        want.update({(i, t): w / norm for t, w in weights.items()})
    got = {(r["id"], r["term"]): r["weight"] for r in features.tfidf_weights(documents, model, "id").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_own_stop_words(documents):
    model = features.fit_tfidf(documents, stop_words=["w1"])
    counter = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    assert "the" in counter.vocabulary and "w1" not in counter.vocabulary


def test_empty_vocabulary(spark):
    df = spark.createDataFrame([("once",), ("",)], "clean_text string")
    with pytest.raises(ValueError):
        features.fit_tfidf(df)


@pytest.mark.parametrize("classes", [2, 3])
def test_fit_is_optimal(spark, texts, classes):
    """The gradient of the C-objective vanishes at the fitted coefficients."""
    rng = random.Random(2)
    names = ["a", "b", "c"][:classes]
    rows = [(i, t, rng.choice(names)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, clean_text string, sentiment string")
    model = m.fit_classifier(df, max_terms=40)
    assert m.classes_of(model) == names
    regression = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    out = model.transform(df).orderBy("id").select(vector_to_array(m.f.FEATURES), vector_to_array(m.PROBABILITY))
    data = out.collect()
    x, p = np.array([r[0] for r in data]), np.array([r[1] for r in data])
    y = np.array([[s == c for c in names] for _, _, s in rows], dtype=float)
    gradient = 0.8 * (p - y).T @ x
    weights = regression.coefficientMatrix.toArray()
    if classes == 2:
        gradient = gradient[1:]
    assert np.abs(gradient + weights).max() < 1e-3
    assert np.abs((p - y).sum(axis=0)).max() < 1e-3


def test_split(spark):
    rng = random.Random(3)
    labels = rng.choices(["positive", "negative", "neutral/mixed"], [8, 3, 1], k=2003)
    df = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(labels)], "review_id string, sentiment string")
    rows = m.stratified_split(df.repartition(5)).collect()
    sizes, tests = Counter(labels), Counter(r["sentiment"] for r in rows if r["is_test"])
    assert sum(tests.values()) == math.ceil(0.2 * 2003)
    assert all(abs(tests[c] - 0.2 * n) <= 1 for c, n in sizes.items())
    again = m.stratified_split(df.repartition(2)).filter("is_test").select("review_id").collect()
    assert {r["review_id"] for r in rows if r["is_test"]} == {r[0] for r in again}


def test_split_sizes(spark):
    def sizes(**given):
        df = spark.createDataFrame(list(given.items()), "sentiment string, n long")
        return {r["sentiment"]: r["test_rows"] for r in m.test_sizes(df).collect()}

    assert sizes(a=10, b=5) == {"a": 2, "b": 1}
    assert sum(sizes(a=33, b=33, c=34).values()) == 20
    many = spark.range(12_000).select(F.col("id").cast("string").alias("sentiment"), "id")
    split = m.stratified_split(many, id_column="id").agg(F.count_if("is_test"), F.count(F.lit(1))).first()
    assert tuple(split) == (2400, 12_000)
    assert m.stratified_split(many.limit(0), id_column="id").count() == 0


def test_input_columns_do_not_clash(spark, sf_dir, trained):
    df = with_clean_text(reviews(spark, sf_dir)).select("review_id", "clean_text")
    names = ("words", "terms", "tokens", "counts", "features", "probability", "prediction", "rawPrediction")
    own = m.predict(df.withColumns({n: F.lit("own") for n in names}).withColumn("confidence", F.lit("x")), trained.model)
    assert own.select(*names).distinct().collect() == [("own",) * len(names)]
    columns = ["review_id", "predicted_sentiment", "confidence"]
    assert own.select(columns).exceptAll(m.predict(df, trained.model).select(columns)).isEmpty()


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return m.train(reviews(spark, sf_dir))


def test_train_and_predict(spark, sf_dir, trained):
    model, accuracy = trained
    assert 0 < accuracy <= 1
    df = with_clean_text(reviews(spark, sf_dir))
    out = m.predict(df, model)
    assert [c for c in out.columns if c not in df.columns] == [
        "predicted_sentiment", "confidence", "prob_negative", "prob_neutral/mixed",
        "prob_positive", "is_mixed",
    ]
    for r in out.limit(300).collect():
        p = {c: r[f"prob_{c}"] for c in m.classes_of(model)}
        assert sum(p.values()) == pytest.approx(1)
        assert r["confidence"] == max(p.values()) == p[r["predicted_sentiment"]]
        assert not r["is_mixed"] or r["predicted_sentiment"] == "neutral/mixed"
    same = model.transform(df).select("review_id", F.col("predicted_sentiment").alias("s"))
    assert out.join(same, "review_id").filter("s <> predicted_sentiment").count() == 0


def test_tie_goes_to_first_class(spark):
    df = spark.createDataFrame([([0.4, 0.2, 0.4],), ([0.1, 0.45, 0.45],)], "p array<double>")
    out = m.probability_columns(df, F.col("p"), ["a", "b", "c"]).collect()
    assert [(r["predicted_sentiment"], r["confidence"]) for r in out] == [("a", 0.4), ("b", 0.45)]


def test_training_on_copies(spark):
    """A third of the rows share id, text and label; the split still holds out a fifth."""
    rows = [("hot", "same great place", "5")] * 200
    rows += [(f"r{i}", f"awful number {i % 20}", "1") for i in range(400)]
    df = spark.createDataFrame(rows, "review_id string, text string, stars string")
    sizes = {}
    split = m.stratified_split

    def counted(*args, **options):
        out = split(*args, **options)
        sizes.update({r["sentiment"]: r["n"] for r in out.filter("is_test").groupBy("sentiment")
                      .agg(F.count("*").alias("n")).collect()})
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "stratified_split", counted)
        assert m.train(df).accuracy == 1
    assert sizes == {"positive": 40, "negative": 80}


def test_training_without_ids(spark, sf_dir):
    df = reviews(spark, sf_dir).select("stars", "text")
    assert 0 < m.train(df, max_terms=50).accuracy <= 1


def test_load_or_train(spark, sf_dir, trained):
    path = f"{run_dir(spark)}/test-model"
    with pytest.raises(ValueError):
        load_or_train(spark, path + "-none")
    save_model(trained.model, path)
    loaded, accuracy = load_or_train(spark, path)
    assert accuracy is None
    df = with_clean_text(reviews(spark, sf_dir))
    columns = ["review_id", "predicted_sentiment", "confidence", "is_mixed"]
    left, right = (m.predict(df, x).select(columns) for x in (trained.model, loaded))
    assert left.exceptAll(right).isEmpty()
    _, renewed = load_or_train(spark, path, reviews(spark, sf_dir), force=True, max_terms=60)
    assert renewed is not None


def test_streamed_files_are_scored_once(spark, sf_dir, trained, tmp_path):
    from opinara.streaming.scoring import arriving_reviews, score_arrivals

    columns = ["review_id", "text", "stars"]
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = reviews(spark, sf_dir).select(columns)
    with pytest.raises(ValueError):
        arriving_reviews(spark, source, ["text"])
    halves = [df.filter("stars is not null"), df.filter("stars is null")]
    for half in halves:
        half.write.mode("append").option("header", True).option("escape", '"').csv(source)
        score_arrivals(arriving_reviews(spark, source, columns), trained.model, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target).select("review_id", "predicted_sentiment")
    want = m.predict(with_clean_text(df), trained.model).select("review_id", "predicted_sentiment")
    assert sorted(got.collect()) == sorted(want.collect())


def test_terms_like_the_stages_of_spark_ml(spark):
    """Stop words and pairs are SQL; only the tokens are a Scala function."""
    from pyspark.ml.feature import NGram, StopWordsRemover

    texts = ["a it's the o'neil Über don't", "", "x", "word", "The big the Big dog", None]
    rows = spark.createDataFrame([(t or "",) for t in texts], "clean_text string")
    for stop_words in (["The", "o'", "NEIL", "a\\b", "it"], ["über"], [], None):
        found = features.text_terms(rows, features.term_stages(stop_words))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 1
        words = features.default_stop_words() if stop_words is None else stop_words
        removed = StopWordsRemover(inputCol=features.TOKENS, outputCol="w", stopWords=words).transform(found)
        paired = NGram(n=2, inputCol="w", outputCol="p").transform(removed).collect()
        assert [(r["w"], r["p"], r["w"] + r["p"]) for r in paired] == [
            (r[features.WORDS], r[features.PAIRS], r[features.TERMS]) for r in paired
        ]
