"""Tokens, vocabulary, TF-IDF, classifier."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opinara.functions.text import tokens
from opinara.operators import features
from opinara.operators.features import tfidf_weights
from opinara.operators.model import (
    INVERSE_PENALTY, PROBABILITY, classes_of, fit_classifier, stratified_split, train,
)
from opinara.operators.prepare import training_rows, with_clean_text
from opinara.operators.scorer import WeightTables, class_probabilities
from opinara.plans.score import score
from opinara.session import local_table, pin
from opinara.vocab import default_stop_words
from registry.core import query, reviews, rounded, table, with_views
from registry.preparation import LABEL


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_STOP = "[" + ", ".join(f"'{w}'" for w in default_stop_words()) + "]"
_VIEWS = {
    "docs": f"""SELECT doc_id, list_filter({_TOKENS},
 lambda t: NOT list_contains({_STOP}, t)) AS words FROM documents""",
    "terms": """SELECT doc_id, list_concat(words, [concat(words[i], ' ', words[i + 1])
 FOR i IN range(1, len(words))]) AS terms FROM docs""",
    "counts": """SELECT doc_id, term, count(*) AS tf
 FROM (SELECT doc_id, unnest(terms) AS term FROM terms) t GROUP BY 1, 2""",
    "vocabulary": """SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS docs FROM counts
 GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM documents)
 ORDER BY total DESC, term LIMIT 5000""",
    "weighted": """SELECT doc_id, c.term, tf * (ln((1.0 + (SELECT count(*) FROM documents))
 / (1.0 + docs)) + 1.0) AS w FROM counts c JOIN vocabulary v ON c.term = v.term""",
}


def _upto(last: str, sql: str) -> str:
    names = list(_VIEWS)
    parts = [f"{n} AS ({_VIEWS[n]})" for n in names[: names.index(last) + 1]]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def _documents(spark, sf):
    return with_clean_text(table(spark, sf, "documents")).select("doc_id", "clean_text")


def _terms(spark, sf):
    return features.text_terms(_documents(spark, sf))


@query("txt_1_tokens", f"""
SELECT doc_id, len({_TOKENS}) AS n, array_to_string({_TOKENS}, ' ') AS tokens FROM documents""")
def txt_1(spark, sf):
    words = tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("tokens")
    )


@query("txt_2_stop_words", _upto("docs", """
SELECT doc_id, len(words) AS n, array_to_string(words, ' ') AS words FROM docs"""))
def txt_2(spark, sf):
    return _terms(spark, sf).select(
        "doc_id", F.size(features.WORDS).cast("bigint").alias("n"), F.array_join(features.WORDS, " ").alias("words")
    )


@query("txt_3_terms", _upto("terms", """
SELECT doc_id, len(terms) AS n, array_to_string(terms, '|') AS terms FROM terms"""))
def txt_3(spark, sf):
    return _terms(spark, sf).select(
        "doc_id", F.size(features.TERMS).cast("bigint").alias("n"), F.array_join(features.TERMS, "|").alias("terms")
    )


@query("txt_4_vocabulary", _upto("vocabulary", "SELECT term, total, docs FROM vocabulary"))
def txt_4(spark, sf):
    return features.vocabulary(_terms(spark, sf), table(spark, sf, "documents").count())


@query("txt_5_inverse_document_frequency", _upto("vocabulary", """
SELECT term, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + docs)) + 1.0, 6) AS idf
FROM vocabulary"""))
def txt_5(spark, sf):
    n_docs = table(spark, sf, "documents").count()
    words = features.vocabulary(_terms(spark, sf), n_docs)
    return words.select("term", F.round(features.idf(F.col("docs"), n_docs), 6).alias("idf"))


@query("txt_6_tfidf_weights", _upto("weighted", """
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM weighted"""))
def txt_6(spark, sf):
    rows = _documents(spark, sf)
    return rounded(features.tfidf_weights(rows, features.fit_tfidf(rows), "doc_id"), "weight")


def trained(spark, sf):
    """A classifier of the template reviews, fitted anew by every query."""
    return train(reviews(spark, sf))


_LABELLED = _upto("vocabulary", "SELECT term, TRUE AS optimal FROM vocabulary").replace(
    "FROM documents", "FROM labelled"
).replace("WITH docs", "WITH labelled AS (SELECT * FROM documents JOIN labels USING (doc_id)),\ndocs")


@query("mdl_1_fit_two_classes", _LABELLED)
def mdl_1(spark, sf):
    """The document quality model, told as the condition that its coefficients meet.

    At the best coefficients the penalty balances the residuals of every term.
    """
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("sentiment"))
    rows = pin(_documents(spark, sf).join(labels, "doc_id"), "documents")
    model = fit_classifier(rows)
    regression = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    vocabulary = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    fitted = local_table(
        spark, term=list(vocabulary), w=regression.coefficients.toArray().tolist()
    )
    residual = vector_to_array(PROBABILITY)[1] - F.col("sentiment").cast("double")
    errors = model.transform(rows).select("doc_id", residual.alias("r"))
    weights = tfidf_weights(rows, PipelineModel(model.stages[:-2]), "doc_id")
    slope = weights.join(errors, "doc_id").groupBy("term").agg(F.sum(F.col("weight") * F.col("r")).alias("g"))
    # Per row of training data, as the solver weighs it.
    n = rows.count()
    balance = F.abs(F.col("g") + F.col("w") / INVERSE_PENALTY) / n
    return fitted.join(slope, "term").select("term", (balance < 1e-4).alias("optimal"))


@query("mdl_2_predict", with_views("reviews", """
SELECT review_id, lower(coalesce(text, '')) AS clean_text, TRUE AS sums_to_one,
 TRUE AS confidence_is_largest, TRUE AS class_is_likeliest FROM reviews"""))
def mdl_2(spark, sf):
    """Scores of all reviews, told as the properties that hold for any fitted model."""
    model = trained(spark, sf).model
    classes = classes_of(model)
    out = score(reviews(spark, sf), model)
    probabilities = F.array(*[F.col(f"`prob_{c}`") for c in classes])
    total = sum((F.col(f"`prob_{c}`") for c in classes[1:]), F.col(f"`prob_{classes[0]}`"))
    own = F.lit(False)
    for c in classes:
        own = own | ((F.col("predicted_sentiment") == c) & (F.col(f"`prob_{c}`") == F.col("confidence")))
    return out.select(
        "review_id", "clean_text", (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.col("confidence") == F.array_max(probabilities)).alias("confidence_is_largest"),
        own.alias("class_is_likeliest"),
    )


# Weights of three classes by a rule over the term, so that both engines make the same ones.
_CLASSES = (("negative", 1, 2, 3, 0.25), ("neutral/mixed", 5, 1, 2, 0.0), ("positive", 2, 7, 1, -0.5))
_RULE = "((length(term) * a + {bytes}(term) * b + instr(term, 'e') * c) % 21 - 10) / 4.0E0"


@query("mdl_2_fixed_weights", _upto("weighted", f""",
classes(class, a, b, c, bias) AS (VALUES {", ".join(f"('{n}', {a}, {b}, {c}, {z}E0)" for n, a, b, c, z in _CLASSES)}),
lengths AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM weighted GROUP BY doc_id),
products AS (SELECT doc_id, class, sum(w * {_RULE.format(bytes="strlen")}) AS x FROM weighted, classes GROUP BY 1, 2),
logits AS (SELECT d.doc_id, c.class, c.bias + coalesce(x / size, 0.0E0) AS z FROM documents d CROSS JOIN classes c
 LEFT JOIN products p ON p.doc_id = d.doc_id AND p.class = c.class LEFT JOIN lengths l ON l.doc_id = d.doc_id),
raised AS (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM logits),
shares AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM raised)
SELECT doc_id, round(max(p), 6) AS confidence, arg_max(class, p) AS predicted_sentiment,
 round(max(p) FILTER (class = 'negative'), 6) AS prob_negative,
 round(max(p) FILTER (class = 'neutral/mixed'), 6) AS prob_neutral,
 round(max(p) FILTER (class = 'positive'), 6) AS prob_positive
FROM shares GROUP BY doc_id"""))
def mdl_2_fixed(spark, sf):
    """Every probability of a model whose weights both engines know: scoring as a join, softmax by row."""
    n_docs = table(spark, sf, "documents").count()
    words = pin(features.vocabulary(_terms(spark, sf), n_docs).select("term", "docs"), "vocabulary")
    names = ("class", "a", "b", "c", "intercept")
    classes = local_table(spark, **dict(zip(names, map(list, zip(*_CLASSES)))))
    weights = words.join(F.broadcast(classes), F.lit(True)).select(
        "class", "term", F.expr(_RULE.format(bytes="octet_length")).alias("weight")
    )
    tables = WeightTables(
        words.select("term", features.idf(F.col("docs"), n_docs).alias("idf")), pin(weights, "weights"),
        classes.select("class", "intercept"),
    )
    found = class_probabilities(_documents(spark, sf), tables, "doc_id")
    by_class = {"prob_negative": "negative", "prob_neutral": "neutral/mixed", "prob_positive": "positive"}
    columns = [F.col("probabilities")[c].alias(name) for name, c in by_class.items()]
    return rounded(found.select("doc_id", "confidence", "predicted_sentiment", *columns), "confidence", *by_class)


@query("mdl_3_train", with_views("reviews", f"""
SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows, TRUE AS accuracy_is_a_share
FROM (SELECT {LABEL} AS sentiment FROM reviews) r WHERE sentiment IS NOT NULL"""))
def mdl_3(spark, sf):
    """Rows held out in training. The labels of these reviews don't follow from their texts, so that
    of the accuracy only its range is stated."""
    result = trained(spark, sf)
    rows = stratified_split(training_rows(reviews(spark, sf)).select("review_id", "sentiment"))
    return rows.agg(
        F.count_if("is_test").alias("test_rows"),
        F.lit(0 <= result.accuracy <= 1).alias("accuracy_is_a_share"),
    )


@query("mdl_3_document_quality", """
SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows, TRUE AS within_two_points_of_largest_class
FROM documents JOIN labels USING (doc_id)""")
def mdl_3_quality(spark, sf):
    """Training on whole texts: accuracy on held-out documents, at worst 0.02 below the largest class's share."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("sentiment"))
    rows = pin(_documents(spark, sf).join(labels, "doc_id"), "documents")
    result = train(rows)
    largest = rows.groupBy("sentiment").count().agg(F.max("count")).first()[0] / rows.count()
    held_out = stratified_split(rows.select("doc_id", "sentiment"), id_column="doc_id")
    return held_out.agg(
        F.count_if("is_test").alias("test_rows"),
        F.lit(result.accuracy >= largest - 0.02).alias("within_two_points_of_largest_class"),
    )
