"""TF-IDF features: words and word pairs, a bounded vocabulary, unit-length rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from opinara.functions.text import TOKEN_PATTERN
from opinara.session import local_table, pin, spread
from opinara.vocab import default_stop_words

# Columns that the stages add; input columns of the usual names do not clash with them.
TOKENS, WORDS, PAIRS, TERMS = "_text_tokens", "_text_words", "_text_pairs", "_text_terms"
COUNTS, WEIGHTED, FEATURES = "_text_counts", "_text_weighted", "_text_features"

# Vocabulary limits.
MAX_TERMS = 5000
MIN_DOCS = 2
MAX_DOC_SHARE = 0.8


def term_stages(stop_words: Sequence[str] | None = None, text: str = "clean_text") -> PipelineModel:
    """Stages from text to TERMS: tokens, stop words out, then words and word pairs.

    Stop words and pairs are SQL over arrays, which takes a third less time than the stages of Spark
    ML for them: those turn each array into Scala strings and back.
    """
    stop_words = default_stop_words() if stop_words is None else stop_words
    quoted = sorted({w.lower().replace("\\", "\\\\").replace("'", "\\'") for w in stop_words})
    kept = " AND ".join(["w IS NOT NULL", *(["w NOT IN (" + ", ".join(f"'{w}'" for w in quoted) + ")"] * bool(quoted))])
    followed = f"greatest(size({WORDS}) - 1, 0)"
    pairs = f"zip_with(slice({WORDS}, 1, {followed}), slice({WORDS}, 2, {followed}), (a, b) -> concat(a, ' ', b))"
    added = {WORDS: f"filter({TOKENS}, w -> {kept})", PAIRS: pairs, TERMS: f"concat({WORDS}, {PAIRS})"}
    return PipelineModel(
        [
            RegexTokenizer(inputCol=text, outputCol=TOKENS, pattern=TOKEN_PATTERN, gaps=False),
            *(SQLTransformer(statement=f"SELECT *, {sql} AS {name} FROM __THIS__") for name, sql in added.items()),
        ]
    )


def occurrences(df: DataFrame, terms: str) -> DataFrame:
    """Rows (list, term): list 0 has every occurrence, list 1 each term once per document.

    Repeats inside a document are removed in its own array, so documents are never shuffled.
    The outer explodes keep Spark from computing the array once more to test for emptiness.
    """
    lists = F.array(F.col(terms), F.array_distinct(terms))
    return (
        df.select(F.posexplode_outer(lists).alias("list", "terms"))
        .select("list", F.explode_outer("terms").alias("term"))
        .filter(F.col("term").isNotNull())
    )


def term_counts(rows: DataFrame) -> DataFrame:
    """Total count and document count per term, with map-side combine."""
    return rows.groupBy("term").agg(
        F.count_if(F.col("list") == 0).alias("total"), F.count_if(F.col("list") == 1).alias("docs")
    )


def vocabulary(
    df: DataFrame,
    n_docs: int,
    max_terms: int = MAX_TERMS,
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_DOC_SHARE,
) -> DataFrame:
    """The most frequent words and pairs within the document limits; ties go by term.

    A pair is never more frequent than either of its words. So words are counted first, and
    then only pairs of words that reach the count of the last word that would fit; the long
    tail of pairs, most of all terms, is never shuffled.
    """
    frequent = F.col("docs") >= min_docs
    not_common = F.col("docs") <= max_share * n_docs
    order = [F.desc("total"), F.col("term")]
    words = pin(term_counts(occurrences(df, WORDS)).filter(frequent), "word-counts")
    fitting = words.filter(not_common)
    last = (
        fitting.orderBy(F.desc("total")).limit(max_terms)
        .agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("total")).first()
    )
    floor = last["total"] if last["n"] == max_terms else 0
    # Written, so that Spark knows the size before it decides to broadcast.
    partner = pin(words.filter(F.col("total") >= floor).select("term"), "partner-words")
    pairs = (
        occurrences(df, PAIRS)
        .withColumn("first", F.substring_index("term", " ", 1))
        .withColumn("second", F.substring_index("term", " ", -1))
        .join(partner.withColumnRenamed("term", "first"), "first", "left_semi")
        .join(partner.withColumnRenamed("term", "second"), "second", "left_semi")
    )
    counted = term_counts(pairs).filter(frequent & not_common)
    reaching = fitting.unionByName(counted).filter(F.col("total") >= floor)
    return reaching.orderBy(*order).limit(max_terms)


def idf(docs: Column, n_docs: int) -> Column:
    """Smoothed inverse document frequency plus one."""
    return F.log((1.0 + n_docs) / (1.0 + docs)) + 1.0


def text_terms(df: DataFrame, stages: PipelineModel | None = None) -> DataFrame:
    """Words, pairs and terms of `clean_text`, in columns WORDS, PAIRS and TERMS."""
    return (stages or term_stages()).transform(spread(df))


def fit_tfidf(
    df: DataFrame,
    stop_words: Sequence[str] | None = None,
    n_docs: int | None = None,
    **limits,
) -> PipelineModel:
    """Fit the vocabulary on `clean_text` and return text -> FEATURES as JVM stages.

    Only the vocabulary, at most `max_terms` rows, reaches the driver. `n_docs` saves a
    count where the caller knows it.
    """
    stages = term_stages(stop_words)
    terms = text_terms(df.select("clean_text"), stages)
    n_docs = df.count() if n_docs is None else n_docs
    rows = sorted(
        vocabulary(terms, n_docs, **limits).withColumn("idf", idf(F.col("docs"), n_docs)).collect(),
        key=lambda r: r["term"],
    )
    if not rows:
        raise ValueError("no term is within the document limits")
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in rows], inputCol=TERMS, outputCol=COUNTS
    )
    weight = ElementwiseProduct(
        inputCol=COUNTS, outputCol=WEIGHTED, scalingVec=Vectors.dense([r["idf"] for r in rows])
    )
    unit = Normalizer(p=2.0, inputCol=WEIGHTED, outputCol=FEATURES)
    return PipelineModel([*stages.stages, counter, weight, unit])


def tfidf_weights(df: DataFrame, model: PipelineModel, id_column: str) -> DataFrame:
    """Non-zero weights as rows (id, term, weight)."""
    counter = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    spark = df.sparkSession
    words = list(counter.vocabulary)
    terms = local_table(spark, index=pa.array(range(len(words)), "int32"), term=words)
    vector = F.unwrap_udt(FEATURES)
    return (
        model.transform(spread(df.select(id_column, "clean_text")))
        .select(id_column, F.inline(F.arrays_zip(vector["indices"].alias("index"),
                                                 vector["values"].alias("weight"))))
        .join(terms, "index")
        .select(id_column, "term", "weight")
    )
