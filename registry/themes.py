"""Theme extraction and insights, with replies made from the reviews in place of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions.replies import (
    cited_positions, entry_names, insight_text, json_span, literal_objects,
    native_objects, reply_entries,
)
from opinara.functions.themes import canonical_themes, joined_themes, named_themes
from opinara.operators import insights as ins, themes as th
from opinara.operators.ranking import with_batches
from opinara.session import pin
from opinara.vocab import THEMES
from registry.core import query, reviews, scored, table, with_views
from registry.ranking import SAMPLE_SQL

# Two reviews per batch, one reply per batch, in the forms models give. Only the way to take
# an array item differs between the engines.
PAIRS = """
SELECT batch_id, size, {t1} AS t1, {t2} AS t2
FROM (SELECT CAST(FLOOR(k / 2) AS BIGINT) AS batch_id, CAST(count(*) AS INT) AS size
      FROM {reviews} GROUP BY 1) b"""
REPLIES = """
SELECT batch_id, size, t1, t2, CASE batch_id % 12
 WHEN 0 THEN concat('{{"1":["', t1, '"],"2":["', t2, '"]}}')
 WHEN 1 THEN concat('Here it is: {{"1":["', t1, '"],"2":["', t2, '"]}} as asked.')
 WHEN 2 THEN concat('{{''1'': ['' ', lower(t1), ' ''], ''2'': ''', upper(t2), '''}}')
 WHEN 3 THEN concat('[{{"1":["', t1, '"]}},{{"2":["', t2, '"]}}]')
 WHEN 4 THEN concat('{{"1":["', t1, '"]}},{{"2":["', t2, '"]}}')
 WHEN 5 THEN concat('{{1: ["', t1, '"], 2: ["', t2, '"]}}')
 WHEN 6 THEN concat('{{"1":["', t1, '","', t1, '"],"2":[{{"theme":"', t2, '"}}]}}')
 WHEN 7 THEN concat('{{"1":["', t1, '","Parking"],"2":["', t2, '"]}}')
 WHEN 8 THEN concat('{{"1":["Parking"],"2":["', t2, '"]}}')
 WHEN 9 THEN concat('{{"2":["', t2, '"]}}')
 WHEN 10 THEN concat('{{"1":["', t1, '",],"2":["', t2, '"]}}')
 ELSE 'no theme fits' END AS raw
FROM {pairs}"""
_NAMES = "'" + "', '".join(THEMES) + "'"
_SQL = {
    "pairs": PAIRS.format(
        t1=f"([{_NAMES}])[batch_id % 8 + 1]", t2=f"([{_NAMES}])[batch_id * 3 % 8 + 1]",
        reviews="reviews",
    ),
    "replies": REPLIES.format(pairs="pairs"),
    "themed": """SELECT r.k, r.review_id, r.text, p.batch_id,
 CASE WHEN p.batch_id % 12 IN (8, 9, 11) THEN 'FAILED' WHEN r.k % 2 = 0 THEN t1 ELSE t2 END
 AS themes FROM reviews r JOIN pairs p ON p.batch_id = CAST(FLOOR(r.k / 2) AS BIGINT)""",
}


def _with(last: str, sql: str) -> str:
    names = list(_SQL)
    return with_views("reviews", sql, **{n: _SQL[n] for n in names[: names.index(last) + 1]})


def replies(spark, sf):
    sql = PAIRS.replace("{t1}", f"array({_NAMES})[batch_id % 8]")
    sql = sql.replace("{t2}", f"array({_NAMES})[batch_id * 3 % 8]")
    return spark.sql(REPLIES, pairs=spark.sql(sql, reviews=reviews(spark, sf)))


def _objects(df):
    span = json_span(F.col("raw"))
    native = native_objects(F.col("span"))
    unread = F.when(F.col("native").isNull(), F.col("span"))
    return (
        df.withColumn("span", span).withColumn("native", native)
        .withColumn("literal", literal_objects(unread))
        .withColumn("objects", F.coalesce(
            "native", F.from_json("literal", "array<map<string,string>>")))
    )


@query("thm_1_excerpt", """
SELECT doc_id, substr(coalesce(text, ''), 1, 250) AS excerpt FROM documents""")
def thm_1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", th.review_excerpt(F.col("text")).alias("excerpt"))


_HEAD, _TAIL = (
    part.replace("{themes}", ", ".join(THEMES)).replace("{example}", THEMES[0]).replace("'", "''")
    for part in th.THEME_INSTRUCTIONS.split("{reviews}")
)


@query("thm_2_prompts", f"""
SELECT batch_id, CAST(count(*) AS BIGINT) AS size,
 concat(replace('{_HEAD}', '{{size}}', CAST(count(*) AS VARCHAR)),
  string_agg(concat('Review ', CAST(position AS VARCHAR), ':', chr(10), excerpt), chr(10)
             ORDER BY position), '{_TAIL}') AS prompt
FROM (SELECT substr(text, 1, 250) AS excerpt, i % 10 + 1 AS position,
       CAST(floor(i / 10) AS BIGINT) AS batch_id
      FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) d) b
GROUP BY batch_id""")
def thm_2(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("clean_text"))
    prompts = th.batch_prompts(with_batches(rows, 10, ["doc_id"]))
    return prompts.withColumn("size", F.col("size").cast("bigint"))


@query("thm_3_reply_span", _with("replies", """
SELECT batch_id, CASE WHEN batch_id % 12 = 11 THEN NULL
 WHEN batch_id % 12 = 1 THEN substr(raw, 13, len(raw) - 22) ELSE raw END AS span FROM replies"""))
def thm_3(spark, sf):
    return replies(spark, sf).select("batch_id", json_span(F.col("raw")).alias("span"))


@query("thm_4_parse_reply", _with("replies", """
SELECT batch_id, batch_id % 12 <> 11 AS readable,
 CAST(CASE WHEN batch_id % 12 = 11 THEN 0 WHEN batch_id % 12 IN (3, 4) THEN 2 ELSE 1 END AS BIGINT)
 AS objects FROM replies"""))
def thm_4(spark, sf):
    n = F.coalesce(F.size("objects"), F.lit(0)).cast("bigint")
    return _objects(replies(spark, sf)).select(
        "batch_id", F.col("objects").isNotNull().alias("readable"),
        F.when(F.col("objects").isNull(), F.lit(0).cast("bigint")).otherwise(n).alias("objects"),
    )


@query("thm_5_merge_objects", _with("replies", """
SELECT batch_id, CASE batch_id % 12 WHEN 9 THEN '2' WHEN 11 THEN NULL ELSE '1,2' END AS keys
FROM replies"""))
def thm_5(spark, sf):
    entries = reply_entries(F.col("objects"))
    keys = F.array_join(F.transform(entries, lambda e: e["key"]), ",")
    return pin(_objects(replies(spark, sf)), "objects").select("batch_id", keys.alias("keys"))


@query("thm_6_names_of_key", _with("replies", """
SELECT batch_id, CASE batch_id % 12 WHEN 2 THEN upper(t2) WHEN 11 THEN '' ELSE t2 END AS names
FROM replies"""))
def thm_6(spark, sf):
    df = _objects(replies(spark, sf)).withColumn("entries", reply_entries(F.col("objects")))
    names = F.array_join(entry_names(F.col("entries"), F.lit("2")), ",")
    return df.select("batch_id", F.coalesce(names, F.lit("")).alias("names"))


@query("jon_4_nth_review", _with("replies", """
SELECT batch_id, size, CASE batch_id % 12 WHEN 2 THEN concat(' ', lower(t1), ' ')
 WHEN 6 THEN concat(t1, ',', t1) WHEN 7 THEN concat(t1, ',Parking') WHEN 8 THEN 'Parking'
 WHEN 9 THEN '' WHEN 11 THEN '' ELSE t1 END AS first_names FROM replies"""))
def jon_4(spark, sf):
    df = _objects(replies(spark, sf)).withColumn("entries", reply_entries(F.col("objects")))
    names = F.array_join(entry_names(F.col("entries"), F.lit("1")), ",")
    return df.select("batch_id", "size", F.coalesce(names, F.lit("")).alias("first_names"))


@query("thm_7_allowed_themes", _with("pairs", """
SELECT batch_id, CASE WHEN t1 = t2 THEN t1 ELSE concat(t2, ', ', t1) END AS themes FROM pairs"""))
def thm_7(spark, sf):
    given = F.array(F.upper("t2"), F.lit("Parking"), F.concat(F.lit(" "), F.lower("t1"), F.lit("\n")), F.col("t2"))
    return replies(spark, sf).select("batch_id", joined_themes(canonical_themes(given)).alias("themes"))


@query("jon_3_canonical_names", with_views("exploded", """
SELECT review_id, Theme AS theme FROM exploded"""))
def jon_3(spark, sf):
    shouted = F.transform(named_themes(F.upper("themes")), F.lower)
    df = scored(spark, sf).select("review_id", F.explode(canonical_themes(shouted)).alias("theme"))
    return df


@query("thm_8_batch_validation", _with("replies", """
SELECT batch_id, batch_id % 12 NOT IN (8, 9, 11) AS ok FROM replies"""))
def thm_8(spark, sf):
    return th.parsed_replies(replies(spark, sf)).select("batch_id", "ok")


@query("thm_11_review_themes", _with("themed", """
SELECT batch_id, CAST(k % 2 + 1 AS BIGINT) AS position, themes FROM themed"""))
def thm_11(spark, sf):
    out = th.review_themes(th.parsed_replies(replies(spark, sf)))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("set_3_good_and_failed", _with("themed", """
SELECT themes = 'FAILED' AS failed, count(*) AS reviews FROM themed GROUP BY 1"""))
def set_3(spark, sf):
    parsed = pin(th.parsed_replies(replies(spark, sf)), "parsed")
    both = th.review_themes(parsed.filter("ok")).unionByName(th.review_themes(parsed.filter("not ok")))
    return both.groupBy((F.col("themes") == "FAILED").alias("failed")).agg(F.count("*").alias("reviews"))


@query("jon_2_attach_themes", _with("themed", """
SELECT review_id, text, CASE WHEN batch_id % 12 IN (8, 9, 11) THEN 'FAILED' ELSE themes END
 AS themes FROM themed"""))
def jon_2(spark, sf):
    parsed = pin(th.parsed_replies(replies(spark, sf)), "parsed")
    found = th.review_themes(parsed.filter("ok"))
    keyed = reviews(spark, sf).withColumns(
        {"batch_id": F.floor(F.col("k") / 2), "position": (F.col("k") % 2 + 1).cast("int")}
    )
    return th.attach_themes(keyed, found, ["batch_id", "position"]).select("review_id", "text", "themes")


def _model(refused: str | None = None):
    """Stands for a model: every review gets the theme its text asks for.

    A prompt with the `refused` word never gets an answer.
    """

    def answer(prompt: str) -> str:
        import json
        import re

        if refused and refused in prompt:
            raise RuntimeError("no answer")
        parts = re.split(r"^Review (\d+):\n", prompt, flags=re.M)[1:]
        return json.dumps({
            n: ["Speed of Service" if "slow" in text or "wait" in text else "Product Quality"]
            for n, text in zip(parts[::2], parts[1::2])
        })

    return answer


@query("thm_12_extract_themes", with_views("reviews", """
SELECT review_id, CASE WHEN contains(lower(coalesce(text, '')), 'slow')
  OR contains(lower(coalesce(text, '')), 'wait') THEN 'Speed of Service'
 ELSE 'Product Quality' END AS themes FROM reviews"""))
def thm_12(spark, sf):
    df = reviews(spark, sf).select("review_id", F.lower(F.coalesce("text", F.lit(""))).alias("clean_text"))
    return th.extract_themes(df, _model(), parallel_calls=8, pause=0).select("review_id", "themes")


@query("thm_10_retry_then_fail", with_views("reviews", """
SELECT review_id, CASE WHEN bool_or(contains(lower(coalesce(text, '')), 'dirty'))
  OVER (PARTITION BY CAST(floor(i / 3) AS BIGINT)) THEN 'FAILED'
 WHEN contains(lower(coalesce(text, '')), 'slow') OR contains(lower(coalesce(text, '')), 'wait')
 THEN 'Speed of Service' ELSE 'Product Quality' END AS themes
FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM reviews) r"""))
def thm_10(spark, sf):
    df = reviews(spark, sf).select("k", "review_id", F.lower(F.coalesce("text", F.lit(""))).alias("clean_text"))
    out = th.extract_themes(
        df, _model("dirty"), batch_size=3, attempts=3, pause=0, parallel_calls=8, keep_failed=True,
        order_by=["k"],
    )
    return out.select("review_id", "themes")


@query("thm_13_explode_themes", with_views("exploded", """
SELECT review_id, Theme, predicted_sentiment FROM exploded"""))
def thm_13(spark, sf):
    return th.explode_themes(scored(spark, sf)).select("review_id", "Theme", "predicted_sentiment")


_INS_HEAD, _INS_TAIL = (p.replace("'", "''") for p in ins.INSIGHT_INSTRUCTIONS.split("{reviews}"))


@query("ins_1_prompts", with_views("choices", f"""
SELECT Theme, s.sentiment, count(*) AS sample_size, concat(
 replace(replace('{_INS_HEAD}', '{{theme}}', Theme), '{{sentiment}}',
  CASE WHEN s.sentiment = 'All' THEN '' ELSE concat(s.sentiment, ' ') END),
 string_agg(concat('Review ', CAST(position AS VARCHAR), ': ', clean_text), chr(10)
            ORDER BY position), '{_INS_TAIL}') AS prompt
FROM sample s JOIN scored r ON s.review_id = r.review_id GROUP BY 1, 2""", sample=SAMPLE_SQL))
def ins_1(spark, sf):
    return ins.insight_prompts(ins.insight_samples(scored(spark, sf)))


# One reply per review, its citations made from the key.
INSIGHT_REPLIES = """
SELECT review_id, k, k % 20 AS sample_size, CASE WHEN k % 4 = 0 THEN concat('only ', text)
 ELSE concat('INSIGHTS:\n- **', text, '**\n\nRELEVANT_IDS:\n[', CAST(k % 7 AS VARCHAR(20)), ', ',
  CAST(k % 13 AS VARCHAR(20)), ', ', CAST(k % 7 AS VARCHAR(20)), ', 1, 2, 3, 4, 99]',
  CASE WHEN k % 4 = 1 THEN ' RELEVANT_IDS: 5' ELSE '' END) END AS raw
FROM (SELECT k, review_id, coalesce(text, '') AS text FROM {reviews}) r"""


def _insight_replies(spark, sf):
    return spark.sql(INSIGHT_REPLIES, reviews=reviews(spark, sf))


@query("ins_2_insight_text", with_views("reviews", """
SELECT review_id, CASE WHEN k % 4 = 0 THEN concat('only ', coalesce(text, ''))
 ELSE concat('- **', coalesce(text, ''), '**') END AS insights FROM reviews"""))
def ins_2(spark, sf):
    return _insight_replies(spark, sf).select("review_id", insight_text(F.col("raw")).alias("insights"))


_CITED = """
SELECT review_id, n, min(i) AS i FROM
 (SELECT review_id, unnest(ids) AS n, unnest(range(len(ids))) AS i, size FROM
  (SELECT review_id, k % 20 AS size, CASE WHEN k % 4 = 0 THEN []
    ELSE [k % 7, k % 13, k % 7, 1, 2, 3, 4, 99] END AS ids FROM reviews) a) b
WHERE n < size GROUP BY review_id, n"""


@query("ins_3_cited_ids", with_views("reviews", """
SELECT r.review_id, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY i), '') AS cited
FROM reviews r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY i) AS rn
 FROM cited) c ON r.review_id = c.review_id AND rn <= 5 GROUP BY 1""", cited=_CITED))
def ins_3(spark, sf):
    cited = cited_positions(F.col("raw"), F.col("sample_size"))
    return _insight_replies(spark, sf).select("review_id", F.array_join(cited, ",").alias("cited"))


@query("flt_13_cited_in_range", with_views("reviews", """
SELECT r.review_id, count(rn) AS cited FROM reviews r
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY i) AS rn FROM cited) c
 ON r.review_id = c.review_id AND rn <= 5 GROUP BY 1""", cited=_CITED))
def flt_13(spark, sf):
    cited = cited_positions(F.col("raw"), F.col("sample_size"))
    return _insight_replies(spark, sf).select("review_id", F.size(cited).cast("bigint").alias("cited"))


@query("top_4_first_citations", with_views("reviews", """
SELECT r.review_id, coalesce(max(n) FILTER (rn = 1), -1) AS first_id,
 coalesce(max(n) FILTER (rn = 5), -1) AS fifth_id FROM reviews r
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY i) AS rn FROM cited) c
 ON r.review_id = c.review_id GROUP BY 1""", cited=_CITED))
def top_4(spark, sf):
    df = _insight_replies(spark, sf).withColumn(
        "cited", cited_positions(F.col("raw"), F.col("sample_size"))
    )
    none = F.lit(-1).cast("bigint")
    return df.select(
        "review_id", F.coalesce(F.get("cited", F.lit(0)), none).alias("first_id"),
        F.coalesce(F.get("cited", F.lit(4)), none).alias("fifth_id"),
    )


def analyst():
    """Stands for a model: cites three reviews, one twice, and one that does not exist."""

    def answer(prompt: str) -> str:
        return f"INSIGHTS:\n- {prompt.count('Review ')} reviews\nRELEVANT_IDS:\n[7, 0, 7, 3, 999]"

    return answer


@query("ins_4_insights", with_views("choices", """
SELECT Theme, sentiment, concat('- ', CAST(count(*) AS VARCHAR), ' reviews') AS insights
FROM sample GROUP BY 1, 2""", sample=SAMPLE_SQL))
def ins_4(spark, sf):
    found, _ = ins.insights(scored(spark, sf), analyst(), parallel_calls=8)
    return found.drop("cited", "error")


@query("jon_5_cited_reviews", with_views("choices", """
SELECT s.Theme, s.sentiment, CAST(CASE position WHEN 7 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS BIGINT)
 AS citation, s.review_id, r.clean_text
FROM sample s JOIN scored r ON s.review_id = r.review_id WHERE position IN (7, 0, 3)""",
    sample=SAMPLE_SQL))
def jon_5(spark, sf):
    _, cited = ins.insights(scored(spark, sf), analyst(), parallel_calls=8)
    return cited.select(
        "Theme", "sentiment", F.col("citation").cast("bigint").alias("citation"), "review_id",
        "clean_text",
    )


@query("udf_1_failed_calls", with_views("reviews", """
SELECT concat('RuntimeError: no ', theme) AS error, count(*) AS calls FROM
 (SELECT CASE o_orderkey % 5 WHEN 1 THEN 'answer' WHEN 3 THEN 'connection' END AS theme FROM orders) o
WHERE theme IS NOT NULL GROUP BY 1"""))
def udf_1(spark, sf):
    """Model calls that fail, counted by error: one prompt per order."""
    kind = F.when(F.col("o_orderkey") % 5 == 1, "answer").when(F.col("o_orderkey") % 5 == 3, "connection")
    prompts = table(spark, sf, "orders").select("o_orderkey", F.coalesce(kind, F.lit("")).alias("prompt"))

    def ask(prompt):
        if prompt:
            raise RuntimeError(f"no {prompt}")
        return "yes"

    return th.failed_calls(th.written_replies(pin(prompts, "prompts"), ask, parallel_calls=8))


@query("udf_2_literal_replies", _with("replies", """
SELECT batch_id, CASE batch_id % 12 WHEN 2 THEN concat('1: [" ', lower(t1), ' "]|2: ', upper(t2))
 WHEN 6 THEN concat('1: ["', t1, '","', t1, '"]|2: [{"theme":"', t2, '"}]')
 WHEN 7 THEN concat('1: ["', t1, '","Parking"]|2: ["', t2, '"]')
 WHEN 8 THEN concat('1: ["Parking"]|2: ["', t2, '"]')
 WHEN 9 THEN concat('2: ["', t2, '"]')
 WHEN 11 THEN NULL
 ELSE concat('1: ["', t1, '"]|2: ["', t2, '"]') END AS entries
FROM replies"""))
def udf_2(spark, sf):
    """All replies, read as literals: keys and values of their objects, null where there is no object."""
    rows = replies(spark, sf)
    found = F.from_json(literal_objects(json_span(F.col("raw"))), "array<map<string,string>>")
    # Entries in the order of their keys; lists stay JSON text.
    pairs = F.transform(reply_entries(found), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return rows.select("batch_id", F.array_join(F.array_sort(pairs), "|").alias("entries"))
