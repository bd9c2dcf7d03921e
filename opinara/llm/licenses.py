"""License scan by diagonal voting, with built-in functions only.

All rolling word pairs of the documents meet the word pairs of the license templates in one
join. A pair at word p of a document and word q of a template votes for the diagonal p - q.
Votes are summed by diagonal, neighbouring diagonals (a word put in or left out) are merged,
and a span is verified by the share of the template that it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opinara.llm.common import id_and_text
from opinara.session import local_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_AROUND_WORD = f"{_OTHER}*({WORD}){_OTHER}*|{_OTHER}+"

# Phrases that must stand word by word, and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Opening words of public license notices, and labels of the method's own.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the "
     "gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

# Words of each notice that tell it from its siblings: all their pairs must be in a span.
REQUIRED = (
    ("apache license", "version 2 0"), ("the mit",), ("person obtaining",), ("by nc 4 0",),
    ("creative commons attribution 4 0",), ("gnu general public license version 3",),
    ("gnu general public license",), (), ("mozilla public license v 2 0",), ("unencumbered software",),
)


def _siblings() -> list[tuple[str, str, tuple[str, ...]]]:
    """Notices of licenses that read much like NOTICES, with their labels and required words."""
    out = []
    for number in ("1 0", "1 1"):
        out.append((f"licensed under the apache license version {number}", f"apache-{number.replace(' ', '.')}",
                    ("apache license", f"version {number}")))
    long = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    for version, scope in (("3 0", "unported"), ("4 0", "international")):
        for more in ("", "nc", "sa", "nd", "nc sa", "nc nd"):
            label = "-".join(["cc-by", *more.split(), version.replace(" ", ".")])
            own = " ".join(["by", *more.split(), version])
            if label != "cc-by-nc-4.0":
                out.append((f"licensed under cc {own}", label, (own,)))
            own = " ".join(["creative commons attribution", *[long[m] for m in more.split()], version])
            if label != "cc-by-4.0":
                out.append((f"licensed under a {own} {scope} license", label, (own,)))
    for name, label, version in (
        ("general", "gpl-2.0", "2"), ("lesser general", "lgpl-2.1", "2 1"), ("lesser general", "lgpl-3.0", "3"),
        ("affero general", "agpl-3.0", "3"),
    ):
        own = f"gnu {name} public license version {version}"
        out.append((f"this work is licensed under the {own}", label, (own,)))
    for name, label in (("lesser", "lgpl"), ("affero", "agpl")):
        own = f"gnu {name} general public license"
        phrase = next(p for p, old in NOTICES if old == "gpl")
        out.append((phrase.replace("gnu general public license", own), label, (own,)))
    own = "mozilla public license version 1 1"
    out.append((f"the contents of this file are subject to the {own}", "mpl-1.1", (own,)))
    out.append(("permission is hereby granted free of charge to any person or organization obtaining a copy of the "
                "software and accompanying documentation", "bsl-1.0", ("organization obtaining",)))
    return out


SIBLINGS = _siblings()


def _everyday() -> list[tuple[str, str, tuple[str, ...]]]:
    """Short names as people write them, all of whose words are required."""
    # License identifiers, in words, and their labels.
    identifiers = {
        "mit": "mit", "isc": "isc", "unlicense": "unlicense", "apache 2 0": "apache-2.0", "mpl 2 0": "mpl-2.0",
        "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0",
        "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3.0", "agpl 3 0": "agpl-3.0", "bsl 1 0": "bsl-1.0",
    }
    names = {f"spdx license identifier {words}": label for words, label in identifiers.items()}
    names |= {
        "mit license": "mit", "apache license 2 0": "apache-2.0", "licensed under the gpl": "gpl",
        "released under the gpl": "gpl", "isc license": "isc", "mozilla public license 2 0": "mpl-2.0",
        "permission to use copy modify and or distribute this software for any purpose": "isc",
    }
    return [(phrase, label, (phrase,)) for phrase, label in names.items()]


EVERYDAY = _everyday()

# Words that may be put in or left out between two diagonals of one span.
GAP = 2
# Share of a notice's word pairs that a span must hold.
SHARE = 0.6


def _pair_rows() -> list[tuple]:
    """(template, at, pair, pairs, label, base, required, needed) of each word pair of each template."""
    rows = []
    given = [(*b, ()) for b in BASE] + [(*n, r) for n, r in zip(NOTICES, REQUIRED, strict=True)]
    for number, (phrase, label, required) in enumerate([*given, *SIBLINGS, *EVERYDAY]):
        words = phrase.split(" ")
        needed = set()
        for own in required:
            first = phrase[:f" {phrase} ".index(f" {own} ")].count(" ")
            needed |= set(range(first, first + own.count(" ")))
        rows += [
            (number, at, f"{words[at]} {words[at + 1]}", len(words) - 1, label, number < len(BASE), at in needed,
             len(needed))
            for at in range(len(words) - 1)
        ]
    return rows


def template_pairs(spark: SparkSession) -> DataFrame:
    """Word pairs of all templates: fixed, a few hundred rows.

    One more row, template -1, has the hash 0 and no words; a document's own row meets it.
    """
    rows = [(-1, 0, "", 1, "", False, False, 0), *_pair_rows()]
    names = ("template", "at", "pair", "pairs", "label", "base", "required", "needed")
    given = local_table(spark, **dict(zip(names, map(list, zip(*rows)))))
    own = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("pair"))
    return given.withColumn("hash", own)


def votes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (row, id, place, template, at, ...): a document's pair that equals a template's.

    Of each document there is also one row of template -1, whose `place` is its number of
    words. A match of hashes counts only if the words are equal.
    """
    # Each word w becomes "w<line feed>w ", so that the lines are: the first word, all rolling
    # pairs, and the last word with a blank. A line number is the place of a pair's second word.
    # Of all other letters only the Kelvin sign and the dotted I have a lower case with A-Z in it;
    # with these replaced, lower-casing all letters matches what lower-casing A-Z does.
    text = F.replace(F.replace(F.col("text"), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    lines = F.split(F.regexp_replace(F.lower(text), _AROUND_WORD, "$1\n$1 "), "\n")
    rows = id_and_text(df, id_column, text_column).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "id", F.posexplode(lines).alias("i", "line"))
    last = F.col("line").isin("", " ") | F.col("line").endswith(" ")
    each = each.withColumn("hash", F.when(last, F.lit(0)).otherwise(F.xxhash64("line")))
    # The templates are a fixed list, so their size is known.
    found = each.join(F.broadcast(template_pairs(df.sparkSession)), "hash")
    found = found.filter((F.col("template") < 0) | (F.col("line") == F.col("pair")))
    n_words = F.when(F.col("line") == " ", F.lit(0)).otherwise(F.col("i"))
    place = F.when(F.col("template") < 0, n_words).otherwise(F.col("i") - 1)
    return found.select("row", "id", place.alias("place"), "template", "at", "pairs", "label", "base", "required", "needed")


def spans(voted: DataFrame) -> DataFrame:
    """Merged diagonals (row, id, template, label, base, first, last, share), verified.

    A base phrase needs all its pairs on one diagonal. A notice needs SHARE of its pairs, in
    order, on diagonals that lie at most GAP apart, and among them all required ones.
    """
    # One shuffle by document; all that follows is grouped within it.
    diagonals = (
        voted.repartition("row")
        .withColumn("diagonal", F.col("place") - F.col("at"))
        .groupBy("row", "id", "template", "pairs", "label", "base", "needed", "diagonal")
        .agg(
            F.min("place").alias("first"), F.max("place").alias("last"),
            F.min("at").alias("from"), F.max("at").alias("to"),
            F.collect_set("at").alias("held"),
            F.collect_set(F.when(F.col("required"), F.col("at"))).alias("told"),
        )
    )
    by_place = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    before = {c: F.lag(c).over(by_place) for c in ("diagonal", "last", "to")}
    joins = (
        ~F.col("base")
        & (F.abs(F.col("diagonal") - before["diagonal"]) <= GAP)
        & (F.col("first") > before["last"])
        & (F.col("from") > before["to"])
    )
    share = F.sum(F.size("held")) / F.max("pairs")
    return (
        diagonals.withColumn("new", F.when(joins, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(by_place))
        .groupBy("row", "id", "template", "pairs", "label", "base", "needed", "span")
        .agg(
            F.min("first").alias("first"), F.max("last").alias("last"), share.alias("share"),
            F.sum(F.size("told")).alias("told"),
        )
        .filter(F.col("told") >= F.col("needed"))
        .filter((F.col("template") < 0) | (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(SHARE)))
        .select("row", "id", "template", "label", "base", "first", "last", "share")
    )


def license_spans(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All verified spans: `doc_id`, `label`, `first_word`, `n_words`, `share`."""
    found = spans(votes(df, id_column, text_column)).filter("template >= 0")
    return found.select(
        F.col("id").alias("doc_id"), "label", F.col("first").cast("bigint").alias("first_word"),
        (F.col("last") - F.col("first") + 2).cast("bigint").alias("n_words"), "share",
    )


def licenses(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `df` its words, base phrases and labels.

    `doc_id`, `n_words`, `n_base` (places of base phrases), `first_word` and `last_word` (their
    smallest and largest start, null without one), `base_labels` and `labels` (sorted,
    comma-joined), `score` (largest share of a template found, 0 without one). A null or empty
    text has 0 words and no labels; repeated rows and null ids give a row each.
    """
    found = spans(votes(df, id_column, text_column))
    base = F.col("base") & (F.col("template") >= 0)
    real = F.col("template") >= 0

    def joined(which) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return found.groupBy("row", "id").agg(
        F.max(F.when(~real, F.col("first"))).cast("bigint").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(real).alias("labels"),
        F.round(F.coalesce(F.max(F.when(real, F.col("share"))), F.lit(0.0)), 6).alias("score"),
    ).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
             "base_labels", "labels", "score")


def _sql_templates() -> str:
    rows = []
    for number, at, pair, pairs, label, base, required, needed in _pair_rows():
        first, second = pair.split(" ")
        rows.append(f"({number}, {at}, '{first}', '{second}', {pairs}, '{label}', {base}, {required}, {needed})")
    return ", ".join(rows)


LICENSES_SQL = f"""
WITH t(template, tat, l, r, pairs, label, base, required, needed) AS (VALUES {_sql_templates()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
e AS (SELECT doc_id, words, unnest(range(len(words) - 1)) AS place FROM d),
v AS (SELECT doc_id, place, t.* FROM e JOIN t ON words[place + 1] = l AND words[place + 2] = r),
g AS (SELECT doc_id, template, pairs, label, base, needed, place - tat AS diagonal, min(place) AS first,
 max(place) AS last, min(tat) AS from_at, max(tat) AS to_at, count(DISTINCT tat) AS held,
 count(DISTINCT tat) FILTER (required) AS told FROM v GROUP BY ALL),
x AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER w) <= {GAP} AND first > lag(last) OVER w
 AND from_at > lag(to_at) OVER w THEN 0 ELSE 1 END AS fresh FROM g WHERE NOT base
 WINDOW w AS (PARTITION BY doc_id, template ORDER BY first, diagonal)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY first, diagonal) AS span FROM x),
s AS (SELECT doc_id, label, base, first, 1.0E0 AS share FROM g WHERE base AND held = pairs
 UNION ALL SELECT doc_id, label, base, min(first), sum(held) * 1.0E0 / max(pairs) FROM y
 GROUP BY doc_id, label, base, template, span HAVING sum(held) * 1.0E0 / max(pairs) >= {SHARE}
 AND sum(told) >= max(needed))
SELECT d.doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words,
 count(*) FILTER (base) AS n_base,
 CAST(min(first) FILTER (base) AS BIGINT) AS first_word, CAST(max(first) FILTER (base) AS BIGINT) AS last_word,
 coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
 round(coalesce(max(share), 0.0E0), 6) AS score
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""
