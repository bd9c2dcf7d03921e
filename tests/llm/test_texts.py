"""Personal data, licenses, exact and near duplicates, and quality against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import components, exact_duplicates, licenses, near_duplicates, personal_data, quality
from opinara.llm.personal_data import KINDS, find_spans, luhn
from opinara.session import new_path
from tests.llm.conftest import as_documents, changed, prose

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def right(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    spans = [(k, *m.span()) for k, p in PATTERNS.items() for m in p.finditer(text) if right(k, m.group())]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def test_spans_of_random_texts():
    rng = random.Random(5)
    sets = ["0123456789 -", "+0123456789().- ", "ab@.-a1", "1.2.3.4.25", "@.ab c", "4111 1111 1111 1111 ", "é😀\n"]
    for _ in range(30_000):
        text = "".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(0, 45)))
        text += rng.choice(["", "4111111111111111", "+49 171 1234567", "a.b@c.de.f", "10.0.0.255"]) + text[:9]
        assert [s for s in find_spans(text) if s[0] in personal_data.BASE_KINDS] == brute_spans(text), text


def test_more_spans():
    text = "IBAN: GB82 WEST 1234 5698 7654 32. see https://a.b/c?d=1). account no 12345678, IBAN GB82 WEST 1234"
    assert find_spans(text) == [("account", 6, 33), ("url", 39, 56), ("account", 70, 78)]
    assert personal_data.redact_text(text).startswith("IBAN: [ACCOUNT]. see [URL]). account no [ACCOUNT],")


@pytest.mark.parametrize("text, value", [
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ("access_token=ya29.A0ARrdaM9x8Y7z6W5v4. Then", "ya29.A0ARrdaM9x8Y7z6W5v4"),
    ("'API_KEY': 'sk-abc123def456ghi789jkl',", "sk-abc123def456ghi789jkl"),
    ('password="hunter!"', "hunter!"),
    ("TOKEN: " + "a1" * 5000, "a1" * 5000),
    ("the token is here: no", None),
    ("tokens: many things happen", None),
    ("mytoken=abcdef0123456789abcdef", None),
    ("token: internationalization", None),
    ('password="[SECRET]"', None),
])
def test_secrets(text, value):
    assert [text[a:b] for kind, a, b in find_spans(text) if kind == "secret"] == ([value] if value else [])
    assert not find_spans(personal_data.redact_text(text))


def test_personal_data(odd, rows, none):
    got = personal_data.personal_data(odd).collect()
    want = Counter((d, tuple(find_spans(t or ""))) for d, t, _ in rows)
    assert Counter((r.doc_id, tuple(tuple(s) for s in r.spans)) for r in got) == want
    assert personal_data.personal_data(none).count() == 0
    redacted = personal_data.redact(odd)
    assert redacted.columns == odd.columns
    want = Counter((d, None if t is None else personal_data.redact_text(t)) for d, t, _ in rows)
    assert Counter(tuple(r) for r in redacted.select("doc_id", "text").collect()) == want
    assert not any(find_spans(t) for _, t in want if t)


def brute_license(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text))
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        own = phrase.split(" ")
        at = [i for i in range(len(words)) if words[i:i + len(own)] == own]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark, odd, rows, none):
    got = licenses.licenses(odd).collect()
    want = Counter((d, *brute_license(t or "")) for d, t, _ in rows)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score > 0) == bool(r.labels)
    assert licenses.licenses(none).count() == 0
    plan = licenses.licenses(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("licensed under the well known Apache License, version 2.0", "apache-2.0"),
    ("Released under the MIT licence", "mit"),
    ("Released, the license is under MIT", ""),
    ("all rights are reserved", ""),
    ("x all rights reserved all rights reserved", "reserved"),
])
def test_labels(spark, text, labels):
    got = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == labels
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, ? AS text", [text])
    cursor = con.sql(licenses.LICENSES_SQL)
    assert dict(zip(cursor.columns, cursor.fetchall()[0])) == got.asDict()


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_duplicates(odd, rows, none):
    got = exact_duplicates.exact_duplicates(odd).collect()
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[normalised(t)].append((-len(t or ""), d is not None, d))
    want = Counter()
    for d, t, _ in rows:
        group = groups[normalised(t)]
        digest = hashlib.sha256(normalised(t).encode()).hexdigest()
        want[(d, min(group)[2], len(group), digest)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert len({r.text_sha256 for r in kept}) == len(groups)
    assert exact_duplicates.exact_duplicates(none).count() == 0
    one = exact_duplicates.keep_one_each(odd)
    assert one.columns == odd.columns
    assert Counter((r.doc_id, r.text_sha256) for r in kept) == Counter(
        (r.doc_id, hashlib.sha256(normalised(r.text).encode()).hexdigest()) for r in one.collect()
    )
    assert exact_duplicates.keep_one_each(none).count() == 0


def test_digest_index(spark):
    index = exact_duplicates.DigestIndex(spark, new_path(spark, "test-index"), buckets=4)

    def add(rows, batch):
        given = spark.createDataFrame(rows, "doc_id long, text string")
        return {r.doc_id: r for r in exact_duplicates.exact_duplicates(given, index, batch).collect()}

    first = add([(5, "a b"), (3, "ab"), (7, "c")], "first")
    assert [first[i].keep_id for i in (5, 3, 7)] == [5, 5, 7] and first[5].kept and not first[3].kept
    second = add([(1, "a  b"), (2, "d"), (4, "d")], "second")
    assert [second[i].keep_id for i in (1, 2, 4)] == [5, 2, 2] and [second[i].kept for i in (1, 2, 4)] == [False, True, False]
    assert index.table().count() == 3
    again = add([(1, "a  b"), (2, "d"), (4, "d")], "second")
    assert again[2].kept and index.table().count() == 3
    plan = index.table().join(spark.range(3).selectExpr("unhex(hex(id)) digest").hint("merge"), "digest", "left_anti")
    assert "SortMergeJoin" in plan._jdf.queryExecution().executedPlan().toString()


def brute_classes(texts):
    sets = {
        i: np.unique(near_duplicates.shingle_hashes(near_duplicates.words_of(t or "")), return_counts=True)
        for i, t in texts.items()
    }
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(sets[i][0]) and len(sets[j][0]) and near_duplicates.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def test_near_duplicates(spark, odd, rows, none):
    ids = Counter(d for d, _, _ in rows)
    single = [r for r in rows if ids[r[0]] == 1]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(as_documents(spark, single)).collect()}
    want = brute_classes({d: t for d, t, _ in single if d is not None})
    assert {d: r.class_id for d, r in got.items() if d is not None} == want
    assert Counter(r.class_id for r in got.values() if r.kept) == Counter(set(got[d].class_id for d in got))
    assert all(r.class_size == list(want.values()).count(r.class_id) for d, r in got.items() if d is not None)
    assert near_duplicates.near_duplicates(none).count() == 0
    # With repeated and null ids, too, one row of each class stays.
    every = near_duplicates.near_duplicates(odd).collect()
    assert len(every) == len(rows)
    kept = near_duplicates.keep_one_each(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in every)
    assert near_duplicates.keep_one_each(none).count() == 0


def test_large_class_with_outsiders(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    base = prose(1, 300)
    other = " ".join([*base.split(" ")[:180], *prose(2, 120).split(" ")])
    texts = {i: changed(base, 90 + i) for i in range(60)}
    texts |= {100 + i: changed(other, 90 + i) for i in range(40)}
    texts |= {200 + i: prose(50 + i, 60) for i in range(20)}
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(given).collect()}
    assert got == brute_classes(texts)


def test_copies_of_all_degrees(spark, monkeypatch):
    """Copies of one text with few to many changes: many are linked to some others only."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    base = prose(3, 150)
    texts = {i: changed(changed(base, 11 + 2 * i), 40 + 3 * (i % 17)) for i in range(90)}
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(given).collect()}
    want = brute_classes(texts)
    assert got == want and 1 < len(set(want.values())) < 60


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        elements = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        a, b = rng.integers(1, 9, len(elements)), rng.integers(1, 9, len(elements))
        signature = near_duplicates.signatures([(elements, a), (elements[50:], b[50:]), (elements[:1], a[:1])])
        errors.append((signature[0] == signature[1]).mean() - near_duplicates.similarity((elements, a), (elements[50:], b[50:])))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(1, 90)] + [(5, 5), (7, 6)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {n: n for x in links for n in x}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_model(texts, order):
    """Modified Kneser-Ney by its definition, with dictionaries."""
    grams = Counter()
    for t in texts:
        padded = "\n" * (order - 1) + t
        grams.update(padded[i:i + order] for i in range(len(t)))
    levels = {order: dict(grams)}
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in levels[k + 1]:
            before[g[1:]].add(g[0])
        levels[k] = {g: len(s) for g, s in before.items()}
    cut = {}
    for k, level in levels.items():
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        for i in (1, 2, 3):
            value = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else -1
            cut[k, i] = value if n[i] and n[i + 1] and value > 0 else i - 0.5
    vocabulary = len(levels[1]) + 1

    def p(g):
        if not g:
            return 1 / vocabulary
        k = len(g)
        own = {h: c for h, c in levels[k].items() if h[:-1] == g[:-1]}
        below = p(g[1:])
        if not own:
            return below
        c = own.get(g, 0)
        kept = c - cut[k, min(c, 3)] if c else 0
        return (kept + sum(cut[k, min(x, 3)] for x in own.values()) * below) / sum(own.values())

    return lambda t: -sum(math.log(p(("\n" * (order - 1) + t)[i:i + order])) for i in range(len(t)))


def test_perplexity(spark):
    trusted = {i: prose(i, 30) for i in range(8)}
    others = {20: prose(30, 25), 21: "THE QUICK | FOX", 22: "", 23: None, 24: "é", 25: "zzz " * 50}
    settings = quality.Settings(order=3)
    given = spark.createDataFrame([(i, t, "en") for i, t in {**trusted, **others}.items()] + [(30, "x", "fr")],
                                  "doc_id long, text string, lang string").repartition(3)
    given.write.parquet(path := new_path(spark, "test-documents"))
    ids = spark.createDataFrame([(i,) for i in trusted], "_trusted long")
    got = {r.doc_id: r for r in quality.perplexities(spark.read.parquet(path), ids, settings).collect()}
    nats = brute_model(trusted.values(), 3)
    for i, t in {**trusted, **others}.items():
        assert got[i]._n == len(t or "") and got[i]._nats == pytest.approx(nats(t or ""), rel=1e-9), i
    assert got[30]._nats is None


def test_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([("en", g, c) for g, c in Counter(
        x for t in (prose(i, 50) for i in range(4)) for x in (t[i:i + 2] for i in range(len(t) - 1))
    ).items()], "lang string, gram string, c long")
    letters = sorted({r.gram[1] for r in counts.collect()})
    wanted = spark.createDataFrame([("en", "t" + c) for c in [*letters, "\u0001"]], "lang string, gram string")
    rows = quality.gram_probabilities(counts, wanted, 2).collect()
    # One unknown character stands for all.
    assert sum(r.p for r in rows) == pytest.approx(1.0)


def test_quality(spark, odd, rows, none, sf_dir):
    labels = spark.createDataFrame([(d, 1, 0) for d, t, _ in rows[:12]], "doc_id long, quality int, toxic int")
    got = quality.quality(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in rows)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert {r.kept for r in got if r.doc_id == rows[23][0]} == {True}
    assert quality.quality(none, labels).count() == 0
    nobody = labels.filter("quality = 2")
    assert quality.quality(odd, nobody).filter("kept").count() == len(rows)
    # Held-out labels: most bad documents go, good ones stay.
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = given.filter("doc_id % 3 > 0")
    tested = quality.quality(documents, train).join(given.filter("doc_id % 3 = 0 AND toxic = 0"), "doc_id")
    share = tested.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r.quality: r.kept for r in share}
    assert share[1] > 0.97 and share[0] < 0.3


def kept_shares(found, labels):
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad")
    rows = found.join(labels, "doc_id").groupBy(kind.alias("kind")).agg(F.avg(F.col("kept").cast("double")).alias("kept"))
    return {r.kind: r.kept for r in rows.collect()}


def test_quality_of_many_labels(spark):
    """Labels of sf0.1 that the limits are not chosen by."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    given = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = quality.quality(documents, given.filter("doc_id % 3 > 0"))
    share = kept_shares(found, given.filter("doc_id % 3 = 0"))
    assert share["good"] > 0.97 and share["bad"] < 0.08 and share["toxic"] < 0.6


def test_limits_on_both_sides(spark):
    rows = [("en", 2 + i / 1000, "held") for i in range(100)] + [("en", 2 + i / 1000, "fitted") for i in range(100)]
    rows += [("en", 0.5, "bad")] * 30 + [("en", 4.0, "bad")] * 30
    rows += [("de", 2 + i / 1000, "held") for i in range(100)]
    given = spark.createDataFrame(rows, "_lang string, _mean double, _kind string").withColumn("_middle", F.lit(2.05))
    got = {r._lang: r for r in quality.limits(given, quality.Settings(slack=0.0)).collect()}
    assert 0.5 < got["en"]._low < 2 and 2.099 <= got["en"]._high < 4
    assert got["de"]._low is None and got["de"]._high == pytest.approx(2.099, abs=0.002)


def test_small_languages_keep_their_rows(spark):
    assert quality.largest_share([5, 1000, 3000], 1005) == 500
    assert quality.largest_share([5, 6], 11) == float("inf")
    rows = [(i, "en" if i >= 40 else "de") for i in range(4000)]
    given = spark.createDataFrame(rows, "_trusted long, _lang string")
    got = {r._trusted for r in quality.fitted_ids(given, quality.Settings(trusted_limit=540)).collect()}
    assert set(range(40)) <= got and 440 < len(got) < 640


def test_language_without_held_out_rows(spark):
    held = {r.id for r in spark.range(400).filter(
        F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(100)) < quality.Settings().held_out).collect()}
    rare = next(i for i in range(400) if i not in held)
    rows = [(i, prose(i, 60), "it" if i == rare else "en") for i in range(400)]
    rows += [(1000, "#@~ ]]{ " * 40, "it"), (1001, prose(rare, 60), "it"), (1002, "#@~ ]]{ " * 40, "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path := new_path(spark, "rare"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(spark.read.parquet(path), labels).collect()}
    assert not got[1000].kept and got[1000].threshold is not None
    assert got[1001].kept and got[1002].kept and got[1002].perplexity is None


NEAR_MISSES = [
    ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("Licensed under CC BY-ND 4.0", "cc-by,cc-by-nd-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC BY-NC 3.0", "cc-by,cc-by-nc-3.0"),
    ("Licensed under CC BY-NC 2.5", "cc-by"),
    ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
    ("Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
     "cc-by-nc-nd-4.0"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3", "gpl,lgpl-3.0"),
    ("Licensed under the Apache License, Version 1.1", "apache-1.1"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Licensed under the Apache License, Version 3.0", ""),
]


def test_near_misses(spark):
    """Labels by hand; `gpl` and `cc-by` are the fixed base phrases."""
    given = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NEAR_MISSES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.licenses(given).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(NEAR_MISSES)] == NEAR_MISSES


def test_two_indexes_with_one_tail(spark, tmp_path):
    tail = "a-folder-name-that-is-longer-than-forty-eight-characters/index"
    docs = as_documents(spark, [(5, "the same text", "en")])
    kept = []
    for place in ("one", "two"):
        index = exact_duplicates.DigestIndex(spark, f"{tmp_path}/{place}/{tail}")
        kept.append(exact_duplicates.exact_duplicates(docs, index).first())
    assert all(r.kept and r.keep_id == 5 for r in kept)
    again = exact_duplicates.DigestIndex(spark, f"{tmp_path}/one/./{tail}/")
    assert again.table().count() == 1


def test_quality_counts_all_trusted_rows(spark):
    given = spark.range(1_100_000).selectExpr("id AS _trusted", "'en' AS _lang")
    assert quality.fitted_ids(given, quality.Settings()).count() == 1_100_000
