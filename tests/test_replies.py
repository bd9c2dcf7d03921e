"""Reply reading against a plain Python reading of the same texts."""

import ast
import json
import random

import pytest

from opinara.functions.replies import cited_positions, insight_text
from opinara.operators.themes import parsed_replies, review_themes
from opinara.vocab import THEMES
from pyspark.sql import functions as F

SERVICE, SPEED, PRICE = "Customer Service", "Speed of Service", "Price and Value"

CANNED = [
    (f'{{"1":["{SERVICE}"],"2":["{SPEED}"]}}', [[SERVICE], [SPEED]], True),
    (f'Well: {{"1":["{SERVICE}"],"2":["{SPEED}"]}} done', [[SERVICE], [SPEED]], True),
    ("{'1': ['customer service'], '2': 'SPEED OF SERVICE'}", [[SERVICE], [SPEED]], True),
    (f'[{{"1":["{SERVICE}"]}},{{"2":["{PRICE}"]}}]', [[SERVICE], [PRICE]], True),
    (f'{{"1":["{SERVICE}"]}},{{"2":["{PRICE}"]}}', [[SERVICE], [PRICE]], False),
    (f'{{1: ["{SERVICE}"], 2: ["{PRICE}"]}}', [[SERVICE], [PRICE]], False),
    (f'{{"1":["{SERVICE}","{SERVICE}"],"2":[{{"theme":"{PRICE}"}}]}}', [[SERVICE], [PRICE]], True),
    (f'{{"1":["{SERVICE}","Parking"],"2":["{PRICE}"]}}', [[SERVICE], [PRICE]], True),
    (f'{{"1":["{SERVICE}"],"2":["Parking"]}}', None, None),
    (f'{{"1":["{SERVICE}"]}}', None, None),
    (f'{{"1":["{SERVICE}",],"2":["{PRICE}"]}}', [[SERVICE], [PRICE]], True),
    ("no json here", None, None),
    (None, None, None),
    (f'{{"1":["Parking"],"2":["{PRICE}"],"1":["{SERVICE}"]}}', [[SERVICE], [PRICE]], True),
    (f'[{{"1":["{PRICE}"]}},{{"1":["{SERVICE}"],"2":{{"name":"{PRICE}"}}}}]', [[SERVICE], [PRICE]], True),
    (f'{{"1":["{SERVICE}"],"2":["{PRICE}"]}}, {{"3": null}}', [[SERVICE], [PRICE]], True),
    ("}{", None, None),
    (f'[["{SERVICE}"],["{PRICE}"]]', None, None),
]


def _read(span, strict):
    for reader in (json.loads, ast.literal_eval):
        try:
            return reader(span)
        except Exception:
            pass
    try:
        return json.loads(f"[{span}]") if span[0] == "{" and span[-1] == "}" else None
    except ValueError:
        return None


def expected(raw, size, strict):
    """Themes per review by Python's own parsers, or None if the batch fails."""
    opening = [i for i in (raw.find("{"), raw.find("[")) if i >= 0]
    end = max(raw.rfind("}"), raw.rfind("]")) + 1
    if not opening or end <= min(opening):
        return None
    data = _read(raw[min(opening):end], strict)
    if isinstance(data, tuple) and not strict:
        data = list(data)
    if isinstance(data, dict):
        data = [data]
    if not isinstance(data, list):
        return None
    merged = {}
    for item in data:
        if isinstance(item, dict):
            merged.update(item if strict else {str(k): v for k, v in item.items()})
    spelling = {t.lower(): t for t in THEMES}
    out = []
    for n in range(1, size + 1):
        names = merged.get(str(n), [])
        names = names if isinstance(names, list) else [names]
        names = [next(iter(x.values())) if isinstance(x, dict) and x else x for x in names]
        found = [spelling[s] for s in (str(x).strip().lower() for x in names) if s in spelling]
        if not found:
            return None
        out.append(list(dict.fromkeys(found)))
    return out


def parse(spark, raws, strict, size=2):
    df = spark.createDataFrame(
        [(i, size, r) for i, r in enumerate(raws)], "batch_id long, size int, raw string"
    )
    rows = parsed_replies(df, strict=strict).orderBy("batch_id").collect()
    return [r["by_position"] if r["ok"] else None for r in rows]


@pytest.mark.parametrize("strict", [False, True])
def test_canned(spark, strict):
    want = [themes if not strict or valid else None for _, themes, valid in CANNED]
    assert parse(spark, [raw for raw, _, _ in CANNED], strict) == want
    assert want == [expected(raw, 2, strict) if raw else None for raw, _, _ in CANNED]


def random_reply(rng):
    """A reply text: objects in one of several forms, maybe broken, maybe within prose."""
    names = [SERVICE, SPEED.lower(), f" {PRICE} ", "Parking", "", "a'b"]

    def item():
        return rng.choice([rng.choice(names), {rng.choice(["theme", "x"]): rng.choice(names)}, {}, None, 3])

    def entry():
        return rng.choice([[item() for _ in range(rng.randint(0, 3))], [rng.choice(names)], rng.choice(names), None])

    def one():
        if rng.random() < 0.5:
            return {n: [rng.choice(names[:3]), item()] for n in "12"}
        return {rng.choice(["1", "2", "3"]): entry() for _ in range(rng.randint(0, 4))}

    dump = rng.choice([json.dumps, repr, lambda o: json.dumps(o, indent=1)])
    several = [one() for _ in range(rng.randint(1, 3))]
    body = rng.choice([dump(several[0]), dump(several), ", ".join(map(dump, several))])
    if rng.random() < 0.3:
        cut = rng.randint(0, len(body))
        body = body[:cut] + rng.choice([",", "}", "]", "x", "[", "{"]) + body[cut:]
    return rng.choice(["", "Sure: ", "x} "]) + body + rng.choice(["", "\nBye.", "]"])


@pytest.mark.parametrize("strict", [False, True])
def test_like_python(spark, strict):
    rng = random.Random(7)
    texts = [random_reply(rng) for _ in range(6000)]
    want = [expected(t, 2, strict) for t in texts]
    got = parse(spark, texts, strict)
    wrong = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not wrong, (len(wrong), wrong[:5])
    assert sum(w is not None for w in want) > 1000


def test_failed_batch_marks_every_review(spark):
    df = spark.createDataFrame(
        [(0, 2, CANNED[0][0]), (1, 2, CANNED[8][0])], "batch_id long, size int, raw string"
    )
    rows = review_themes(parsed_replies(df)).orderBy("batch_id", "position").collect()
    assert [r["themes"] for r in rows] == [SERVICE, SPEED, "FAILED", "FAILED"]


def test_insight_reply(spark):
    raws = [
        "INSIGHTS:\n- a\nRELEVANT_IDS:\n[3, 1, 3, 99]", "whole reply", None,
        "RELEVANT_IDS: 1 2 3 4 5 6 7", "INSIGHTS: x RELEVANT_IDS: 0 RELEVANT_IDS: 4",
        "RELEVANT_IDS: 99999999999999999999 -2",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    rows = df.orderBy("i").select(
        insight_text(F.col("raw")), cited_positions(F.col("raw"), F.lit(10))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("- a", [3, 1]), ("whole reply", []), (None, []), ("", [1, 2, 3, 4, 5]), ("x", [0]),
        ("", [2]),
    ]
