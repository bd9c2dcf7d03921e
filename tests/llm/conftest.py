"""A small corpus with every odd case, and its columns' clashing names."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

WORDS = "the of and to ing er tion ent re on an in he th at or is it ar te se hi of al".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
        out.append(word.capitalize() + "." if i % 9 == 0 else word)
    return " ".join(out)


def changed(text: str, every: int) -> str:
    words = text.split(" ")
    return " ".join("changed" if i % every == every // 2 else w for i, w in enumerate(words))


def odd_rows() -> list[tuple]:
    base = [prose(i, 40 + 17 * i) for i in range(12)]
    texts = [
        *base,
        base[3],
        base[3].replace(" ", "  "),
        base[3].upper(),
        changed(base[9], 60),
        changed(base[9], 3),
        changed(changed(base[9], 60), 71),
        base[5] + "\nLicensed under CC BY-NC 4.0.",
        base[6] + " This work is licensed under the GNU General Public License, version 3. All rights reserved.",
        "cc by cc by, CC-BY",
        "Write to a.b@mail.example.com or +49 (171) 555-1234, host 10.0.0.255, 256.1.1.1",
        "4111 1111 1111 1111 and 4111111111111112, IBAN GB82 WEST 1234 5698 7654 32, see https://a.b/c.",
        "", " \n\t ", "!!!", "one", "two words", "one",
        "x" * 30_000, "ab " * 20_000, "=" * 5000, " " * 3000 + "end",
        "é😀中文 ñandú Straße İ K ſ́ \x00 ﻿​ ▁▁ <|endoftext|> <s> </s> <unk> ΑΣ Σ",
        "line\r\nbreak\tand blank wide\x1c\x85　it's we'll I'VE 123 4567",
        None, None,
    ]
    rows = [(10 * i + 1, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (rows[4][0], base[7], "en"), (None, base[8], "en"), (None, None, None)]
    return rows


def as_documents(spark, rows):
    ids, texts, languages = zip(*rows) if rows else ((), (), ())
    n = len(rows)
    table = pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()),
        "lang": pa.array(languages, pa.string()), "source": pa.array([None] * n, pa.string()),
        "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
        **{name: pa.array([f"own {name}"] * n, pa.string()) for name in (
            "id", "row", "kept", "n", "digest", "component", "block", "words", "_lang", "_text", "c1", "hash", "spans", "_kept_id", "_kept", "own_id", "_own_id", "_own_digest", "own_digest",
            "_own_characters", "_slot", "_part", "_row", "_key", "_size", "digest_of", "kept_n", "point", "key",
        )},
    })
    return spark.createDataFrame(table)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def odd(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    as_documents(spark, rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return as_documents(spark, [])
