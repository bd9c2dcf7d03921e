"""Token files, packing, token counts and byte pairs against the libraries."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinara.llm import byte_pairs, common, packing, token_counts, token_files
from opinara.session import new_path

WORD_FILE = P.path("word_bpe_49k.json")
RANK_FILE = P.path("byte_bpe_50k.tiktoken")
PIECE_FILE = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoded(rows):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    out = []
    for doc_id, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, np.array([*ids, 2], "<u4")))
    return out


def key(doc_id):
    return (doc_id is not None, doc_id)


def test_token_files(spark, odd, encoded, none):
    path = new_path(spark, "test-token-files")
    files = token_files.write_token_files(odd, path, WORD_FILE, 2)
    assert files.agg(F.sum("n_docs"), F.sum("n_ids")).first()[:] == (len(encoded), sum(len(x) for _, x in encoded))
    got = token_files.read_token_files(spark, path, with_ids=True).collect()
    want = Counter((d, ids.tobytes()) for d, ids in encoded)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=key)
    empty = new_path(spark, "test-no-token-files")
    token_files.write_token_files(none, empty, WORD_FILE, 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_small_files(spark, odd, encoded, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    path = new_path(spark, "test-small-files")
    token_files.write_token_files(odd, path, WORD_FILE, 2)
    got = token_files.read_token_files(spark, path).agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert got[0] == got[1] == sum(len(x) for _, x in encoded)


@pytest.mark.parametrize("values", [
    [], [7], [0] * 256, list(range(1000)), [5, 2**32 - 1] * 400, [2**32 - 1] * 300,
    [random.Random(1).randrange(2**16) for _ in range(70_000)],
    [1 << random.Random(i).randrange(32) for i in range(5000)],
])
def test_blocks(values):
    ids = np.array(values, "<u4")
    file = token_files.TokenFile(token_files.file_bytes([None, 3], np.array([0, len(ids)]), ids))
    assert (file.read(0, len(ids)) == ids).all()
    for start, stop in ((0, 0), (1, len(ids) // 2), (len(ids) // 3, len(ids))):
        if start <= stop:
            assert (file.read(start, stop) == ids[start:stop]).all()


def test_exceptions_are_few():
    ids = np.array([3, 9, 4, 8] * 64, "<u4")
    ids[17] = 1 << 30
    index, words, exceptions = token_files.encode_blocks(ids)
    assert index["width"].tolist() == [3] and index["minimum"].tolist() == [3] and len(words) == 12 and len(exceptions) == 1


def check_pieces(rows, encoded, limits):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = Counter()
    for d, ids in encoded:
        total[d] += len(ids)
    for d, n in total.items():
        assert sum(r.length for r in by_doc[d]) == n
    counted = Counter(d for d, _ in encoded)
    for d, ids in encoded:
        if counted[d] == 1:
            own = sorted(by_doc[d], key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
            assert b"".join(bytes(r.ids) for r in own) == ids.tobytes()
            assert {r.doc_tokens for r in own} == {len(ids)}
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        n = sum(r.length for r in own)
        assert n <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
        padding += 0 if n & (n - 1) == 0 else limits.tokens - n
    return padding


@pytest.mark.parametrize("limits", [
    packing.Limits(), packing.Limits(tokens=64, segments=3, loss=64), packing.Limits(window_tokens=500),
    packing.Limits(tokens=128, segments=8, loss=50),
])
def test_packing(odd, encoded, none, limits):
    rows = packing.pack_texts(odd, WORD_FILE, 2, limits).collect()
    assert check_pieces(rows, encoded, limits) == 0
    assert packing.pack_texts(none, WORD_FILE, 2, limits).count() == 0


def test_packing_of_instructions(spark):
    given = spark.createDataFrame(
        [(i, "say " * (i % 7), "word " * (1 + i % 11)) for i in range(300)], "doc_id long, prompt string, text string"
    ).coalesce(1)
    limits = packing.Limits(tokens=40, segments=4, loss=25)
    rows = packing.pack_texts(given, WORD_FILE, 2, limits, prompt_column="prompt", cut=False).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        assert r.start == 0 and r.length == r.doc_tokens == r.doc_id % 7 + 2 + r.doc_id % 11
        assert r.loss_tokens == 2 + r.doc_id % 11
    for own in sequences.values():
        assert sum(r.length for r in own) <= 40 and len(own) <= 4 and sum(r.loss_tokens for r in own) <= 25
    assert len(rows) == 300 and len(sequences) <= 1.15 * max(
        sum(r.length for r in rows) / 40, 300 / 4, sum(r.loss_tokens for r in rows) / 25
    )


def test_token_counts(odd, rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    got = token_counts.token_counts(odd, PIECE_FILE, 4096).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        n = len(library.encode(text or ""))
        want[(doc_id, len((text or "").encode()), n, n > 4096)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(none, PIECE_FILE, 4096).count() == 0


def test_merging_of_random_texts():
    rng = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    counter = token_counts.PieceCounter(PIECE_FILE)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "▁", "中", "😀", "\x00", "12", "!", "aa", "=", "-", " ", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n + e for n in range(70) for e in ("", "the")] + ["=" * n for n in range(70)]
    assert counter.count(texts) == [len(library.encode(t)) for t in texts]


def test_byte_pairs(odd, rows, none, monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[(doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    for block, at_blanks in ((byte_pairs.BLOCK_BYTES, False), (byte_pairs.BLOCK_BYTES, True), (1000, True)):
        monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", block)
        got = byte_pairs.encode_and_decode(odd, RANK_FILE, P.PATTERN, with_ids=True, at_blanks=at_blanks)
        assert Counter(tuple(r)[:4] for r in got.collect()) == want
    decoded = byte_pairs.decode(got, RANK_FILE).select("decoded_sha256", F.sha2("decoded", 256).alias("own"))
    assert decoded.filter("decoded_sha256 <> own").count() == 0
    assert byte_pairs.encode_and_decode(none, RANK_FILE, P.PATTERN).count() == 0


def test_blocks_of_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", 50)
    text = "the same words again and again, the same again " * 2
    docs = spark.createDataFrame([(i % 7, text) for i in range(40)], "doc_id bigint, text string").repartition(3)
    docs.write.parquet(path := new_path(spark, "equal-texts"))
    got = byte_pairs.encode_and_decode(spark.read.parquet(path), RANK_FILE, P.PATTERN).collect()
    assert len(got) == 40 and {r.decoded_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "The", " ", " ", "  ", "\n", "\t", "'s", "é", "\u0085", "\xa0", "\u2003", "\u3000", "中", "😀", "\x1c", "\x7f", "12", "!", "", "\r\n", "Ω", "က"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_chunks_do_not_change_pre_tokens():
    texts = random_texts(5, 4000)
    split = byte_pairs._splitter(P.PATTERN).findall
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    places = byte_pairs._Places()
    found, per = byte_pairs._split(column, split, places, True)
    words, ends = list(places), np.cumsum(per)
    for text, begin, end in zip(texts, ends - per, ends):
        assert [words[i] for i in found[begin:end]] == split(text)


def test_chunks_join_to_the_texts():
    texts = random_texts(6, 300)
    for column in (pa.array(texts), pa.array(["x y", *texts]).slice(1), pa.array([], pa.string()), pa.array([""])):
        chunks, per = common.cut_texts(column, common.byte_table(ord(" ")))
        own, ends = chunks.to_pylist(), np.cumsum(per)
        assert ["".join(own[a:b]) for a, b in zip(ends - per, ends)] == column.to_pylist()


def test_long_texts_without_blanks():
    rng = random.Random(11)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    counter = token_counts.PieceCounter(PIECE_FILE)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rng.choices(own, k=400_000)) for own in (signs, signs[:16], "的一是不了人", "~中a")] + ["=" * 400_001]
    began = time.process_time()
    counts = counter.count(texts)
    # Linear in the text: some 0.2 seconds each; 20 seconds for the first if all were one row.
    assert time.process_time() - began < 10
    assert counts == [len(library.encode(t)) for t in texts]


def test_word_ids():
    texts = random_texts(7, 3000) + ["~", " ~ ", "a~b ~~", "end.~", "Stop.,;:!?).'s't", "a.b!c?(d)e:f", "é.x H\u0331.", "<|endoftext|>.a<|endoftext|>"]
    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    encoder = common.WordIds(WORD_FILE)
    for end in (2, None):
        ids, lengths = encoder.encode(pa.array(texts), end)
        ends = np.cumsum(lengths)
        got = [ids[a:b].tolist() for a, b in zip(ends - lengths, ends)]
        assert got == [w if end else w[:-1] for w in want]
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()), 2)] == [0, 0]


def test_limits_are_refused():
    for wrong in ({"tokens": 0}, {"loss": 0}, {"segments": 0}):
        with pytest.raises(ValueError):
            packing.Limits(**wrong)
