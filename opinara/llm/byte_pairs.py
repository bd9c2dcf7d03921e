"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens. A task keeps its documents in blocks: the distinct pre-tokens of
a block, and per document the places of its pre-tokens in that list. The lists are exploded and
shuffled by word, so that each distinct word of the corpus is encoded once; the ids go back to
the blocks, where documents are put together by position. Decoding looks up the bytes of each
id in the token table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from opinara.llm.common import Ragged, byte_table, cut_texts, id_and_text, in_parts, pack_rows, task_number, unpack_rows

# A block is closed at so many bytes of text; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
# Encoded words that a task holds before it sends them to their blocks.
ANSWER_ROWS = 1 << 20

_BLANK = byte_table(ord(" "))
# First bytes of characters that are no white space: those of U+0085, U+00A0, U+1680, U+2000 to
# U+205F and U+3000, and with them some others, are left out.
_SOLID = byte_table(range(0x21, 0x7F), range(0xC3, 0xE1), range(0xE4, 0xF5))
_NOWHERE = byte_table()


class _Places(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


@cache
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    """The rank file as a table from id to bytes."""
    with open(path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {token: rank for rank, token in token_bytes(path).items()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class TokenTable:
    """Bytes of all ids in one array, with where each starts."""

    def __init__(self, path: str):
        table = token_bytes(path)
        last = max(table, default=-1) + 1
        self.sizes = np.array([len(table.get(i, b"")) for i in range(last)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all = np.frombuffer(b"".join(table.get(i, b"") for i in range(last)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.all[shift + np.arange(len(shift))].tobytes()


@cache
def token_table(path: str) -> TokenTable:
    return TokenTable(path)


def _closed_at(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of the batches, and whether a block of about `size` bytes of text ends with each.

    Where a block ends depends on the texts alone, not on how rows come in batches.
    """
    held: pa.RecordBatch | None = None
    filled = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, done + size - filled, side="right"))
            if end <= begin:
                if held is not None:
                    yield held, True
                    held, filled = None, 0
                    continue
                end = begin + 1
            if held is not None:
                yield held, False
            held = batch.slice(begin, end - begin)
            filled += int(ends[end - 1] - done)
            begin = end
    if held is not None:
        yield held, True


def _split(texts: pa.StringArray, split, places: _Places, at_blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pre-tokens of all texts, one after the other, and how many each text has."""
    chunks, per = cut_texts(texts, _BLANK if at_blanks else _NOWHERE, _SOLID)
    found = [split(chunk) for chunk in chunks.dictionary.to_pylist()]
    flat = np.fromiter((places[word] for own in found for word in own), np.uint32)
    words = Ragged(flat, np.array([len(own) for own in found], np.int64))
    rows = chunks.indices.to_numpy()
    upto = np.append(0, np.cumsum(words.lengths[rows]))
    return words.take(rows), np.diff(upto[np.append(0, np.cumsum(per))])


def blocks(df: DataFrame, pattern: str, id_column: str, text_column: str, at_blanks: bool = False) -> DataFrame:
    """Rows (block, words, docs): each block's distinct pre-tokens and its documents.

    A block is named by a hash of its place, task and number, and of what it holds, so blocks of
    equal texts stay apart. If the rows are dealt to tasks differently when they are read again,
    the names differ, too, and `encode_and_decode` ends with an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(pattern).findall
        task, number = task_number(), 0
        places, ids, own, lengths = _Places(), [], [], []
        for part, closed in _closed_at(in_parts(batches), BLOCK_BYTES):
            found, per = _split(part.column(1), split, places, at_blanks)
            ids.append(part.column(0))
            own.append(found)
            lengths.append(per)
            if closed:
                name = np.array([task, number], np.int64).tobytes()
                yield _block(name, places, pa.chunked_array(ids), np.concatenate(own), np.concatenate(lengths))
                number += 1
                places, ids, own, lengths = _Places(), [], [], []

    rows = id_and_text(df, id_column, text_column)
    return rows.mapInArrow(run, "block bigint, words array<string>, docs binary")


def _block(place: bytes, places: _Places, ids: pa.ChunkedArray, own: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    block = xxhash.xxh64(place)
    block.update("\0".join(places))
    block.update(own.tobytes())
    block.update(lengths.tobytes())
    docs = pa.table({
        "doc_id": ids, "places": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(own)),
    })
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block.intdigest() - (1 << 63)], pa.int64()),
        "words": pa.array([list(places)], pa.list_(pa.string())),
        "docs": pa.array([pack_rows(docs)], pa.binary()),
    })


def encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (block, place, word) to rows (block, answers); equal words are encoded once.

    Words are shuffled by word and sorted, so that equal ones follow each other. A task packs
    the ids that it has for one block, with their places, into few compressed rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        last, ids = None, []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            column = batch.column(2)
            new = np.append(True, pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))
            firsts = column.take(pa.array(np.flatnonzero(new))).to_pylist()
            if ids and firsts[0] == last:
                new[0], firsts = False, firsts[1:]
            # The number of each row's word among those held.
            number = len(ids) - 1 + np.cumsum(new)
            ids += [np.array(encode(word), "<u4").tobytes() for word in firsts]
            last = firsts[-1] if firsts else last
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), number))
            n += batch.num_rows
            if n > ANSWER_ROWS:
                yield _answers(held, ids)
                last, ids, held, n = None, [], [], 0
        if held:
            yield _answers(held, ids)

    ordered = words.select("block", "place", "word").repartition("word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "block bigint, answers binary")


def _answers(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: list[bytes]) -> pa.RecordBatch:
    """One row per block: its places in rising order with their ids."""
    block, place, number = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((place, block))
    block, place, number = block[order], place[order], number[order]
    words = Ragged(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64))
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    packed = []
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(block)]):
        own = number[begin:end]
        packed.append(pack_rows(pa.table({
            "step": np.diff(place[begin:end].astype(np.int64), prepend=0).astype(np.uint32),
            "ids": pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(words.lengths[own])), pa.int32()), pa.array(words.take(own))
            ),
        })))
    return pa.RecordBatch.from_pydict({
        "block": pa.array(block[starts], pa.int64()), "answers": pa.array(packed, pa.binary())
    })


def _by_place(answers: Iterable[bytes]) -> Ragged:
    """The ids of a block's words in the order of their places."""
    places, lengths, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for packed in answers:
        own = unpack_rows(packed)
        ids = own.column("ids").combine_chunks()
        places.append(np.cumsum(own.column("step").to_numpy(), dtype=np.int64))
        lengths.append(np.diff(ids.offsets.to_numpy()).astype(np.int64))
        values.append(ids.flatten().to_numpy())
    order = np.argsort(np.concatenate(places), kind="stable")
    words = Ragged(np.concatenate(values), np.concatenate(lengths))
    return Ragged(words.take(order), words.lengths[order])


def encode_and_decode(
    df: DataFrame,
    path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
    at_blanks: bool = False,
) -> DataFrame:
    """Encode every whole text by the rank file `path` and decode the ids again.

    Per row: `doc_id`, `n_tokens`, `ids_sha256` (of the ids as little-endian unsigned 32-bit
    integers), `decoded_sha256` (of the decoded bytes) and, on request, `ids` (those bytes). A
    null text counts as empty (0 tokens); repeated rows and null ids give a row each; an empty
    table gives none. A text longer than a block is one of its own, held by one task. `df` is read
    twice and must hold the same rows both times, as stored tables do.

    `at_blanks` states of the pattern that a text may be cut before a blank that no white space
    follows, without a change of its matches. Then equal chunks of a batch are split only once.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids binary"
    cut = blocks(df, pattern, id_column, text_column, at_blanks)
    words = cut.select("block", F.posexplode("words").alias("place", "word"))
    encoded = encode_words(words, path, pattern)

    def put_together(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not docs.num_rows:
            raise RuntimeError("the documents changed between two reads")
        table, of_place = token_table(path), _by_place(words.column("answers").to_pylist())
        made = []
        for packed in docs.column("docs").to_pylist():
            for doc in unpack_rows(packed).to_batches(max_chunksize=256):
                places, starts = doc.column(1).flatten().to_numpy(), doc.column(1).offsets.to_numpy()
                if len(places) and places.max() >= len(of_place.lengths):
                    raise RuntimeError("the documents changed between two reads")
                ids = of_place.take(places)
                tokens = np.append(0, np.cumsum(of_place.lengths[places]))[starts - starts[0]]
                decoded = np.append(0, np.cumsum(table.sizes[ids]))[tokens]
                data, text = memoryview(ids.astype("<u4", copy=False).tobytes()), memoryview(table.decode(ids))
                own = [data[4 * a:4 * b] for a, b in zip(tokens.tolist(), tokens[1:].tolist())]
                texts = [text[a:b] for a, b in zip(decoded.tolist(), decoded[1:].tolist())]
                columns = {
                    "doc_id": doc.column(0),
                    "n_tokens": pa.array(np.diff(tokens), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([bytes(x) for x in own], pa.binary())
                made.append(pa.table(columns))
        return pa.concat_tables(made)

    both = cut.select("block", "docs").groupBy("block").cogroup(encoded.groupBy("block"))
    return both.applyInArrow(put_together, schema)


def decode(df: DataFrame, path: str, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes of a column of ids (little-endian unsigned 32-bit); null stays null."""
    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        table = token_table(path)
        return ids.map(lambda x: table.decode(np.frombuffer(x, "<u4")), na_action="ignore")

    return df.withColumn(to, decoded(F.col(ids_column)))
