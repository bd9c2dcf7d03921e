"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import io
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words of this many characters in the cache of one Python worker, before it starts anew.
CACHED_CHARACTERS = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only `id` and `text`, so that no other column of the caller can clash."""
    return df.select(F.col(id_column).cast("bigint").alias("id"), whole_text(text_column).alias("text"))


def cut_texts(
    texts: pa.StringArray,
    cuts: np.ndarray,
    next_to: np.ndarray | None = None,
    between: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts in chunks: the chunks in order, as a dictionary of the distinct ones, and how many each text has.

    A chunk begins at each byte that `cuts`, a table over all bytes, marks, and whose next byte of
    the same text `next_to` marks, if that is given. One begins also between two bytes of which
    the tables `between` mark the first and the second. The chunks of a text join to the text;
    an empty text has none. Nothing is copied before the distinct chunks.
    """
    if not len(texts):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    base = offsets[0]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base:offsets[-1]]
    bounds = offsets - base
    begins = cuts[data]
    written = bounds[1:] > bounds[:-1]
    if next_to is not None:
        begins[:-1] &= next_to[data[1:]]
        # The last byte of a text has no next one.
        begins[bounds[1:][written] - 1] = False
    if between is not None:
        begins[1:] |= between[0][data[:-1]] & between[1][data[1:]]
    begins[bounds[:-1][written]] = True
    places = np.flatnonzero(begins).astype(np.int32)
    per = np.diff(np.searchsorted(places, bounds))
    if not len(places):
        return pa.array([], pa.string()).dictionary_encode(), per
    ends = np.append(places, bounds[-1]).astype(np.int32) + base
    chunks = pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), texts.buffers()[2])
    return chunks.dictionary_encode(), per


def byte_table(*marked: int | range) -> np.ndarray:
    """A table over all bytes that is true for the marked ones."""
    table = np.zeros(256, bool)
    for own in marked:
        table[list(own) if isinstance(own, range) else own] = True
    return table


class Ragged:
    """Rows of unequal length in one array."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The chosen rows, one after the other."""
        lengths = self.lengths[rows]
        shift = np.repeat(self.starts[rows] - (np.cumsum(lengths) - lengths), lengths)
        return self.values[shift + np.arange(len(shift))]


class WordIds:
    """Token ids of texts, each distinct word encoded once per worker.

    Blanks and line feeds always part tokens in the vocabularies used here and are dropped by
    them, and a stop after a letter is parted from it, so a text is the sum of its words, each with
    the blank before it, and of what follows them. Only the distinct words of a batch meet Python. The memory for known words is bounded; when it is used up, words are
    simply encoded again.
    """

    _CUTS = byte_table(ord(" "), ord("\n"))
    _LETTERS = byte_table(range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1))
    _STOPS = byte_table(*b".,;:!?)")
    # Words given to the library as one text, with a sign between them that none of them holds, and such texts at a time.
    _JOINED, _TEXTS = 256, 8
    _SIGN = "~"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        alone = self._tokenizer.encode(f" {self._SIGN} ", add_special_tokens=False).ids
        # No word without the sign has its id, if the sign is one token by itself.
        self._sign_id = alone[0] if len(alone) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        # The first row is the end of a text.
        self._ids = Ragged(np.zeros(1, "<u4"), np.ones(1, np.int64))
        self._characters = 0

    def _encoded(self, words: list[str], joined: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of words, one after the other, and how many each has."""
        sign = f" {self._SIGN} " if joined > 1 else ""
        for start in range(0, len(words), joined * self._TEXTS):
            part = words[start:start + joined * self._TEXTS]
            texts = [sign.join(part[i:i + joined]) + sign for i in range(0, len(part), joined)]
            got = [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(got), "<u4")
            if joined == 1:
                yield ids, np.array(list(map(len, got)), np.int64)
                continue
            signs = ids == self._sign_id
            yield ids[~signs], np.diff(np.flatnonzero(signs), prepend=-1) - 1

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Rows of `_ids` of the words, which are encoded if they are new."""
        if self._characters > CACHED_CHARACTERS:
            self._forget()
        known = self._number
        rows = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            plain = np.array([self._sign_id is not None and self._SIGN not in w for w in new])
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            new, missing, n_plain = [new[i] for i in order.tolist()], missing[order], plain.sum()
            parts = [
                (self._ids.values, self._ids.lengths),
                *self._encoded(new[:n_plain], self._JOINED), *self._encoded(new[n_plain:], 1),
            ]
            first = len(self._ids.lengths)
            self._ids = Ragged(*map(np.concatenate, zip(*parts)))
            known.update(zip(new, range(first, first + len(new))))
            rows[missing] = np.arange(first, first + len(new))
            self._characters += sum(map(len, new)) + 8 * len(new)
        return rows

    def encode(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with `end` behind it, and how many each has."""
        words, per = cut_texts(texts, self._CUTS, between=(self._LETTERS, self._STOPS))
        rows = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        own = rows[words.indices.to_numpy()]
        if end is not None:
            own = np.insert(own, np.cumsum(per), 0)
            per = per + 1
            self._ids.values[0] = end
        upto = np.append(0, np.cumsum(self._ids.lengths[own]))
        return self._ids.take(own), np.diff(upto[np.append(0, np.cumsum(per))])


@cache
def word_ids(path: str) -> WordIds:
    """One encoder per worker and vocabulary."""
    return WordIds(path)


def in_parts(batches: Iterable[pa.RecordBatch], characters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about so many bytes of their largest column."""
    for batch in batches:
        step = max(1, int(batch.num_rows * characters / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


@cache
def _trim() -> Callable[[int], int] | None:
    """What returns freed memory of the C library, if it has that."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return to the system what Arrow and the C library hold of freed memory."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def giving_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function over batches after which the worker returns its freed memory.

    Spark uses a worker again for all stages of a job, beside an executor whose heap is full by
    then. What each stage leaves would otherwise add up to the memory of that executor.
    """

    @wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def task_number() -> int:
    return TaskContext.get().partitionId()


def pack_rows(rows: pa.Table) -> bytes:
    """Rows as compressed Arrow bytes."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return zstandard.compress(out.getbuffer(), 3)


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


# A group that holds more than this share of the rows is a hot one.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with a table of one row per key, without sending a hot key to one task.

    `size` tells how many of the `n_rows` rows have the key. Fewer than 1 / HOT_SHARE keys can
    be hot, whatever the size of the table; these are broadcast, the others joined by key.
    """
    hot = F.col(size) > HOT_SHARE * n_rows
    few = F.broadcast(groups.filter(hot))
    others = rows.join(few.select(key), key, "left_anti").join(groups.filter(~hot), key)
    return rows.join(few, key).unionByName(others)
