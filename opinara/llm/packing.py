"""Sequence packing as vector bin packing.

An example has three sizes: tokens, segments (one) and loss-bearing tokens. A sequence has a
limit on each. The dot-product heuristic fills one sequence at a time: of the examples that
fit, it takes the one whose sizes have the largest weighted product with what is left of the
limits. When none fits whole, the best one is cut if cutting is allowed; a sequence that stays
short is split at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opinara.llm.common import giving_back, in_parts, task_number, whole_text, word_ids


@dataclass(frozen=True)
class Limits:
    """Of one sequence. Window: tokens and examples that are packed together by a task."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    window_tokens: int = 1 << 21
    window_examples: int = 1 << 14

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("a sequence must hold at least one token, segment and loss-bearing token")


@dataclass
class Piece:
    """`length` ids of example `item` from its id number `start` on."""

    item: int
    start: int
    length: int


_GONE = 1 << 62


class _Pool:
    """Examples to place, in stacks of one kind (tokens, tokens without loss at the start)."""

    def __init__(self, sizes: list[tuple[int, int]], limits: Limits):
        self.stacks: list[list[tuple[int, int]]] = []
        self.kinds: list[tuple[int, int]] = []
        self.slot: dict[tuple[int, int], int] = {}
        self.free: list[int] = []
        for item, kind in enumerate(sizes):
            if kind not in self.slot:
                self.slot[kind] = len(self.kinds)
                self.kinds.append(kind)
                self.stacks.append([])
            self.stacks[self.slot[kind]].append((item, 0))
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.tokens = np.array([n for n, _ in self.kinds], np.int64)
        self.loss = np.array([n - p for n, p in self.kinds], np.int64)
        # A dimension weighs as much as it is asked for.
        asked = np.array([sum(n for n, _ in sizes), len(sizes), sum(n - p for n, p in sizes)])
        self.weights = asked / self.caps / max(1, len(sizes)) / self.caps**2

    def best(self, left: tuple[int, int, int], whole: bool) -> int | None:
        """Slot of the largest dot product, among the examples that fit if `whole`."""
        w = self.weights * left
        score = w[0] * self.tokens + w[2] * self.loss + w[1]
        if whole:
            score[(self.tokens > left[0]) | (self.loss > left[2])] = -1.0
        else:
            score[self.tokens == _GONE] = -1.0
        at = int(score.argmax()) if len(score) else 0
        return at if len(score) and score[at] >= 0 else None

    def take(self, slot: int) -> tuple[int, int]:
        got = self.stacks[slot].pop()
        if not self.stacks[slot]:
            del self.slot[self.kinds[slot]]
            self.tokens[slot] = _GONE
            self.free.append(slot)
        return got

    def put(self, kind: tuple[int, int], item: int, start: int) -> None:
        """Put back the rest of an example, in a stack that has become free if its kind is new."""
        if kind not in self.slot:
            if not self.free:
                self.free.append(len(self.kinds))
                self.kinds.append(kind)
                self.stacks.append([])
                self.tokens, self.loss = np.append(self.tokens, 0), np.append(self.loss, 0)
            slot = self.slot[kind] = self.free.pop()
            self.kinds[slot], self.tokens[slot], self.loss[slot] = kind, kind[0], kind[0] - kind[1]
        self.stacks[self.slot[kind]].append((item, start))


def pack(sizes: list[tuple[int, int]], limits: Limits, cut: bool = True) -> list[list[Piece]]:
    """Sequences of pieces for examples of (tokens, leading tokens without loss).

    Without cutting, an example over a limit stands alone in a sequence of its own.
    """
    pool = _Pool(sizes, limits)
    out: list[list[Piece]] = []
    while pool.slot:
        left = (limits.tokens, limits.segments, limits.loss)
        pieces: list[Piece] = []
        while left[0] > 0 and left[1]:
            slot = pool.best(left, whole=True)
            fits = slot is not None
            if not fits and (cut or not pieces):
                slot = pool.best(left, whole=False)
            if slot is None:
                break
            n, plain = pool.kinds[slot]
            length = n if fits or not cut else min(left[0], plain + left[2])
            if length == 0:
                break
            item, start = pool.take(slot)
            if length < n:
                pool.put((n - length, max(0, plain - length)), item, start + length)
            pieces.append(Piece(item, start, length))
            left = (left[0] - length, left[1] - 1, left[2] - max(0, length - plain))
        out += _at_powers(pieces, limits.tokens) if cut else [pieces]
    return out


def _at_powers(pieces: list[Piece], full: int) -> list[list[Piece]]:
    """A short sequence as sequences whose lengths are powers of two, largest first."""
    total = sum(p.length for p in pieces)
    if total == full:
        return [pieces]
    out, queue = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        own: list[Piece] = []
        while room:
            piece = queue.pop()
            if piece.length > room:
                queue.append(Piece(piece.item, piece.start + room, piece.length - room))
                piece = Piece(piece.item, piece.start, room)
            own.append(piece)
            room -= piece.length
        if own:
            out.append(own)
    return out


def pack_texts(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    limits: Limits = Limits(),
    id_column: str = "doc_id",
    text_column: str = "text",
    prompt_column: str | None = None,
    cut: bool = True,
) -> DataFrame:
    """Encode and pack all rows; one row per piece of an example in a sequence.

    `doc_id`, `start` (ids of its example before the piece), `length`, `ids` (little-endian
    unsigned 32-bit), `doc_tokens`, `loss_tokens` (of the piece), `sequence_id`, `offset`
    (place in the sequence). An example is the ids of `prompt_column`, which bear no loss, of
    the text, and `end_id`. A null text or prompt is empty, so every row has at least one id;
    repeated rows and null ids are examples like others; an empty table gives no rows.

    A task packs its own rows in windows of bounded size, so nothing is shuffled. Run it on
    stored rows: a task that runs again then sees the same rows and makes the same sequences.
    """
    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        sequence = task_number() << 32
        doc_ids, encoded, plain, size = [], [], [], 0
        for batch in in_parts(batches, 1 << 20):
            prompts = _rows(*encoder.encode(batch.column(1)))
            texts = _rows(*encoder.encode(batch.column(2), end_id))
            for doc_id, before, after in zip(batch.column(0).to_pylist(), prompts, texts):
                doc_ids.append(doc_id)
                encoded.append(before + after)
                plain.append(len(before) // 4)
                size += len(encoded[-1]) // 4
                if size >= limits.window_tokens or len(doc_ids) >= limits.window_examples:
                    sequence = yield from _packed(doc_ids, encoded, plain, sequence, limits, cut)
                    doc_ids, encoded, plain, size = [], [], [], 0
        if doc_ids:
            yield from _packed(doc_ids, encoded, plain, sequence, limits, cut)

    prompt = F.lit("") if prompt_column is None else whole_text(prompt_column)
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), prompt.alias("prompt"), whole_text(text_column).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint,"
        " loss_tokens bigint, sequence_id bigint, offset bigint",
    )


def _rows(ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
    """The ids of each text as bytes."""
    data, done = ids.astype("<u4", copy=False).tobytes(), 0
    for n in (4 * lengths).tolist():
        yield data[done:done + n]
        done += n


def _packed(doc_ids, encoded, plain, sequence: int, limits: Limits, cut: bool):
    """Rows of one window; returns the next free sequence number."""
    sizes = [(len(ids) // 4, p) for ids, p in zip(encoded, plain)]
    names = ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")
    columns: dict[str, list] = {name: [] for name in names}

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(columns[n], pa.binary() if n == "ids" else pa.int64()) for n in names], list(names)
        )
        for values in columns.values():
            values.clear()
        return made

    for pieces in pack(sizes, limits, cut):
        offset = 0
        for p in pieces:
            ids = encoded[p.item][4 * p.start:4 * (p.start + p.length)]
            unpaid = min(max(0, plain[p.item] - p.start), p.length)
            row = (doc_ids[p.item], p.start, p.length, ids, zlib.crc32(ids), sizes[p.item][0], p.length - unpaid, sequence, offset)
            for name, value in zip(names, row):
                columns[name].append(value)
            offset += p.length
        sequence += 1
        if len(columns["doc_id"]) >= 4096:
            yield batch()
    if columns["doc_id"]:
        yield batch()
    return sequence
