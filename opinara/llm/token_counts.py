"""Token counts by rank-synchronous merging of ragged symbol arrays.

The vocabulary is one of pieces with scores: a text is cut into pre-tokens that no piece
crosses, the distinct pre-tokens of many texts lie in one flat array, and in each step every
pre-token merges its own best pair, all of them at once. What survives is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opinara.llm.common import CACHED_CHARACTERS, id_and_text, in_parts

# Blanks go with the word after them; line feeds and tabs are in no piece. The longest piece
# of blanks has 16, and blanks merge from the left, so a longer run is cut at multiples of 16.
PRE_TOKEN = re.compile(r" {16}(?= )| *[^ \n\t]+|[\n\t]| +")

_NONE = np.int32(2**31 - 1)


class PieceMerger:
    """Merge table of a piece vocabulary with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [
            (model.id_to_piece(i), model.get_score(i)) for i in ids
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        symbol = {piece: i for i, (piece, _) in enumerate(pieces)}
        # Characters that occur in pieces only, not alone, are symbols too; alone they fall to bytes.
        for piece, _ in pieces:
            for character in piece:
                symbol.setdefault(character, len(symbol))
        self.width = np.ones(len(symbol), np.int64)
        for name, i in symbol.items():
            if i >= len(pieces):
                self.width[i] = len(name.encode())
        self.of_character = np.full(0x110000, -1, np.int32)
        for name, i in symbol.items():
            if len(name) == 1:
                self.of_character[ord(name)] = i
        by_score = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        pairs = {}
        for piece, score in pieces:
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (by_score[score], symbol[piece])
        self._keys = np.array(sorted(pairs), np.int64)
        # Neighbouring characters of some piece; between any others no merge can ever take place.
        self._near = np.array(
            sorted({ord(a) << 32 | ord(b) for piece, _ in pieces for a, b in zip(piece, piece[1:])}), np.int64
        )
        self._ranks = np.array([pairs[k][0] for k in self._keys.tolist()], np.int32)
        self._merged = np.array([pairs[k][1] for k in self._keys.tolist()], np.int32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; the rank is `_NONE` where they don't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        found = (self._keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self._ranks[at], _NONE), self._merged[at]

    def count(self, pre_tokens: Sequence[str]) -> np.ndarray:
        """Surviving symbols of each pre-token; a character outside the vocabulary counts its bytes.

        Pre-tokens are cut where no piece holds the two characters side by side, so the rows of
        the ragged array are short, however long the pre-tokens, and steps are few.
        """
        lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        points = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), "<u4")
        if not len(points):
            return np.zeros(len(pre_tokens), np.int64)
        of = np.repeat(np.arange(len(pre_tokens)), lengths)
        first = np.append(True, (of[1:] != of[:-1]) | ~self._side_by_side(points[:-1], points[1:]))
        owner, of_row = np.cumsum(first) - 1, of[first]
        counts = self._count(points, owner, len(of_row))
        return np.bincount(of_row, counts, len(pre_tokens)).astype(np.int64)

    def _side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self._near, keys), len(self._near) - 1)
        return self._near[at] == keys

    def _count(self, points: np.ndarray, owner: np.ndarray, n_rows: int) -> np.ndarray:
        """Surviving symbols of each row of the ragged array."""
        symbols = self.of_character[points]
        unknown = symbols < 0
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        counts = np.bincount(owner[unknown], size[unknown], n_rows).astype(np.int64)
        rank, merged = self._pairs(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            per = np.diff(np.r_[starts, len(symbols)])
            own_best = np.repeat(best, per)
            ended = own_best == _NONE
            if ended.any():
                last = ended & (symbols >= 0)
                counts += np.bincount(owner[last], self.width[symbols[last]], n_rows).astype(np.int64)
                on = ~ended
                symbols, owner, rank, merged, own_best = (
                    x[on] for x in (symbols, owner, rank, merged, own_best)
                )
                if not len(symbols):
                    break
            symbols, owner, rank, merged = self._step(symbols, owner, rank, merged, own_best)
        return counts

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each symbol with the next one of the same pre-token."""
        rank, merged = self._look_up(symbols[:-1], symbols[1:])
        rank[owner[1:] != owner[:-1]] = _NONE
        return np.append(rank, _NONE), np.append(merged, np.int32(0))

    def _step(self, symbols, owner, rank, merged, own_best):
        """One merge step of all pre-tokens.

        All places of the best pair merge at once, from the left where they overlap. That
        equals one merge after the other unless a merge makes a pair that is no worse; such
        pre-tokens merge their leftmost place only.
        """
        at = np.flatnonzero(rank == own_best)
        run = np.r_[True, np.diff(at) != 1]
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(at - at[first]) % 2 == 0]
        out, no_worse = self._merge(symbols, owner, rank, merged, own_best, at)
        if len(no_worse):
            alone = np.isin(owner[at], no_worse)
            leftmost = np.r_[True, owner[at][1:] != owner[at][:-1]]
            out, _ = self._merge(symbols, owner, rank, merged, own_best, at[~alone | leftmost])
        return out

    def _merge(self, symbols, owner, rank, merged, own_best, at):
        """Arrays after merging at `at`, and the pre-tokens with a new pair that is no worse."""
        level = own_best[at]
        new = merged[at]
        after = np.minimum(at + 2, len(symbols) - 1)
        inside = (at + 2 < len(symbols)) & (owner[after] == owner[at])
        half, _ = self._look_up(new, symbols[after])
        bad = [owner[at][inside & (half <= level)]]
        symbols, rank, merged = symbols.copy(), rank.copy(), merged.copy()
        symbols[at] = new
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        to = np.cumsum(keep) - 1
        level = np.bincount(to[at], own_best[at], keep.sum()).astype(np.int64)
        symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
        here = to[at]
        before = here[here > 0] - 1
        for left in (here, before):
            right = np.minimum(left + 1, len(symbols) - 1)
            r, m = self._look_up(symbols[left], symbols[right])
            r[(left == right) | (owner[left] != owner[right])] = _NONE
            rank[left], merged[left] = r, m
        worst = np.maximum(level[here], 0)
        bad.append(owner[here][rank[here] <= worst])
        kept = here > 0
        bad.append(owner[here[kept]][rank[here[kept] - 1] <= worst[kept]])
        return (symbols, owner, rank, merged), np.unique(np.concatenate(bad))


class PieceCounter:
    """Counts of texts; the count of a known pre-token is looked up, in bounded memory."""

    def __init__(self, path: str):
        self._merger = PieceMerger(path)
        self._known: dict[str, int] = {}
        self._characters = 0

    def count(self, texts: list[str]) -> list[int]:
        # A text starts as if a blank came before it; blanks are the vocabulary's word sign.
        split = [PRE_TOKEN.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        wanted = set().union(*split)
        if self._characters > CACHED_CHARACTERS:
            self._known.clear()
            self._characters = 0
        known = self._known
        new = [w for w in wanted if w not in known]
        if new:
            counts = self._merger.count([w.replace(" ", "▁") for w in new])
            known.update(zip(new, counts.tolist()))
            self._characters += sum(map(len, new)) + 8 * len(new)
        return [sum(map(known.__getitem__, own)) for own in split]


@cache
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(
    df: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: `doc_id`, `n_bytes` (UTF-8), `n_tokens` and `over_limit` (n_tokens > limit).

    Counts are those of the library for the vocabulary file `path`, without begin and end.
    A null text counts as empty (0 tokens); repeated rows and null ids give a row each; an
    empty table gives none. Texts of any length are read whole, also without any blank, and
    never leave their partition.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            n = counter.count(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            })

    return id_and_text(df, id_column, text_column).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
