"""Token ids in binary files of patched frame-of-reference blocks.

Ids are cut into blocks of BLOCK. A block stores its minimum, and each id less that minimum in
a width that PERCENTILE of the block's ids fit; the high bits of the others go to an exception
list. An index holds where each block starts, so that any range of ids is read without the rest.

A file is, all little-endian:
  magic, then n_docs, n_ids, n_blocks, n_words, n_exceptions (64 bits each)
  per document: id (64), whether the id is there (8), first id in the file (64)
  per block: first packed word (64), minimum (32), width (8), first exception (64)
  packed words (64 bits each; four runs of 64 ids to a block, low bits first)
  per exception: place in the block (16), high bits (32)
Each section starts at a multiple of eight bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opinara.llm.common import id_and_text, in_parts, task_number, word_ids
from opinara.session import file_system

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILE = 90
# Ids of one file at most, unless a single document has more.
FILE_IDS = 1 << 23
# Blocks packed at a time.
_STEP = 4096

_DOC = np.dtype([("id", "<i8"), ("start", "<u8"), ("there", "u1"), ("pad", "V7")])
_BLOCK = np.dtype([("word", "<u8"), ("exception", "<u8"), ("minimum", "<u4"), ("width", "u1"), ("pad", "V3")])
_EXCEPTION = np.dtype([("high", "<u4"), ("place", "<u2"), ("pad", "V2")])


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.searchsorted(2 ** np.arange(33, dtype=np.uint64), values.astype(np.uint64), side="right").astype(np.uint8)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2 ** width as rows of packed words."""
    lanes = np.ascontiguousarray(low.reshape(-1, 64).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(low), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of `_pack`."""
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= lanes[word + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block index, packed words and exceptions of unsigned 32-bit ids."""
    n_blocks = -(-len(ids) // BLOCK)
    index = np.zeros(n_blocks, _BLOCK)
    words, exceptions = [], []
    n_words = n_exceptions = 0
    nth = max(0, -(-BLOCK * PERCENTILE // 100) - 1)
    for begin in range(0, n_blocks, _STEP):
        part = ids[begin * BLOCK:(begin + _STEP) * BLOCK]
        fill = -len(part) % BLOCK
        rows = (np.concatenate([part, np.repeat(part[-1:], fill)]) if fill else part).reshape(-1, BLOCK)
        own = index[begin:begin + len(rows)]
        own["minimum"] = rows.min(1)
        rest = rows - own["minimum"][:, None]
        own["width"] = bit_length(np.partition(rest, nth, axis=1)[:, nth])
        width = own["width"].astype(np.uint32)
        sizes = 4 * width.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        own["word"] = n_words + starts
        over = rest.astype(np.uint64) >> width[:, None].astype(np.uint64)
        at, place = np.nonzero(over)
        found = np.zeros(len(at), _EXCEPTION)
        found["place"], found["high"] = place, over[at, place]
        per = np.bincount(at, minlength=len(rows))
        own["exception"] = n_exceptions + np.cumsum(per) - per
        exceptions.append(found)
        packed = np.zeros(int(sizes.sum()), np.uint64)
        for w in np.unique(width):
            if w:
                same = np.flatnonzero(width == w)
                low = rest[same] & np.uint32((1 << int(w)) - 1)
                packed[starts[same][:, None] + np.arange(4 * int(w))] = _pack(low, int(w))
        words.append(packed)
        n_words += len(packed)
        n_exceptions += len(found)
    empty = [np.zeros(0, np.uint64)], [np.zeros(0, _EXCEPTION)]
    return index, np.concatenate(words or empty[0]), np.concatenate(exceptions or empty[1])


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of documents with so many ids each."""
    index, words, exceptions = encode_blocks(ids)
    docs = np.zeros(len(doc_ids), _DOC)
    docs["id"] = [0 if i is None else i for i in doc_ids]
    docs["there"] = [i is not None for i in doc_ids]
    docs["start"] = np.cumsum(lengths) - lengths
    head = np.array([len(docs), len(ids), len(index), len(words), len(exceptions)], "<u8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, docs, index, words, exceptions))])


class TokenFile:
    """Reads documents, or any range of ids, from the bytes of a file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        head = np.frombuffer(data, "<u8", 5, 8).astype(np.int64)
        at = 48
        parts = []
        for kind, n in zip((_DOC, _BLOCK, np.dtype("<u8"), _EXCEPTION), head[[0, 2, 3, 4]]):
            parts.append(np.frombuffer(data, kind, n, at))
            at += kind.itemsize * int(n)
        self.docs, self.index, self.words, self.exceptions = parts
        self.n_ids = int(head[1])

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` up to `stop`, decoding only the blocks that hold them."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        out = np.empty((last - first, BLOCK), np.uint32)
        for begin in range(first, last, _STEP):
            end = min(last, begin + _STEP)
            out[begin - first:end - first] = self._blocks(begin, end)
        return out.reshape(-1)[start - first * BLOCK:stop - first * BLOCK]

    def _blocks(self, begin: int, end: int) -> np.ndarray:
        own = self.index[begin:end]
        rest = np.zeros((len(own), BLOCK), np.uint32)
        for w in np.unique(own["width"]):
            if w:
                same = np.flatnonzero(own["width"] == w)
                at = own["word"][same].astype(np.int64)[:, None] + np.arange(4 * int(w))
                rest[same] = _unpack(self.words[at], int(w))
        bounds = np.append(own["exception"], len(self.exceptions) if end == len(self.index) else self.index["exception"][end]).astype(np.int64)
        found = self.exceptions[bounds[0]:bounds[-1]]
        row = np.repeat(np.arange(len(own)), np.diff(bounds))
        rest[row, found["place"]] |= found["high"] << own["width"][row].astype(np.uint32)
        return rest + own["minimum"][:, None]


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode every whole text, add `end_id`, and write the ids in ascending order of id.

    Returns the list of files, as stored beside them: `task`, `part`, `file`, `n_docs`,
    `n_ids`; files follow each other by (task, part). Rows are range-partitioned by id, so the
    files of one task go on where the task before ended; a text that is null counts as empty,
    null ids come first, rows with one id are ordered by a hash of their text. An empty table
    gives an empty list of files. A text of any length is one document, so a file may pass
    FILE_IDS by its last one. A task that runs again writes the same files, each under a name of
    its own first and then moved in place.
    """
    spark = df.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        fs.create_dir(folder, recursive=True)
        task = task_number()
        encoder = word_ids(tokenizer)
        part, doc_ids, encoded, sizes, size = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids, lengths = np.concatenate(encoded), np.array(sizes, np.int64)
            name = f"{task:08d}-{part:05d}.pfor"
            own = f"{folder}/_{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out:
                out.write(file_bytes(doc_ids, lengths, ids))
            fs.move(own, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({
                "task": pa.array([task], pa.int64()), "part": pa.array([part], pa.int64()),
                "file": [name], "n_docs": pa.array([len(doc_ids)], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()),
            })

        for batch in in_parts(batches):
            ids, lengths = encoder.encode(batch.column(1), end_id)
            begin = done = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), lengths.tolist()):
                if size and size + n > FILE_IDS:
                    encoded.append(ids[begin:done])
                    yield flush()
                    part, doc_ids, encoded, sizes, size, begin = part + 1, [], [], [], 0, done
                doc_ids.append(doc_id)
                sizes.append(n)
                size, done = size + n, done + n
            encoded.append(ids[begin:])
        if doc_ids:
            yield flush()

    rows = id_and_text(df, id_column, text_column).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    files = ordered.select("id", "text").mapInArrow(
        run, "task bigint, part bigint, file string, n_docs bigint, n_ids bigint"
    )
    files.write.parquet(f"{path}/_files")
    return spark.read.parquet(f"{path}/_files")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files below `path`.

    Per document: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32`
    (of its ids as little-endian unsigned 32-bit integers) and, on request, `ids` (those bytes).
    Files are read by Spark, each by one task; files that no finished task listed are left out.
    """
    files = spark.read.parquet(f"{path}/_files")
    # The window without partitions is over one row per file.
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    content = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )
    schema = "file string, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    if with_ids:
        schema += ", ids binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                yield from _documents(name.as_py(), TokenFile(data.as_buffer()), with_ids)

    read = content.mapInArrow(run, schema)
    joined = read.join(starts, "file")
    more = ["ids"] if with_ids else []
    return joined.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *more)


def _documents(name: str, file: TokenFile, with_ids: bool, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a file's documents, decoding about `step` ids at a time."""
    starts = np.append(file.docs["start"], file.n_ids).astype(np.int64)
    begin = 0
    while begin < len(file.docs):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + step, side="right")) - 1)
        ids = file.read(int(starts[begin]), int(starts[end])).astype("<u4")
        own = [ids[a:b] for a, b in zip(starts[begin:end] - starts[begin], starts[begin + 1:end + 1] - starts[begin])]
        docs = file.docs[begin:end]
        columns = {
            "file": pa.array([name] * len(own)),
            "doc_id": pa.array(docs["id"], pa.int64(), mask=docs["there"] == 0),
            "local": pa.array(starts[begin:end], pa.int64()),
            "n_tokens": pa.array([len(x) for x in own], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([x.tobytes() for x in own], pa.binary())
        yield pa.RecordBatch.from_pydict(columns)
        begin = end
