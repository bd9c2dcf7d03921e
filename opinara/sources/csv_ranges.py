"""CSV with quoted line breaks, read by many tasks per file.

A line break ends a record only outside quotes, and whether a byte is inside quotes depends on
all bytes before it. So each range of a file is scanned once for both cases, begun outside or
inside quotes. The ranges' outcomes are combined from the file's start on, which tells where in
each range the first record begins. Then each task reads from the first record of its range to
that of the next, which is whole records whatever the cut. Both passes take lists of ranges as
rows; a lost task reads its ranges again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opinara.session import pin

RANGE_BYTES = 64 << 20
_BLOCK = 1 << 20
_BATCH_BYTES = 4 << 20
_PACKED = r"\.(gz|bz2|zst|lz4|deflate|snappy|xz)$"
# Stores that pyarrow opens by itself.
_REACHED = r"^(file|hdfs|s3|s3a|gs|abfs|abfss):"

# A quote opens a quoted field only at its start; two quotes inside stand for one. What follows
# the closing quote, up to the next comma, belongs to the field.
_QUOTED = rb'[^"]*+(?:""[^"]*+)*+"[^,\n]*+'
_FIELD = rb'(?:"' + _QUOTED + rb'|[^",\n][^,\n]*+|(?=[,\n]|\Z))'
_RECORD = _FIELD + rb"(?:," + _FIELD + rb")*+"
_ONE = re.compile(_RECORD + rb"(?:\n|\Z)")
_CLOSED = re.compile(rb"(?:" + _RECORD + rb"\n)*+")
_REST = re.compile(_QUOTED + rb"(?:," + _FIELD + rb")*+(?:\n|\Z)")

_SCANNED = ("path string, length long, begin long, first long, first_inside long,"
            " ends_inside boolean, ends_inside_if_inside boolean, head string, crlf boolean")

_SCAN_SCHEMA = pa.schema([
    ("path", pa.string()), ("length", pa.int64()), ("begin", pa.int64()), ("first", pa.int64()),
    ("first_inside", pa.int64()), ("ends_inside", pa.bool_()), ("ends_inside_if_inside", pa.bool_()),
    ("head", pa.string()), ("crlf", pa.bool_()),
])


def _open(path: str):
    if path.startswith("file:"):
        return LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    fs, inner = FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return fs.open_input_file(inner)


def _line_start(file, at: int, length: int) -> int:
    """The first place at or after `at` where a line begins; `length` if there is none."""
    if at <= 0:
        return 0
    file.seek(at - 1)
    while block := file.read(_BLOCK):
        found = block.find(b"\n")
        if found >= 0:
            return min(file.tell() - len(block) + found + 1, length)
    return length


def _ends_inside(data: bytes, at: int) -> bool:
    """Whether records from `at`, where one begins, leave a quote open at the end of data."""
    closed = _CLOSED.match(data, at).end()
    return closed < len(data) and _ONE.match(data, closed) is None


def _scan(step: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_scanned(step=step, **row)], _SCAN_SCHEMA)
    return scan


def _scanned(path: str, length: int, begin: int, step: int) -> dict:
    """One range, from its first line start to that of the next range, in both cases."""
    found = {"path": path, "length": length, "begin": begin, "first": None, "first_inside": None,
             "ends_inside": False, "ends_inside_if_inside": True, "head": None, "crlf": None}
    with _open(path) as file:
        start = _line_start(file, begin, length)
        stop = _line_start(file, begin + step, length) if begin + step < length else length
        if start >= stop:
            return found
        file.seek(start)
        data = file.read(stop - start)
    mark = 3 if begin == 0 and data.startswith(b"\xef\xbb\xbf") else 0
    found["first"] = start + mark
    found["ends_inside"] = _ends_inside(data, mark)
    rest = _REST.match(data)
    if rest:
        if rest.end() < len(data):
            found["first_inside"] = start + rest.end()
        found["ends_inside_if_inside"] = _ends_inside(data, rest.end())
    if begin == 0:
        found["crlf"] = re.match(rb"[^\n]*\r\n", data) is not None
        found["head"] = _head(data, mark)
        if found["head"] is None and stop < length:
            raise ValueError(f"the header of {path} does not end within {step} bytes")
    return found


def _head(data: bytes, at: int) -> str | None:
    """The first record that is no empty line."""
    while at < len(data) and (record := _ONE.match(data, at)):
        text = record.group().rstrip(b"\r\n")
        if text:
            return text.decode(errors="replace")
        at = record.end()
    return None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each range, without the header and without empty lines."""
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["path"]) as file:
                file.seek(row["from"])
                data = file.read(row["to"] - row["from"])
            if row["crlf"]:
                data = data.replace(b"\r\n", b"\n")
            skip, held, size, at = row["with_head"], [], 0, 0
            while at < len(data):
                found = _ONE.match(data, at)
                # A quote that the file never closes takes all that follows.
                end = found.end() if found else len(data)
                record = data[at:end].removesuffix(b"\n")
                at = end
                if not record:
                    continue
                if skip:
                    skip = False
                    continue
                held.append(record.decode(errors="replace"))
                size += len(record)
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.string())})
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.string())})


def first_records(scanned: DataFrame) -> DataFrame:
    """Per range the place of its first record, from the outcomes of both cases.

    A range leaves the state as it was, turns it round, or sets it whatever it was. The state
    before a range is thus the last one set, turned as often as ranges turned it since. A file
    is one group here, of one row per range.
    """
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("path").orderBy("begin").rowsBetween(1, Window.unboundedFollowing)
    out, inside = F.col("ends_inside"), F.col("ends_inside_if_inside")
    turns = F.sum((out & ~inside).cast("int")).over(upto)
    scanned = scanned.withColumn("_turns", turns)
    set_ = F.when(out == inside, F.struct(out.cast("int").alias("state"), F.col("_turns").alias("turns")))
    last = F.last(set_, ignorenulls=True).over(before)
    turned = F.coalesce(F.last("_turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    state = (F.coalesce(last["state"], F.lit(0)) + turned) % 2
    whole = Window.partitionBy("path")
    begun = F.when(state == 1, F.col("first_inside")).otherwise(F.col("first"))
    cut = scanned.withColumns({
        "from": begun, "head": F.max("head").over(whole), "crlf": F.coalesce(F.max("crlf").over(whole), F.lit(False)),
    }).filter("`from` IS NOT NULL")
    to = F.coalesce(F.first("from").over(after), F.col("length"))
    return cut.select("path", "from", to.alias("to"), (F.col("begin") == 0).alias("with_head"), "head", "crlf")


class Ranges:
    """CSV files cut at the starts of records.

    The scan of quotes is done once, when this is made; its outcome is one small row per range.
    `possible` tells whether all files are plain and in a store that tasks can open by
    themselves; without that, and without any bytes, nothing is scanned.
    """

    def __init__(self, spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES):
        if range_bytes < 1:
            raise ValueError("range_bytes must be positive")
        listed = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
        size = F.ceil(F.col("length") / range_bytes)
        other = F.col("path").rlike(_PACKED) | ~F.col("path").rlike(_REACHED)
        total = listed.agg(F.sum(size).alias("ranges"), F.count_if(other).alias("others")).first()
        self.tasks, self.possible = total["ranges"] or 0, total["others"] == 0
        if not (self.tasks and self.possible):
            return
        begins = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes))
        ranges = listed.select("path", "length", F.explode(begins).alias("begin"))
        scanned = ranges.repartition(self.tasks).mapInArrow(_scan(range_bytes), _SCANNED)
        self.cuts = pin(first_records(scanned), "csv-cuts")

    def heads(self) -> DataFrame:
        """Each header and the first file that has it."""
        return self.cuts.filter("head IS NOT NULL").groupBy("head").agg(F.min("path").alias("path"))

    def records(self, head: str) -> DataFrame:
        """The records, one text each, of the files with this header, in the files' order."""
        cuts = self.cuts.filter(F.col("head") == head).select("path", "from", "to", "with_head", "crlf")
        ordered = cuts.repartitionByRange(self.tasks, "path", "from").sortWithinPartitions("path", "from")
        return ordered.mapInArrow(_records, "record string")
