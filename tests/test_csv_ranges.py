"""CSV cut at record starts, against a plain automaton and against Spark's own reader."""

import random

import pytest

from opinara.sources import csv_ranges
from opinara.sources.reviews import read_reviews


def record_starts(data: bytes) -> list[int]:
    """Byte by byte: where records begin, empty lines included."""
    starts, state = [0], "field"
    for at, sign in enumerate(data.decode("latin-1")):
        if state == "quoted":
            state = "quote" if sign == '"' else "quoted"
        elif sign == '"' and state in ("field", "quote"):
            state = "quoted"
        elif sign == "\n":
            state = "field"
            starts.append(at + 1)
        else:
            state = "field" if sign == "," else "plain"
    return starts


def cuts_of(path, data: bytes, step: int) -> list[int]:
    """Starts of each range's records, the state carried from range to range."""
    inside, found = False, []
    for begin in range(0, len(data), step):
        row = csv_ranges._scanned(f"file:{path}", len(data), begin, step)
        found.append(row["first_inside"] if inside else row["first"])
        inside = row["ends_inside_if_inside"] if inside else row["ends_inside"]
    return [at for at in found if at is not None]


def test_scan_in_both_cases(tmp_path):
    chance = random.Random(5)
    path = tmp_path / "r.csv"
    for _ in range(400):
        data = b"h,i\n" + "".join(chance.choices('ab",\n', (3, 1, 4, 2, 2), k=chance.randrange(1, 60))).encode()
        path.write_bytes(data)
        starts = record_starts(data)
        for step in (4, 7, 16):
            cuts = cuts_of(path, data, step)
            assert set(cuts) <= set(starts)
            # No start is lost: each range that holds a start has a cut at its first one.
            lines = [next((i + 1 for i in range(max(b - 1, 0), len(data)) if data[i] == 10), len(data)) if b else 0
                     for b in range(0, len(data), step)] + [len(data)]
            for low, high in zip(lines, lines[1:]):
                inside = [s for s in starts if low <= s < high]
                assert not inside or inside[0] in cuts


def test_first_records(spark, tmp_path):
    """The prefix of the ranges' outcomes, as a window, equals the fold."""
    chance = random.Random(6)
    paths = {}
    for number in range(20):
        data = b"h\n" + "".join(chance.choices('a",\n', (3, 4, 1, 2), k=150)).encode()
        path = tmp_path / f"{number}.csv"
        path.write_bytes(data)
        paths[str(path)] = cuts_of(path, data, 6)
    found = csv_ranges.Ranges(spark, str(tmp_path), 6).cuts.orderBy("path", "from").collect()
    for path, cuts in paths.items():
        rows = [r for r in found if r["path"].endswith(path)]
        assert [r["from"] for r in rows] == cuts
        assert [r["to"] for r in rows][:-1] == cuts[1:]


def odd_csv(rows: int, end: str) -> str:
    chance = random.Random(7)
    cells = ["plain", "", '"two\nlines"', '"say ""no"", or\n\n""yes"""', '""', " spaced ", "é😀", '"a,b"', "in\"side", "NA",
             '"\n"', '"""\n,"""', '"' + "long\n" * 30 + '"']
    lines = ["id,text,other"]
    lines += [",".join([str(i), *chance.choices(cells, k=2)][: chance.choice((3, 3, 3, 2))]) for i in range(rows)]
    lines[5:5] = ["", ""]
    return "\n".join([*lines, ""]).replace("\n", end)


@pytest.mark.parametrize("end,step", [("\n", 64), ("\n", 1000), ("\r\n", 300), ("\n", 1 << 20)])
def test_equal_to_one_task(spark, tmp_path, end, step):
    path = tmp_path / "r.csv"
    data = odd_csv(150, end).encode()
    path.write_bytes(data.removesuffix(b"\n") if step == 1000 else data)
    split = read_reviews(spark, str(path), split_bytes=step)
    whole = read_reviews(spark, str(path), split_bytes=None)
    assert split.columns == whole.columns
    # The same rows in the same order.
    assert split.collect() == whole.collect()
    if step < 1000:
        assert split.rdd.getNumPartitions() > 10


def test_marks_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,text\n1,\"x\ny\"\n".encode())
    (tmp_path / "b.csv").write_bytes(b"id,text")
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"\n\ntext,id,id,\nz,2,3,4\n")
    rows = read_reviews(spark, str(tmp_path), split_bytes=5_000).select("id", "text")
    assert [tuple(r) for r in rows.collect() if r["id"]] == [("1", "x\ny")]
    assert sorted(r["text"] for r in rows.collect()) == ["x\ny", "z"]


def test_refused(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'"a\nvery long header",b\n1,2\n')
    with pytest.raises(ValueError, match="range_bytes"):
        csv_ranges.Ranges(spark, str(tmp_path), 0)
    with pytest.raises(Exception, match="does not end within"):
        read_reviews(spark, str(tmp_path), split_bytes=2)
