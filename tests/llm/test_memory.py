"""What Python workers take beside their executor, and keep between the stages of a job."""

import random
import re
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

from opinara.llm import common, near_duplicates


class Taken:
    """In place of a frame: gives the function that would run on it."""

    def withColumns(self, _):
        return self

    def mapInArrow(self, run, _):
        return run


def own_mb():
    rollup = Path("/proc/self/smaps_rollup").read_text()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", rollup))) / 1024


def test_signatures_of_a_batch_take_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "id_and_text", lambda *_: Taken())
    run = near_duplicates.signed(None, "doc_id", "text")
    words = [f"word{i}" for i in range(3000)]
    draw = random.Random(5)
    texts = [" ".join(draw.choices(words, k=250)) for _ in range(600)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids, ids], ["id", "text", "row", "digest"])
    assert batch.nbytes > 1 << 20
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == len(texts) and found.column("sketch").null_count == 0
    assert peak < 30 << 20


def test_signatures_do_not_depend_on_the_batch():
    draw = random.Random(6)
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randint(1, 400))) for _ in range(50)]
    sets = [near_duplicates.np.unique(near_duplicates.shingle_hashes(t.split()), return_counts=True) for t in texts]
    alone = near_duplicates.np.concatenate([near_duplicates.signatures([s]) for s in sets])
    assert (near_duplicates.signatures(sets) == alone).all()


def test_function_over_batches_gives_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    kept = common.giving_back(lambda own: (b for b in own))
    running = kept(iter(batches))
    assert next(running) is batches[0] and not given
    assert [*running] == batches[1:] and given == [1]


@pytest.mark.skipif(common._trim() is None or not Path("/proc/self/smaps_rollup").exists(), reason="needs glibc on Linux")
def test_freed_memory_returns_to_the_system():
    before = own_mb()
    blocks = [bytes(2000) for _ in range(60_000)]
    last = blocks[-1]
    taken = own_mb()
    assert taken - before > 100
    del blocks
    common.give_back()
    assert own_mb() < taken - 80
    assert last
