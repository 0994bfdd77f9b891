"""Memory of worker processes: texts are worked on in slices, and what a task freed goes back to the system."""

import random

import numpy as np
import pyarrow as pa

from codescope.llm import common, suffix_dedup


class Captured:
    """Stands for a frame: keeps the function that ``mapInArrow`` gets."""

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_slices_have_every_row_once():
    texts = ["ab" * n for n in (1, 5, 0, 40, 2, 2, 2, 9)] + [None, "é" * 30]
    batch = pa.record_batch({"n": np.arange(len(texts)), "text": pa.array(texts)})
    parts = list(common.slices(batch, 1, 20))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    sizes = [[len((t or "").encode()) for t in p.column(1).to_pylist()] for p in parts]
    assert len(parts) > 3 and all(sum(s) - max(s) <= 20 for s in sizes)
    assert list(common.slices(batch.slice(0, 0), 1)) == []


def test_pieces_of_a_large_batch_leave_in_small_ones(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("abcdefgh \n", k=500_000)) for _ in range(24)]
    texts += texts[:4]
    batch = pa.record_batch({"doc": np.arange(len(texts)), "start": np.zeros(len(texts), np.int64), "text": pa.array(texts)})
    out = list(suffix_dedup.piece_rows(Captured()).run(iter([batch])))
    sizes = [len(suffix_dedup.runs(np.frombuffer(t.encode(), np.uint8))[0]) for t in texts]
    assert sum(b.num_rows for b in out) == sum(sizes)
    assert max(b.num_rows for b in out) < sum(sizes) / 2


def test_freed_memory_is_given_back(spark, monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1), raising=False)
    batch = pa.record_batch({"n": [1]})
    run = common.map_batches(Captured(), lambda batches: ({"n": b.column(0)} for b in batches), "n bigint").run
    assert [b.to_pydict() for b in run(iter([batch]))] == [{"n": [1]}] and told == [1]


def test_large_batches_leave_in_parts(spark):
    n = 3 * common.SLICE_BYTES // 8
    run = common.map_batches(Captured(), lambda batches: ({"n": np.arange(n)} for _ in batches), "n bigint").run
    out = list(run(iter([pa.record_batch({"n": [1]})])))
    assert max(b.nbytes for b in out) <= common.SLICE_BYTES and np.array_equal(pa.Table.from_batches(out).column(0).to_numpy(), np.arange(n))
