"""The recall of one task: what it holds at once doesn't grow with queries x rows, and its best rows are those of all pairs."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quillstone.operators import retrieve


def batches(x, size):
    for lo in range(0, len(x), size):
        ids = [f"c{i}" for i in range(lo, min(lo + size, len(x)))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x[lo : lo + size].tolist(), pa.list_(pa.float64()))], ["chunk_id", "embedding"])


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_best_rows_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    rows = np.eye(4)[rng.integers(0, 4, 5000)] * rng.choice([-2.0, 0.0, 0.5, 1.0], (5000, 1))  # many are tied exactly, some are zero
    q = unit(rng.integers(1, 4, (600, 4)).astype(float))
    block = SimpleNamespace(value={4: (np.arange(600) * 3, q)})
    got = pa.Table.from_batches(list(retrieve._recall(7, block)(batches(rows, 3000)))).to_pylist()
    able = np.flatnonzero(rows.any(1))
    scores = q @ unit(rows[able]).T
    names = np.array([f"c{i}" for i in able])
    want = {(int(n) * 3, names[i]) for n in range(600) for i in np.lexsort((names, -scores[n]))[:7]}
    assert {(r["n"], r["chunk_id"]) for r in got} == want and len(got) == len(want)


def test_memory_does_not_grow_with_queries_times_rows():
    rng = np.random.default_rng(4)
    q, rows = unit(rng.standard_normal((4000, 8))), list(batches(rng.standard_normal((6000, 8)), 6000))
    block = SimpleNamespace(value={8: (np.arange(4000), q)})
    tracemalloc.start()
    got = sum(b.num_rows for b in retrieve._recall(5, block)(iter(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 20_000 and peak < 40e6  # all scores are 192 MB
