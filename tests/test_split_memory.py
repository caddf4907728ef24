"""The splitter makes Python strings of a few texts at a time, however many an Arrow batch has."""

import pyarrow as pa

from quillstone.operators import chunk


def test_a_batch_is_split_by_slices(spark):
    texts = pa.array([None, "", "word " * 300_000, *["w x " * 500] * 3000, None, "end"], pa.string())
    out = list(chunk.splitter(300, 50).func(iter([texts.slice(0, 1), texts, texts.slice(0, 0)])))
    whole = [x for part in out for x in part.to_pylist()]
    assert whole == [None, *[None if t is None else chunk.split_text(t, 300, 50) for t in texts.to_pylist()]]
    assert max(sum(len(t) for p in part.to_pylist() for t in p or ()) for part in out) < 3 << 20
