"""The latent space is fitted on the passages of all documents."""

import numpy as np
import pandas as pd
import pyarrow as pa

from quillstone.llm import decontaminate
from quillstone.llm.words import utf8


def test_the_space_is_of_all_documents(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, n) % 3000) for n in rng.integers(1, 50, 12_000)]
    space = decontaminate.fit_space(spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts})))
    p = decontaminate.Segments.of(*utf8(pa.array(texts))).passages(space.basis, space.idf).astype(np.float64)
    assert np.abs(p.mean(0) - space.mean).max() < 1e-4 * np.abs(p).max()
    white = (p - p.mean(0)) @ space.white
    assert np.abs(white.T @ white / len(white) - np.eye(white.shape[1])).max() < 1e-2


def test_sums_do_not_grow_with_the_partitions(spark, monkeypatch):
    sent, add = spark.sparkContext.accumulator(0), decontaminate._add

    def counted(batches):
        def seen():
            for b in batches:
                sent.add(b.num_rows)
                yield b

        yield from add(seen())

    monkeypatch.setattr(decontaminate, "_add", counted)
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(20 * cores, numPartitions=10 * cores).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text")
    decontaminate.fit_space(docs)
    assert 0 < sent.value <= 2 * cores * (2 * 32 + 1)  # two products of 32 blocks, and the moments
