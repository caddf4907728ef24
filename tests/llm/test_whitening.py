"""Whitening against eigenvectors of the covariance of exact integers."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.llm import queries as llm
from quillstone.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """(points by vec_id, n, S, eigenvalues, axes, trace), with means in exact integers."""
    rows = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors}
    distinct = sorted(set(map(tuple, rows.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    away = np.array([[(n * a - s) / n for a, s in zip(p, sums, strict=True)] for p in distinct])
    cov = away.T @ away / n
    values, axes = np.linalg.eigh(cov)
    return rows, n, sums, values[::-1], axes[:, ::-1], np.trace(cov)


def compare(got, vectors, tolerance=1e-6):
    rows, n, sums, values, axes, trace = brute(vectors)
    found = {}
    for r in got:
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(rows[r.vec_id], sums, strict=True))
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained and r.identity_error <= 1e-9
        found[r.vec_id, r.component] = r.whitened
    ids, k = sorted(rows), max(c for _, c in found)
    assert len(found) == len(ids) * k
    white = np.array([[found[i, c] for c in range(1, k + 1)] for i in ids])
    away = np.array([[(n * a - s) / n for a, s in zip(rows[i], sums, strict=True)] for i in ids])
    want = away @ axes[:, :k] / np.sqrt(values[:k])
    sign = np.sign((white * want).sum(0))
    assert np.abs(white - want * sign).max() < tolerance
    return k


def test_the_query(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert compare(llm.op12_whitening(spark, SF).collect(), vectors) == 16


@pytest.mark.parametrize(("scale", "full"), [(0.6, False), (0.97, True)])
def test_range_finder_and_whole_space(spark, scale, full):
    """A spectrum that falls fast is found by power passes; one that hardly falls fails the residuals and takes the whole space."""
    draw = np.random.default_rng(4)
    turn = np.linalg.qr(draw.standard_normal((48, 48)))[0]
    data = draw.standard_normal((400, 48)) * scale ** np.arange(48) * 2e3 @ turn
    vectors = list(enumerate(data.tolist()))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    points = whitening.grid(df).select("x", "width").distinct()
    space = whitening.fit(points)[48]
    assert space.full == full and len(space.eigenvalues) == 16
    compare(whitening.project(whitening.grid(df), {48: space}).collect(), vectors, 1e-4)


def test_a_failed_residual_is_seen(spark):
    vectors = [(i, v) for i, v in enumerate(np.random.default_rng(5).standard_normal((300, 40)).tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    points = whitening.grid(df).select("x", "width").distinct()
    spaces = whitening.fit(points, passes=1, oversample=2)
    assert spaces[40].full
    compare(whitening.project(whitening.grid(df), spaces).collect(), vectors)


def test_edges(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.5, 7.0]), (None, [2.0, 2.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [5.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("width", F.lit("w")).withColumn("n", F.lit(None))
    out = whitening.whiten(df).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == {1, 2, 3, None, 10, 11} and len(by_id[1]) == 4 and {r.n for r in by_id[2]} == {4}
    assert {(r.n, r.component) for r in by_id[10]} == {(2, 1)} and abs(by_id[10][0].whitened + by_id[11][0].whitened) < 1e-9  # one direction
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 9")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


def test_columns_that_the_driver_can_hold(spark, monkeypatch):
    monkeypatch.setattr(whitening, "HELD", 10)
    with pytest.raises(ValueError, match="numbers"):
        whitening.whiten(spark.createDataFrame([(i, [float(i * j % 7) for j in range(20)]) for i in range(9)], "vec_id long, embedding array<double>")).count()
