"""Embedding whitening: a randomised range finder over all centred rows, Rayleigh-Ritz components.

Vectors become grid points x = floor(64*c) + 1000000; each distinct point counts once in the fit. A pass multiplies the points' covariance V by a few
columns: every task sums x' (x' Q) over its centred rows, and one row of that sum a coordinate goes to the next step. Passes repeat from random columns, more
of them than components are wanted, until the residuals of the Rayleigh-Ritz vectors vanish; where they do not within PASSES, or fall too slowly to, the columns become the whole
space and the same step is exact. Points of other lengths are spaces of their own. What the driver holds is columns by coordinates, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.storage import materialize

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 62
COMPONENTS, OVERSAMPLE, PASSES = 16, 16, 6
#: Residual of a component, and eigenvalue of one that is none, against the largest eigenvalue.
RESIDUAL, NOTHING = 1e-13, 1e-12
#: Coordinates times columns that the driver holds, at most.
HELD = 1 << 25


@dataclass
class Space:
    """The fit of the points of one length. axes: coordinates by components; full: the residuals failed, so that the columns became the whole space."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float = 0.0
    identity_error: float = 0.0
    full: bool = False

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the exact mean is above base, times n."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n*x - S)**2 by row; None where a long can't hold it."""
        away, width = x - self.base, x.shape[1]
        if len(x) and width * (self.n * (int(np.abs(away).max(initial=0)) + 1)) ** 2 < 1 << 63:
            return ((self.n * away - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in away]
        return [e if e < 1 << 63 else None for e in exact]


def grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, width) of the rows whose vector and all its entries are there and finite; entries beyond 2**62 on the grid are held at that."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + SHIFT
    return vectors.where(v.isNotNull() & finite).select("vec_id", F.transform(v, entry).alias("x"), F.size(v).alias("width"))


def _by_width(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, points) of a batch's rows that have coordinates."""
    widths, values = b["width"].to_numpy(), b["x"].flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(widths)
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        yield int(width), at, values[(ends[at] - width)[:, None] + np.arange(width)]


def _summed(points: DataFrame, part, kind: type) -> dict[int, np.ndarray]:
    """part(width, points) -> matrix, summed over all points: added up within a task, then by row of the matrix."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for width, _, x in _by_width(b):
                if (m := part(width, x)) is not None:
                    sums[width] = sums[width] + m if width in sums else m
        for width, m in sums.items():
            rows = pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([width] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), rows], ["width", "line", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for width, line, numbers in zip(*(b[c].to_pylist() for c in ("width", "line", "numbers")), strict=True):
                row = np.frombuffer(numbers, kind)
                sums[width, line] = sums[width, line] + row if (width, line) in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["width", "line", "numbers"])

    schema = "width int, line int, numbers binary"
    rows = points.mapInArrow(local, schema).repartition("width", "line").mapInArrow(add, schema).collect()  # coordinates by columns
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["width"], {})[r["line"]] = np.frombuffer(r["numbers"], kind)
    return {width: np.stack([lines[i] for i in range(len(lines))]) for width, lines in out.items()}


def _means(points: DataFrame) -> dict[int, Space]:
    """n and the exact sums of each width's points."""

    def part(width: int, x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(width, len(x))], 1)

    none = np.zeros(0)
    return {width: Space(int(m[0, 2]), [(int(high) << 32) + int(low) for high, low, _ in m], none, none) for width, m in _summed(points, part, np.int64).items()}


def _multiply(points: DataFrame, spaces: dict[int, Space], columns: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """(V Q, trace of V) of each width in columns."""
    if sum(q.size for q in columns.values()) > HELD:
        raise ValueError(f"the vectors' coordinates by columns are more than {HELD} numbers")
    shared = points.sparkSession.sparkContext.broadcast({w: (spaces[w], q) for w, q in columns.items()})

    def part(width: int, x: np.ndarray) -> np.ndarray | None:
        if width not in shared.value:
            return None
        space, q = shared.value[width]
        c = space.centred(x)
        return np.concatenate([c.T @ (c @ q), (c * c).sum(0)[:, None]], 1)

    return {w: (m[:, :-1] / spaces[w].n, float(m[:, -1].sum()) / spaces[w].n) for w, m in _summed(points, part, np.float64).items()}


def _ritz(q: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors, residual) of the best vectors that the columns span; the residual is the largest of the wanted ones, against the largest eigenvalue."""
    small = q.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1][:COMPONENTS], turn[:, ::-1][:, :COMPONENTS]
    left = np.linalg.norm(product @ turn - (q @ turn) * values, axis=0)
    return values, q @ turn, float(left.max(initial=0.0) / values[0]) if values[0] > 0 else 0.0


def fit(points: DataFrame, passes: int = PASSES, oversample: int = OVERSAMPLE) -> dict[int, Space]:
    """The space of each width, from distinct points (x, width)."""
    spaces = _means(points)
    draw = np.random.default_rng(12)
    columns = {w: np.linalg.qr(draw.standard_normal((w, min(w, COMPONENTS + oversample))))[0] for w in sorted(spaces)}
    left, before = passes, {}
    while columns:
        again = {}
        for w, (product, trace) in _multiply(points, spaces, columns).items():
            space, q = spaces[w], columns[w]
            values, vectors, residual = _ritz(q, product)
            space.trace, space.full = trace, q.shape[1] == w
            if space.full or residual <= RESIDUAL:
                some = values > NOTHING * max(values[0], 0)
                space.eigenvalues, space.axes = values[some], vectors[:, some]
            else:  # the passes left go on as the last one did, or they are spared
                reached = residual * min(1.0, residual / before[w]) ** (left - 1) if w in before else 0.0
                again[w] = np.linalg.qr(product)[0] if left > 1 and reached <= RESIDUAL else np.eye(w)
                before[w] = residual
        columns, left = again, left - 1
    white = {w: s.axes / np.sqrt(s.eigenvalues) for w, s in spaces.items() if len(s.eigenvalues)}
    for w, (product, _) in (_multiply(points, spaces, white) if white else {}).items():
        spaces[w].identity_error = float(np.abs(white[w].T @ product - np.eye(white[w].shape[1])).max())
    return spaces


def project(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """One row for each row of (vec_id, x, width) and component of its space."""
    shared = rows.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, at, x in _by_width(b):
                space = shared.value.get(width)
                k = len(space.eigenvalues) if space else 0
                if not k:
                    continue
                white = space.centred(x) @ space.axes / np.sqrt(space.eigenvalues)
                rows, every = len(at), np.tile(np.arange(k), len(at))
                twice = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    b["vec_id"].take(pa.array(np.repeat(at, k))), pa.array(every + 1, pa.int32()), pa.array(np.full(rows * k, space.n), pa.int64()),
                    pa.array(space.deviations(x), pa.int64()).take(twice), pa.array(white.ravel()), pa.array((space.eigenvalues / space.trace)[every]), pa.array(np.full(rows * k, space.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame) -> DataFrame:
    """Per usable vector and component (16 at most): vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null, or holds a null or non-finite entry, is dropped. Vectors of another length are a space of their own; an empty one has no components, nor has
    a space whose points are all equal, and directions without variance (eigenvalue at most 1e-12 of the largest) are no components. A null vec_id stays null, repeated rows
    come out alike and count once in the fit, deviation is null where a long can't hold it. Columns other than vec_id and embedding are not read; no rows give none.
    """
    rows = grid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    points = materialize(rows.where("width > 0").select("x", "width").distinct(), "points")
    return project(rows, fit(points))
