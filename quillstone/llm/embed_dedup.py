"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, distributed components.

Equal vectors of a label are one point with a multiplicity. Each point falls into one bucket a table (the signs of ``bits``
random projections); points that share a bucket are compared by exact cosine in double precision. A bucket of more than
BLOCK points is cut into blocks, and pairs of blocks are compared by different tasks, so the work of a bucket spreads over the
cluster and no task holds more than two blocks. A pair is counted in the first table where it meets. What leaves a
comparison is a row per linked point (its links and one neighbour), never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.graph import connected_components, join_counted
from quillstone.llm.storage import materialize

COSINE = 0.93
BLOCK, PER_BUCKET = 512, 256
RECALL = 0.995
_KEY = ("label", "dim", "tab", "bucket", "bi", "bj")


def plan(points: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for the largest label's ``points``: buckets of about PER_BUCKET, and as many tables as find a pair right at the threshold with probability ``recall``."""
    bits = min(24, max(5, round(math.log2(max(points, 1) / PER_BUCKET))))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def planes(dim: int, count: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, count))


def usable(label: F.Column, v: F.Column) -> F.Column:
    """A vector that can link: a label, and components all finite and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _hash(bits: int, tables: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            dims = b["dim"].to_numpy()
            values = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(dims)
            signs = np.empty((b.num_rows, tables), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                signs[at] = ((x @ planes(int(dim), bits * tables)) > 0).reshape(len(at), tables, bits) @ weights
            packed = pa.array([row.tobytes() for row in signs], pa.binary())
            vectors = pa.array([values[e - d : e].astype(kind).tobytes() for e, d in zip(ends, dims, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["rep"], b["label"], b["dim"], b["copies"], vectors, packed], ["rep", "label", "dim", "copies", "vector", "signs"])

    return run


def _links(x: np.ndarray, signs: np.ndarray, table: int, side: np.ndarray, cosine: float) -> np.ndarray:
    """The pairs (i < j) that link and meet here first. side: which of two blocks a point is of; with two, only pairs across them."""
    norms = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / (norms[:, None] * norms[None, :]) >= cosine
    near = np.triu(near, 1)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    if table and len(i):
        new = ~(signs[i, :table] == signs[j, :table]).any(1)
        i, j = i[new], j[new]
    return np.stack([i, j], 1)


def _fixed(column: pa.Array, lo: int, hi: int, kind: type) -> np.ndarray:
    """Rows lo:hi of a binary column whose values there are all of one length, as a matrix."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int32)[column.offset + lo : column.offset + hi + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(kind).reshape(hi - lo, -1)


def _group(b: pa.RecordBatch, lo: int, hi: int, cosine: float, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rep, links, least rep over the links) of the linked points among rows lo:hi, which have one key."""
    bi, bj, table = (b[c][lo].as_py() for c in ("bi", "bj", "tab"))
    side = b["block"].to_numpy()[lo:hi] != bi
    if bi != bj and not (side.any() and not side.all()):
        return None
    pairs = _links(_fixed(b["vector"], lo, hi, kind).astype(np.float64), _fixed(b["signs"], lo, hi, np.int32), table, side, cosine)
    if not len(pairs):
        return None
    rep, copies, n = b["rep"].to_numpy()[lo:hi], b["copies"].to_numpy()[lo:hi], hi - lo
    links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], n) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], n)
    lowest = rep.copy()
    while True:  # least id over the links inside these blocks
        before = lowest.copy()
        np.minimum.at(lowest, pairs[:, 0], before[pairs[:, 1]])
        np.minimum.at(lowest, pairs[:, 1], before[pairs[:, 0]])
        if (before == lowest).all():
            break
    some = np.flatnonzero(links)
    return rep[some], links[some].astype(np.int64), lowest[some]


def _compare(cosine: float, kind: type):
    """Rows sorted by key to the links within each key; a key's rows, two blocks at most, are held until the next key begins."""

    def close(rows: pa.RecordBatch, last: bool) -> tuple[list[tuple], pa.RecordBatch]:
        change = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in _KEY:
            values = rows[k].to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        ends = np.flatnonzero(change) + 1
        ends = np.append(ends, rows.num_rows) if last else ends
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        out = [f for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True) if hi - lo > 1 and (f := _group(rows, lo, hi, cosine, kind))]
        return out, rows.slice(int(ends[-1]) if len(ends) else 0)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["rep", "links", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out, held = close(pa.concat_batches([held, b]) if held is not None and held.num_rows else b, False)
            if out:
                yield batch(out)
        if held is not None and held.num_rows:
            out, _ = close(held, True)
            if out:
                yield batch(out)

    return run


def _digest() -> list[F.Column]:
    """96 bits that stand for a vector; those of two different ones are left to differ."""
    v = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))  # a zero has one sign
    return [F.xxhash64(v).alias("digest"), F.hash(v).alias("digest2")]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero or holds a null or non-finite component, or has no label, links with nothing: n_links 0, its own
    component. Only vectors of one length are compared. Rows that repeat a vec_id count as vectors of their own; a null vec_id is its own
    component (null, kept false). Columns other than vec_id, label and embedding are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    v = v.withColumn("usable", usable(F.col("label"), F.col("embedding")) & F.col("vec_id").isNotNull())
    points = v.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    points = materialize(points.select("*", F.size("embedding").alias("dim"), *_digest()), "points")
    largest, distinct, total = points.groupBy("label").agg(F.count("*").alias("n"), F.sum("copies").alias("c")).agg(F.max("n"), F.sum("n"), F.sum("c")).first()  # three numbers
    largest, distinct, total = largest or 0, distinct or 0, total or 0
    bits, tables = plan(largest, cosine)
    kind = np.float32 if dict(points.dtypes)["embedding"] == "array<float>" else np.float64  # as they are stored: floats lose nothing
    hashed = points.select("rep", "label", "dim", "copies", "embedding").mapInArrow(_hash(bits, tables, kind), "rep long, label long, dim int, copies long, vector binary, signs binary")
    hashed = materialize(hashed, "hashed")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.conv(F.hex(F.substring("signs", t * 4 + 1, 4)), 16, 10).cast("long").alias("bucket")) for t in range(tables)]))
    placed = hashed.select("rep", "label", "dim", each.alias("e")).select("rep", "label", "dim", "e.tab", "e.bucket")
    size = placed.groupBy("label", "dim", "tab", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = join_counted(placed, size, ["label", "dim", "tab", "bucket"], distinct * tables)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", others).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    met = met.join(hashed.select("rep", "copies", "vector", "signs"), "rep").repartition(*_KEY).sortWithinPartitions(*_KEY)
    found = materialize(met.select(*_KEY, "rep", "copies", "vector", "signs", "block").mapInArrow(_compare(cosine, kind), "rep long, links long, peer long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("rep <> peer").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    named = points.drop("embedding").join(links, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    key = ["label", "digest", "digest2"]
    named = materialize(named.select(*key, F.col("copies").alias("n"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "named")
    # the vectors stay behind, and points of very many copies are joined by broadcast
    linked = join_counted(v.where("usable").select("vec_id", "label", *_digest()), named, key, total).select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = v.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

