"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise part by the
sum-of-squares identity, so the cost of a document is linear in its distinct features. The model is fitted on the driver
from at most FIT_ROWS labelled rows (those first by a hash of doc_id), has a fixed size, and is broadcast; every document
is scored whole inside an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import SPACE_WORDS, hash_words, row_ranges, shingles, utf8

#: Documented bound of the rows that the model is fitted on.
FIT_ROWS = 8000
BUCKETS = 1 << 15
FACTORS = 8
THRESHOLD = 0.7
BINS = 10
STATS = (
    "upper", "digit", "symbol", "stop_mark", "space", "other_byte", "word_length", "log_words", "distinct_words", "top_word", "distinct_runs",
    "line_words", "short_lines", "marked_words", "log_chars", "long_words",
)

_b = np.arange(256)
_UPPER = (_b >= 65) & (_b <= 90)
_DIGIT = (_b >= 48) & (_b <= 57)
_LETTER = _UPPER | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
_STOP = np.isin(_b, [ord(c) for c in ".,;:?"])
_SPACE = (_b == 32) | ((_b >= 9) & (_b <= 13))
_SYMBOL = ~(_LETTER | _DIGIT | _STOP | _SPACE) & (_b < 128)
_CLASS = np.select([_UPPER, _DIGIT, _SYMBOL, _STOP, _SPACE, _b >= 128], [1, 2, 3, 4, 5, 6], 0).astype(np.uint8)


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return (sums[first[1:]] - sums[first[:-1]]).astype(np.float64)


def _counts(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of the distinct pairs; key below 2**40."""
    both, counts = np.unique((row.astype(np.int64) << 40) | key, return_counts=True)
    return both >> 40, both & ((1 << 40) - 1), counts


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the word features, values of unit length in each row, and the statistics (rows x STATS)."""
    rows = len(offsets) - 1
    h, s, e, first = hash_words(data, offsets, SPACE_WORDS)
    row = np.repeat(np.arange(rows), np.diff(first))
    n = np.maximum(np.diff(first), 1)
    r, bucket, count = _counts(row, (h >> np.uint64(64 - 15)).astype(np.int64))
    value = np.log1p(count.astype(np.float64))
    value /= np.sqrt(np.bincount(r, value * value, rows))[r] if len(r) else 1.0
    word_row, _, word_count = _counts(row, (h >> np.uint64(24)).astype(np.int64))
    runs, run_first = shingles(h, first, 5)
    run_row, _, _ = _counts(np.repeat(np.arange(rows), np.diff(run_first)), (runs >> np.uint64(24)).astype(np.int64))
    kinds = _CLASS[data]
    chars = np.maximum(np.diff(offsets), 1).astype(np.float64)
    share = lambda k: _by_row(kinds == k, offsets) / chars
    top = np.zeros(rows)
    np.maximum.at(top, word_row, word_count)
    lines = _by_row(data == 10, offsets) + 1
    breaks = np.flatnonzero(data == 10)
    line_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    line_first = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_first, line_row))
    line_row, line_first = line_row[order], line_first[order]
    line_end = np.append(line_first[1:], len(data))
    line_end = np.where(np.append(line_row[1:] != line_row[:-1], True), offsets[line_row + 1], line_end) if rows else line_end  # a row's last line ends with it
    short = np.bincount(line_row, line_end - line_first < 40, rows)[:rows]
    last = kinds[e - 1] if len(e) else np.zeros(0, np.uint8)
    stats = np.stack(
        [
            share(1), share(2), share(3), share(4), share(5), share(6), _by_row(e - s, first) / n, np.log1p(np.diff(first)),
            np.bincount(word_row, minlength=rows)[:rows] / np.sqrt(n), top / n, np.bincount(run_row, minlength=rows)[:rows] / np.maximum(np.diff(run_first), 1),
            np.log1p(n / lines), short / lines, _by_row(last == 3, first) / n, np.log1p(np.diff(offsets)), _by_row((e - s) >= 7, first) / n,
        ], 1,
    )
    return r, bucket, value, stats


@dataclass
class Machine:
    """w0, w and v over BUCKETS word features, one feature a statistic and BINS a statistic; edges and scales of the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value), rows together; features of a row are distinct."""
        r, bucket, value, stats = features(data, offsets)
        rows, n = stats.shape
        z = np.clip((stats - self.mean) / self.scale, -3, 3) / np.sqrt(n)
        bins = np.stack([np.searchsorted(self.edges[:, j], stats[:, j]) for j in range(n)], 1) + np.arange(n) * BINS
        row = np.concatenate([r, np.repeat(np.arange(rows), n), np.repeat(np.arange(rows), n)])
        feature = np.concatenate([bucket, np.tile(BUCKETS + np.arange(n), rows), (BUCKETS + n + bins).ravel()])
        x = np.concatenate([value, z.ravel(), np.full(rows * n, 1 / np.sqrt(n))])
        order = np.argsort(row, kind="stable")
        return row[order], feature[order], x[order]

    def logits(self, row: np.ndarray, feature: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        first = np.searchsorted(row, np.arange(rows))  # each row has the statistics' features, so none is empty
        vx = self.v[feature] * x[:, None].astype(np.float32)
        sums, squares = np.add.reduceat(vx, first, 0), np.add.reduceat(vx * vx, first, 0)
        return self.w0 + np.add.reduceat(self.w[feature] * x, first) + 0.5 * (sums * sums - squares).sum(1)

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        out = np.empty(len(texts))
        for lo, hi in row_ranges(offsets):
            d = self.design(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(self.logits(*d, hi - lo), -35, 35)))
        return out


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad in about ``steps`` mini-batches. No labelled rows: a machine that scores 0.5."""
    rng = np.random.default_rng(seed)
    n = len(STATS)
    size = BUCKETS + n + n * BINS
    data, offsets = utf8(texts)
    m = Machine(0.0, np.zeros(size), (rng.standard_normal((size, FACTORS)) * 0.02).astype(np.float32), np.zeros((BINS - 1, n)), np.zeros(n), np.ones(n))
    if not len(labels):
        m.v[:] = 0
        return m
    stats = np.concatenate([features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[3] for a, b in row_ranges(offsets, 1 << 20)])
    m.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0)
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-6
    counts, features_of, values_of = [], [], []
    for a, b in row_ranges(offsets, 1 << 20):  # held in narrow types: a driver has little memory
        r, f, v = m.design(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        counts.append(np.bincount(r, minlength=b - a))
        features_of.append(f.astype(np.int32))
        values_of.append(v.astype(np.float32))
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    feature, x = np.concatenate(features_of), np.concatenate(values_of)
    del features_of, values_of
    m.w0 = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    gw, gv = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    size_of = min(256, max(16, len(labels) // 30))
    for _ in range(-(-steps * size_of // len(labels))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), size_of):
            batch = np.sort(order[at : at + size_of])
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            r = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
            f, xx = feature[take], x[take]
            starts = np.searchsorted(r, np.arange(len(batch)))
            vx = m.v[f] * xx[:, None]
            sums = np.add.reduceat(vx, starts, 0)
            z = m.w0 + np.add.reduceat(m.w[f] * xx, starts) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts, 0)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[batch]) / len(batch) * 32
            m.w0 -= 0.01 * float(g.sum()) / 32
            gx = g[r] * xx
            used = np.unique(f)
            dw = np.bincount(f, gx, size)[used] + decay * m.w[used]
            gw[used] += dw * dw
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            dv_each = gx[:, None] * (sums[r] - vx)
            for k in range(FACTORS):
                dv = np.bincount(f, dv_each[:, k], size)[used] + decay * m.v[used, k]
                gv[used, k] += dv * dv
                m.v[used, k] -= (rate * 0.5 * dv / np.sqrt(gv[used, k])).astype(np.float32)
    return m


def bucket_of(doc_id: F.Column, buckets: int) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """Fit on labelled documents outside the held-out fold (crc32(doc_id) mod 4 = 2), at most ``rows``; of equal labels of a doc_id the least counts."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 4) != 2))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a threshold first, so that the tasks together pass on little more than `rows`
    share = 2 * rows / max(usable.count(), 1)
    usable = usable.select("doc_id", "quality").where(place < (1 << 30) * min(share, 1.0))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(place, "doc_id").limit(rows)
    # at most `rows` rows of two numbers: the bound of what is broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(found["text"].combine_chunks() if found.num_rows else pa.array([], pa.string()), found["quality"].to_numpy().astype(np.float64))


def score_column(docs: DataFrame, machine: Machine, score_name: str = "score") -> DataFrame:
    """docs with one more column at the end, the score (double), under a name that docs must not have."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.value.score(texts))

    return docs.withColumn(score_name, score(F.coalesce(F.col("text"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input of the score; of a document's metadata that is its length, the one that is no label, language, source or id. Null text is scored as empty; an empty text has zero statistics and no words. Repeated
    rows have equal scores; without labelled rows all scores are 0.5. Columns other than doc_id and text are not read.
    """
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = score_column(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
