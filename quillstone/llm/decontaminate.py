"""Benchmark decontamination by latent semantic retrieval.

Every document is cut into passages of two segments of SEGMENT words, at steps of one segment. Passages are TF-IDF vectors over hashed
words (the frequencies counted over all passages of all documents). A randomised SVD, distributed over the passages of all
documents too, gives a latent space; coordinates are centred and whitened, so that a language or a topic does not
dominate. All passages of all documents are projected and compared by cosine with the benchmark's items, in blocks; candidates that
share too few words with the item (SLACK of what one passage must have where the item is) are dropped, and the rest are decided on the words: the weighted longest common
subsequence with the item, and the item's answer (its rarest words) being there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.minhash import _sum
from quillstone.llm.words import ALNUM_WORDS, hash_words, row_ranges, utf8

SEGMENT = 16
BITS = 13
BUCKETS = 1 << BITS
RANK = 64
COSINE = 0.3
#: The share of the exact bound on its words that a candidate passage must reach: the passage whose vector is near may be the neighbour of the one that holds most of the item.
SLACK = 0.66
SIMILARITY = 0.6
ANSWER = 0.5
#: The most item windows that are broadcast: a benchmark beyond that is refused, not cut.
MOST_QUERIES, MOST_BYTES = 200_000, 1 << 28
#: A character that words are made of (ALNUM_WORDS).
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PASSAGES_AT_ONCE = 1 << 15
#: Segments that a task of the fit has at least, where there are more tasks than twice the cores: each task passes on a sum of BUCKETS x rank numbers, however few texts it has.
FIT_SEGMENTS = 1 << 19


@dataclass
class Segments:
    """Words of some rows, cut to segments. starts: first word of each; row: its row; paired: whether the next one is of the same row."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    row: np.ndarray
    paired: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Segments:
        h, _, _, first = hash_words(data, offsets, ALNUM_WORDS)
        count = -(-np.diff(first) // SEGMENT)
        at = np.concatenate([[0], np.cumsum(count)])
        starts = np.repeat(first[:-1] - at[:-1] * SEGMENT, count) + np.arange(at[-1]) * SEGMENT
        row = np.repeat(np.arange(len(count)), count)
        paired = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
        return Segments(h, first, starts, row, paired)

    @property
    def bucket(self) -> np.ndarray:
        return (self.hashes >> np.uint64(64 - BITS)).astype(np.int64)

    def of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.hashes))))

    def passages(self, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """One latent vector for the passage that begins at each segment. Weighted rows of the basis are summed word by word in blocks of segments."""
        scaled = np.concatenate([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
        b, lengths = self.bucket, np.diff(np.append(self.starts, len(self.hashes)))
        sums = np.empty((len(self.starts), basis.shape[1]), np.float32)
        for lo in range(0, len(self.starts), 4096):
            first, length, here = self.starts[lo : lo + 4096], lengths[lo : lo + 4096], sums[lo : lo + 4096]
            here[:] = scaled.take(b[first], 0)
            for k in range(1, SEGMENT):
                here += scaled.take(np.where(length > k, b[np.minimum(first + k, len(b) - 1)], BUCKETS), 0)
        at = np.flatnonzero(self.paired)
        out = sums.copy()
        out[at] += sums[at + 1]
        return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, Segments]]:
    data, offsets = utf8(column)
    for lo, hi in row_ranges(offsets, 2 << 20):
        yield lo, hi, Segments.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _packed(arrays: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(arrays), pa.int32()), pa.array([np.ascontiguousarray(a).tobytes() for a in arrays.values()], pa.binary())], ["block", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, totals = np.zeros(BUCKETS, np.int64), np.zeros(2, np.int64)
    for batch in batches:
        totals[1] += batch.num_rows
        for _, _, s in _pieces(batch.column(0)):
            b, seg = s.bucket, s.of_word()
            new = np.ones(len(b), bool)
            for k in range(1, min(SEGMENT, len(b))):  # not seen before in its segment
                new[k:] &= (b[k:] != b[:-k]) | (seg[k:] != seg[:-k])
            counts += np.bincount(b[new], minlength=BUCKETS)
            totals[0] += len(s.starts)
    if totals[1]:
        yield _packed({-1: totals} | dict(enumerate(counts.reshape(32, -1))))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, values in zip(b["block"].to_pylist(), b["counts"].to_pylist(), strict=True):
            values = np.frombuffer(values, np.float64)
            sums[block] = sums[block] + values if block in sums else values
    if sums:
        yield _packed(sums)


_SCHEMA = "block int, counts binary"


@dataclass
class Space:
    basis: np.ndarray
    idf: np.ndarray
    mean: np.ndarray
    white: np.ndarray

    def vectors(self, s: Segments) -> np.ndarray:
        return self.unit(s.passages(self.basis, self.idf))

    def unit(self, p: np.ndarray) -> np.ndarray:
        p = (p - self.mean) @ self.white
        return p / (np.linalg.norm(p, axis=1, keepdims=True) + 1e-9)


def fit_space(docs: DataFrame, rank: int = RANK, rounds: int = 2, seed: int = 1) -> Space:
    """docs: text (lower case, not null). Range finding by ``rounds`` distributed products with A^T A of the passages of all documents, then their moments: a pass over the texts each."""
    sc = docs.sparkSession.sparkContext
    counts, totals = np.zeros((32, BUCKETS // 32)), np.zeros(2)
    for r in docs.select("text").mapInArrow(_frequencies, _SCHEMA).repartition("block").mapInArrow(_sum, _SCHEMA).toLocalIterator():
        values = np.frombuffer(r.counts, np.int64)
        if r.block < 0:
            totals = values
        else:
            counts[r.block] = values
    idf = np.log((totals[0] + 1) / (counts.ravel() + 1)).astype(np.float32)
    texts = docs.select("text").coalesce(max(2 * sc.defaultParallelism, int(-(-totals[0] // FIT_SEGMENTS))))  # so that the sums that are shuffled stay a small share of the texts

    def product(basis: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rank, BUCKETS))
            some = False
            for batch in batches:
                for _, _, s in _pieces(batch.column(0)):
                    if len(s.starts):
                        some = True
                        p = s.passages(shared.value, idf)
                        y = p.copy()
                        at = np.flatnonzero(s.paired)
                        y[at + 1] += p[at]
                        b, lengths = s.bucket, np.diff(np.append(s.starts, len(s.hashes)))
                        for j in range(rank):  # a column at a time: the words of a segment stand together, so its value is repeated
                            total[j] += np.bincount(b, np.repeat(y[:, j], lengths), BUCKETS)
            total = np.ascontiguousarray((total * idf).T)
            if some:
                yield _packed(dict(enumerate(total.reshape(32, -1))))

        out = np.zeros((32, BUCKETS // 32 * rank))
        for r in texts.mapInArrow(run, _SCHEMA).repartition("block").mapInArrow(_add, _SCHEMA).toLocalIterator():
            out[r.block] = np.frombuffer(r.counts)
        return np.linalg.qr(out.reshape(BUCKETS, rank))[0].astype(np.float32)

    basis = np.random.default_rng(seed).standard_normal((BUCKETS, rank)).astype(np.float32)
    for _ in range(rounds):
        basis = product(basis)
    shared = sc.broadcast(basis)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((rank + 1, rank + 1))
        for batch in batches:
            for _, _, s in _pieces(batch.column(0)):
                p = s.passages(shared.value, idf).astype(np.float64)
                p = np.concatenate([p, np.ones((len(p), 1))], 1)
                m += p.T @ p
        if m[-1, -1]:
            yield _packed({0: m})

    m = sum((np.frombuffer(r.counts).reshape(rank + 1, rank + 1) for r in texts.mapInArrow(moments, _SCHEMA).repartition("block").mapInArrow(_add, _SCHEMA).toLocalIterator()), np.zeros((rank + 1, rank + 1)))
    n = max(m[-1, -1], 1.0)
    mean = m[-1, :-1] / n
    values, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    white = axes / np.sqrt(np.maximum(values, max(values.max(), 1e-9) * 1e-6))
    return Space(basis, idf, mean.astype(np.float32), white.astype(np.float32))


def places(item: np.ndarray) -> dict[int, int]:
    """For each word of an item its places, as bits."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    return masks


def common_subsequence(masks: dict[int, int], n: int, window: list[int]) -> int:
    """Length of the longest common subsequence with an item of n words, by bits: a word of the window a step."""
    full = v = (1 << n) - 1
    for w in window:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def weighted_subsequence(item: np.ndarray, weight: np.ndarray, window: np.ndarray) -> float:
    """The greatest weight of a common subsequence."""
    best = np.zeros(len(item) + 1)
    for w in window[np.isin(window, item)]:
        best[1:] = np.maximum(best[1:], np.where(item == w, best[:-1] + weight, 0))
        best = np.maximum.accumulate(best)
    return float(best[-1])


class Items:
    """The benchmark: its words, their weights, the latent vectors of its windows, and for each item the weights of its distinct words."""

    def __init__(self, ids: list[int], texts: pa.Array, space: Space, cosine: float = COSINE, slack: float = SLACK) -> None:
        self.cosine = cosine
        s = Segments.of(*utf8(texts))
        self.space, self.ids = space, ids
        self.words = [s.hashes[a:b] for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
        weights = np.maximum(space.idf[s.bucket], 0.1).astype(np.float64)
        self.weights = [weights[a:b] for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
        rows, owner = [], []
        for i, w in enumerate(self.words):
            n = len(w)
            size, step = (n, 1) if n <= 3 * SEGMENT else (2 * SEGMENT, SEGMENT)
            for at in range(0, n - size + 1, step) if n else ():
                b = (w[at : at + size] >> np.uint64(64 - BITS)).astype(np.int64)
                rows.append((space.basis[b] * space.idf[b][:, None]).sum(0) * (2 * SEGMENT / size))
                owner.append(i)
        if len(rows) > MOST_QUERIES:
            raise ValueError(f"{len(rows)} benchmark windows; at most {MOST_QUERIES} are searched for at once")
        self.queries = space.unit(np.stack(rows)) if rows else np.zeros((0, RANK), np.float32)
        self.owner = np.array(owner, np.int64)
        self.vocabulary = np.unique(s.hashes)
        # for each item the places of its words in the vocabulary, and the weight that each has at all its places: as large as the benchmark
        self.spots, self.sums = [], []
        for w, x in zip(self.words, self.weights, strict=True):
            distinct, of = np.unique(w, return_inverse=True)
            self.spots.append(np.searchsorted(self.vocabulary, distinct))
            self.sums.append(np.bincount(of, x, len(distinct)).astype(np.float32))
        self.need = np.array([slack * self._least(len(x)) * x.sum() / self._passages(len(x)) for x in self.weights])
        self.masks = [places(w) for w in self.words]
        self.bags = [{int(self.vocabulary[j]): float(x) for j, x in zip(spots, sums, strict=True)} for spots, sums in zip(self.spots, self.sums, strict=True)]
        self.keys = []
        for w, x in zip(self.words, self.weights, strict=True):
            distinct, at = np.unique(w, return_index=True)
            rare = np.argsort(-x[at], kind="stable")[: max(1, -(-len(distinct) // 4))]
            self.keys.append(distinct[rare])

    @staticmethod
    def _least(n: int) -> float:
        return (SIMILARITY if n >= 8 else 0.999) - 1e-4

    @staticmethod
    def _span(n: int) -> int:
        """Words of a window in which an item of n words is looked for."""
        return n + n // 4 + 2

    @staticmethod
    def _passages(n: int) -> int:
        """Passages that together cover any such window: the one that begins up to SEGMENT - 1 words before it, and those that follow without overlap. One of them holds its part of
        every common subsequence, so no item is there without a passage that has so much of it."""
        return 1 + max(0, -(-(Items._span(n) - SEGMENT - 1) // (2 * SEGMENT)))

    def leaks(self, s: Segments) -> list[tuple[int, int, float, float, float, int, int]]:
        """(row, item, cosine, similarity, answer, first word, words) of the items found in each row."""
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        if len(self.vocabulary) and len(s.starts) and len(self.queries):
            spot = np.minimum(np.searchsorted(self.vocabulary, s.hashes), len(self.vocabulary) - 1)
            word = np.where(self.vocabulary[spot] == s.hashes, spot, len(self.vocabulary)).astype(np.int32)
            word = np.append(word, len(self.vocabulary)).astype(np.int32)
            p, weight = self.space.vectors(s), np.zeros(len(self.vocabulary) + 1, np.float32)
            ends = np.minimum(s.starts + 2 * SEGMENT, s.first[s.row + 1])
            for lo in range(0, len(p), _PASSAGES_AT_ONCE):
                held = self._distinct(word, s.starts[lo : lo + _PASSAGES_AT_ONCE], ends[lo : lo + _PASSAGES_AT_ONCE])
                for q in range(0, len(self.queries), 1024):
                    cosine = p[lo : lo + _PASSAGES_AT_ONCE] @ self.queries[q : q + 1024].T
                    at, j = np.nonzero(cosine >= self.cosine)
                    for c in range(0, len(at), 1 << 18):
                        seg, item, cos = at[c : c + (1 << 18)] + lo, self.owner[j[c : c + (1 << 18)] + q], cosine[at[c : c + (1 << 18)], j[c : c + (1 << 18)]]
                        order = np.argsort(item, kind="stable")
                        for one in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
                            i = int(item[one[0]])
                            weight[self.spots[i]] = self.sums[i]
                            # the weight of the item's words that the passage has: no subsequence has more
                            bound = weight[held[:, seg[one] - lo]].sum(0)
                            for k in self._near(s, word, weight, i, seg, one[bound >= self.need[i]]).tolist():
                                found.setdefault((int(s.row[seg[k]]), i), []).append((int(seg[k]), float(cos[k])))
                            weight[self.spots[i]] = 0
        out = []
        for (row, item), hits in found.items():
            best = self._decide(s, row, item, sorted(hits))
            if best:
                out.append((row, item, *best))
        return out

    def _near(self, s: Segments, word: np.ndarray, weight: np.ndarray, item: int, seg: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Those candidates (numbers of seg) whose surroundings, all that _decide looks at, have enough of the item's words for a subsequence to weigh enough. weight: of the item's words."""
        if not len(some):
            return some
        n, least = len(self.words[item]), (self._least(len(self.words[item])) - 1e-4) * self.weights[item].sum()
        start, lo, hi = s.starts[seg[some]], s.first[s.row[seg[some]]], s.first[s.row[seg[some]] + 1]
        begin = np.maximum(lo, start - n)
        end = np.minimum(hi, np.maximum(begin + self._span(n), start + 2 * SEGMENT + n + n // 4) + max(1, n // 4))
        width, kept = int((end - begin).max()), []
        for a in range(0, len(some), max(1, (1 << 21) // width)):
            z = slice(a, a + max(1, (1 << 21) // width))
            at = begin[z, None] + np.arange(width)
            w = np.where(at < end[z, None], word[np.minimum(at, len(word) - 1)], len(self.vocabulary)).astype(np.int32)
            w.sort(1)
            w[:, 1:][w[:, 1:] == w[:, :-1]] = len(self.vocabulary)
            kept.append(some[z][weight[w].sum(1) >= least])
        return np.concatenate(kept)

    def _distinct(self, word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words x passages): the distinct words of each passage that are of the vocabulary, in as many rows as the fullest passage needs."""
        none = len(self.vocabulary)
        at = starts[:, None] + np.arange(2 * SEGMENT)
        w = np.where(at < ends[:, None], word[np.minimum(at, len(word) - 1)], none).astype(np.int32)
        w.sort(1)
        w[:, 1:][w[:, 1:] == w[:, :-1]] = none
        w.sort(1)
        return np.ascontiguousarray(w[:, : int((w < none).sum(1).max(initial=0))].T)

    def _decide(self, s: Segments, row: int, item: int, hits: list[tuple[int, float]]) -> tuple[float, float, float, int, int] | None:
        words, weights, bag = self.words[item], self.weights[item], self.bags[item]
        n, lo, hi = len(words), int(s.first[row]), int(s.first[row + 1])
        size, step, best, tried, total = self._span(n), max(1, n // 4), None, -1, weights.sum()
        least = SIMILARITY if n >= 8 else 0.999
        short = lambda some: sum(map(bag.__getitem__, bag.keys() & set(some))) < self._least(n) * total  # noqa: E731  no subsequence can weigh enough
        for seg, cosine in hits:
            start = int(s.starts[seg])
            begin, stop = max(lo, start - n), min(hi, start + 2 * SEGMENT + n)
            at, last = max(begin, tried + 1), stop + n // 4 - size
            if at > begin and at > last:
                continue
            tries = range(at, max(at, last) + 1, step)
            tried = tries[-1]
            region = s.hashes[at : min(tried + size, hi)].tolist()
            if short(region):
                continue
            windows = [(t, region[t - at : t - at + size]) for t in tries]
            scores = [(common_subsequence(self.masks[item], n, w), -t) for t, w in windows if not short(w)]
            if not scores:
                continue
            start = -max(scores)[1]
            window = s.hashes[start : min(start + size, hi)]
            answer = float(np.isin(self.keys[item], window).mean())
            if answer < ANSWER:
                continue
            similarity = weighted_subsequence(words, weights, window) / total
            if similarity >= least and (best is None or similarity > best[1]):
                best = (max(c for _, c in hits), similarity, answer, start - lo, len(window))
        return best


RESULT = "doc_id long, item_id long, cosine double, similarity double, answer double, first_word long, n_words long"


def load_items(docs: DataFrame, benchmark: DataFrame, space: Space | None = None) -> Items:
    """The benchmark in the latent space of docs. A benchmark is small by its nature; one of more than MOST_QUERIES windows is refused. Items without a word are found nowhere, so they are left out."""
    lower = docs.select("doc_id", F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    asked = benchmark.select("item_id", F.lower("text").alias("text")).where(F.col("text").rlike(_WORD))
    count, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()  # two numbers
    if count > MOST_QUERIES or (size or 0) > MOST_BYTES:
        raise ValueError(f"{count} benchmark items of {size} bytes; at most {MOST_QUERIES} windows and {MOST_BYTES} bytes are searched for at once")
    rows = asked.toArrow()
    return Items(rows["item_id"].to_pylist(), rows["text"], space or fit_space(lower))


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """docs with one more column at the end, how many items the document holds, under a name that docs must not have. A row's result depends on its text alone, so nothing is shuffled."""
    items = docs.sparkSession.sparkContext.broadcast(load_items(docs, benchmark))

    @F.arrow_udf("int")
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts = np.zeros(len(texts), np.int32)
            for lo, _, s in _pieces(texts):
                for row, *_ in items.value.leaks(s):
                    counts[lo + row] += 1
            yield pa.array(counts)

    return docs.withColumn(name, leaks(F.coalesce(F.lower(F.col("text")), F.lit(""))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, space: Space | None = None) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, similarity (weight of the common subsequence over the item's),
    answer (share of its rarest words that are there), first_word and n_words (where, counted in words of the document).

    Null texts are empty: an empty document holds nothing, an empty item is found nowhere. Items of under eight words must be there word by
    word. Repeated documents, and items that repeat a text or an id, each give their rows; a benchmark without rows gives none. Columns other than the ids and text are not read.
    """
    sc = docs.sparkSession.sparkContext
    lower = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    items = sc.broadcast(load_items(docs, benchmark, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for batch in batches:
            out = [(batch["doc_id"][lo + r].as_py(), known.ids[i], *rest) for lo, _, s in _pieces(batch["text"]) for r, i, *rest in known.leaks(s)]
            if out:
                fields = [x.split() for x in RESULT.split(", ")]
                kinds = {"long": pa.int64(), "double": pa.float64()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], [f for f, _ in fields])

    return lower.mapInArrow(run, RESULT)
