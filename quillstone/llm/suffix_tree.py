"""Language-model scoring by a probabilistic suffix tree.

Symbols are classes of UTF-8 bytes (the words of a text joined by one space, then an end). A context of up to DEPTH symbols
becomes a state when the distribution of its next symbol diverges enough from that of its longest proper suffix; next-symbol
distributions are smoothed towards the suffix's. A text is scored by the longest state that ends its past at each symbol.

One pass over the training texts gives two tables: counts of words and counts of (context, symbol). Both are summed by
Spark; the tree is cut by SQL over the second and grows with the corpus: a context is a state by the test of its own counts
alone. The tree is scored in parts of about PART counts, ranges of contexts with the suffixes that they share; while
it is one part, one pass scores every text whole, later each part adds the symbols whose past lies in its range. Frequent words (at most 2 * HOT_WORDS of them, proven by a histogram of their counts)
are looked up in a broadcast array; occurrences of the others are joined to their counts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.quality import bucket_of
from quillstone.llm.storage import materialize
from quillstone.llm.words import SPACE_WORDS, hash_words, row_ranges, utf8

DEPTH, BITS = 6, 6
SYMBOLS = 1 << BITS
START, END, SPACE = 0, 1, 2
SIGNIFICANCE = 5.0  # the likelihood ratio that a state must reach, per symbol seen after it
PART = 3_000_000  # counts of the tree that are broadcast at once
PIECE = 1 << 20  # bytes of text that are worked on at once
HELD = 1_500_000  # counts that a task holds before it passes them on
SMOOTHING = 3.0  # counts that a state gives to its suffix, per distinct symbol seen after it
HOT_WORDS = 1 << 18
_MARKS = b".,;:!?'\"-()"


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    c[:] = 41  # other ASCII
    c[[32, *range(9, 14)]] = SPACE
    for i in range(26):
        c[97 + i] = c[65 + i] = 3 + i
    c[48:58] = 29
    for i, m in enumerate(_MARKS):
        c[m] = 30 + i
    c[128:192] = 42 + (np.arange(64) & 15)
    c[192:256] = 58 + (np.arange(64) & 63) % 6
    return c


CLASS = _classes()
#: The byte that is told apart inside its class: A-Z count as a-z.
_FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def symbols(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, symbols, per-row bounds): one entry for each symbol of each row, the row's END included; contexts hold the last DEPTH symbols, the latest in the highest bits, so that a suffix is a range of contexts."""
    rows = len(offsets) - 1
    kept = CLASS[data] != SPACE
    inner = np.ones(len(starts), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    kept[starts[inner] - 1] = True  # the white space before every word but a row's first
    at = np.flatnonzero(kept)
    upto = np.searchsorted(at, offsets)
    pad = DEPTH + 1
    row = np.repeat(np.arange(rows), np.diff(upto))
    stream = np.zeros(len(at) + rows * pad, np.uint8)
    stream[np.arange(len(at)) + row * pad + DEPTH] = CLASS[data[at]]
    ends = upto[1:] + np.arange(rows) * pad + DEPTH
    stream[ends] = END
    context = np.zeros(len(stream), np.int64)
    for j in range(1, DEPTH + 1):
        context[j:] |= stream[:-j].astype(np.int64) << (BITS * (DEPTH - j))
    scored = np.ones(len(stream), bool)
    for j in range(DEPTH):
        scored[upto[:-1] + np.arange(rows) * pad + j] = False
    return context[scored], stream[scored], upto + np.arange(rows + 1)


class _Sums:
    """Counts by key, held as sorted arrays and merged when they have doubled."""

    def __init__(self, kind: int) -> None:
        self.kind, self.parts, self.held, self.distinct = kind, [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 2 * self.distinct + HELD // 2 and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.held = self.distinct = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[new], np.add.reduceat(counts[order], new) if len(new) else counts[:0]

    def batches(self, at_least: int = 0) -> Iterator[pa.RecordBatch]:
        if not self.parts or self.distinct < at_least:
            return
        keys, counts = self.merged()
        self.parts, self.held, self.distinct = [], 0, 0
        for i in range(0, len(keys), 200_000):
            k = keys[i : i + 200_000]
            k = k.view(np.int64) if k.dtype == np.uint64 else k.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), self.kind, np.int8)), pa.array(k), pa.array(counts[i : i + 200_000].astype(np.int64))], ["kind", "key", "n"])


WORDS, GRAMS, BYTES, ROWS = 0, 1, 2, 3


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, grams, single, rows = _Sums(WORDS), _Sums(GRAMS), np.zeros(256, np.int64), 0
    for b in batches:
        data, offsets = utf8(b.column(0))
        rows += b.num_rows
        for lo, hi in row_ranges(offsets, PIECE):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            h, s, _, first = hash_words(d, o, SPACE_WORDS)
            words.add(h)
            context, symbol, _ = symbols(d, o, s, first)
            grams.add((context << BITS) | symbol)
            single += np.bincount(_FOLDED[d], minlength=256)
            yield from words.batches(HELD)
            yield from grams.batches(HELD)
    yield from words.batches()
    yield from grams.batches()
    last = _Sums(BYTES)
    last.add(np.arange(256), single)
    yield from last.batches()
    last = _Sums(ROWS)
    last.add(np.zeros(1, np.int64), np.array([rows]))
    yield from last.batches()


def suffix_of(context, depth):
    """The context cut to its last ``depth`` symbols."""
    return context >> (BITS * (DEPTH - depth)) << (BITS * (DEPTH - depth))


def states(grams: DataFrame) -> DataFrame:
    """(depth, context, symbol, n) of the states, from (key = context and symbol, n). A state's suffixes are states too."""
    masks = F.array(*[F.lit(suffix_of((1 << (BITS * DEPTH)) - 1, d)).cast("long") for d in range(DEPTH + 1)])
    masked = lambda depth: F.col("context").bitwiseAND(F.element_at(masks, depth + 1))
    every = grams.select(F.shiftright("key", BITS).alias("context"), F.col("key").bitwiseAND(SYMBOLS - 1).alias("symbol"), "n", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth"))
    level = materialize(every.groupBy("depth", masked(F.col("depth")).alias("context"), "symbol").agg(F.sum("n").alias("n")), "suffix-levels")
    sums = level.groupBy("depth", "context").agg(F.sum("n").alias("all"))
    level = materialize(level.join(sums, ["depth", "context"]), "suffix-counted")
    suffix = level.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), "symbol", (F.col("n") / F.col("all")).alias("q"))
    # sum n ln(n / N / q) = sum n (ln n - ln q) - N ln N
    here = level.where("depth > 0").withColumn("suffix", masked(F.col("depth") - 1))
    tested = here.join(suffix, ["depth", "suffix", "symbol"]).groupBy("depth", "context").agg(
        F.first("all").alias("all"), F.count("*").alias("seen"), F.sum(F.col("n") * (F.log("n") - F.log("q"))).alias("s")
    )
    saved = F.col("s") - F.col("all") * F.log("all")
    kept = tested.where(2 * saved >= SIGNIFICANCE * F.col("seen"))
    nodes = kept.select(F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("depth"), "context").select("depth", masked(F.col("depth")).alias("context")).distinct()
    level = level.select("depth", "context", "symbol", "n")
    return level.where("depth = 0").union(level.join(nodes, ["depth", "context"]).select("depth", "context", "symbol", "n"))


def ranges(tree: DataFrame) -> list[tuple[int, int]]:
    """Ranges of contexts, together all, each with about PART of the tree's counts."""
    parts, bounds = ceil(tree.count() / PART), []
    if parts > 1:
        bounds = tree.agg(F.percentile_approx("context", [i / parts for i in range(1, parts)], 100_000)).first()[0]
    bounds = sorted({0, *bounds, 1 << (BITS * DEPTH)})
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def within(tree: DataFrame, lo: int, hi: int) -> DataFrame:
    """The states that are a suffix of some context from lo to before hi."""
    widths = F.array(*[F.lit(1 << (BITS * (DEPTH - d))).cast("long") for d in range(DEPTH + 1)])
    return tree.where((F.col("context") < hi) & (F.col("context") + F.element_at(widths, F.col("depth") + 1) > lo))


_DEPTH_BITS = 4
_SYMBOL_AT = BITS * DEPTH + _DEPTH_BITS


def _longest(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted (symbol and) context, where the longest of its suffixes is in the sorted keys (symbol, context, depth), a set that has every suffix of its members.

    The last key up to the wanted context begins as the longest suffix does, so what the two share is that suffix.
    """
    wanted = wanted << _DEPTH_BITS
    last = keys[np.searchsorted(keys, wanted | ((1 << _DEPTH_BITS) - 1), "right") - 1]
    differ = (last ^ wanted) >> _DEPTH_BITS
    shared = DEPTH - (np.frexp(differ.astype(np.float64))[1] + BITS - 1) // BITS
    depth = np.minimum(shared, last & ((1 << _DEPTH_BITS) - 1))
    width = _DEPTH_BITS + BITS * (DEPTH - depth)
    return np.searchsorted(keys, wanted >> width << width | depth)


@dataclass
class Part:
    """The states over a range of contexts. log10 p(symbol | state) = value of the longest suffix that has seen the symbol + weight of the state."""

    lo: int
    hi: int
    states: np.ndarray  # context, depth
    weights: np.ndarray  # summed log10 of what smoothing leaves to the suffixes
    entries: np.ndarray  # symbol, context, depth
    values: np.ndarray

    def logs(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of each symbol after its context; 0 where the context is not of this range."""
        out = np.zeros(len(context))
        here = np.flatnonzero((context >= self.lo) & (context < self.hi))
        wanted = symbol[here].astype(np.int64) << (BITS * DEPTH) | context[here]
        order = np.argsort(wanted)
        wanted = wanted[order]
        new = np.ones(len(wanted), bool)
        new[1:] = wanted[1:] != wanted[:-1]
        each = wanted[new]
        found = self.values[_longest(self.entries, each)] + self.weights[_longest(self.states, each & ((1 << (BITS * DEPTH)) - 1))]
        out[here[order]] = found[np.cumsum(new) - 1]
        return out


def build_part(rows: pa.Table, lo: int, hi: int) -> Part:
    """From (entry, n), entry made up of symbol, context and depth. Arrays are narrow and let go early: a driver has little memory."""
    entry, n = rows["entry"].to_numpy(), rows["n"].to_numpy()
    top = (entry & ((1 << _DEPTH_BITS) - 1)) == 0
    seen = np.bincount(entry[top] >> _SYMBOL_AT, n[top], SYMBOLS)
    usable = np.flatnonzero(np.arange(SYMBOLS) != START)
    root = (seen + 0.5) / (seen.sum() + 0.5 * len(usable))
    entry, n = entry[~top], n[~top].astype(np.float64)  # the root has every symbol
    states, of = np.unique(np.append(entry & ((1 << _SYMBOL_AT) - 1), 0), return_inverse=True)
    of = of[:-1].astype(np.int32)
    total, given = np.bincount(of, n, len(states)), SMOOTHING * np.bincount(of, minlength=len(states))
    depths = (states & ((1 << _DEPTH_BITS) - 1)).astype(np.int8)
    weights = np.zeros(len(states))
    entries = np.concatenate([usable << _SYMBOL_AT, entry])
    n, of = np.concatenate([np.zeros(len(usable)), n]), np.concatenate([np.zeros(len(usable), np.int32), of])
    del entry, top
    order = np.argsort(entries)
    entries, n, of = entries[order], n[order], of[order]
    del order
    probs = np.where(depths[of] == 0, root[entries >> _SYMBOL_AT], 0)
    for d in range(1, DEPTH + 1):  # a state's suffix is a state and has seen its symbols: it is ready
        width = _DEPTH_BITS + BITS * (DEPTH - d + 1)
        parent = lambda keys: keys >> width << width | (d - 1)  # noqa: B023, E731
        at = np.flatnonzero(depths == d)
        weights[at] = weights[np.searchsorted(states, parent(states[at]))] + np.log10(given[at] / (total[at] + given[at]))
        at = np.flatnonzero(depths[of] == d)
        share, all_of = given[of[at]], total[of[at]]
        probs[at] = (n[at] + share * probs[np.searchsorted(entries, parent(entries[at]))]) / (all_of + share)
    return Part(lo, hi, states, weights, entries, np.log10(probs) - weights[of])


@dataclass
class Bases:
    byte_logs: np.ndarray  # log10 of a byte given its class
    end_log: float
    hot: np.ndarray
    hot_logs: np.ndarray


def byte_logs(singles: np.ndarray) -> np.ndarray:
    folded = np.unique(_FOLDED)
    of_class = np.bincount(CLASS[folded], singles[folded] + 0.5, SYMBOLS)
    logs = np.log10((singles + 0.5) / of_class[CLASS])
    logs[CLASS == SPACE] = 0  # any run of white space is one space
    return logs[_FOLDED].astype(np.float32)


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, keys array<long>, times array<long>"


def score_texts(docs: DataFrame, folds: int = 10, fold: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(doc_id) mod ``folds`` is not ``fold``. Null text is empty: its one token is the end. A null
    doc_id trains. With no training text the tree is its root and every token is unknown. Repeated rows are scored one by one; words
    are told apart by a 64-bit hash. Columns other than doc_id and text are not read.
    """
    sc = docs.sparkSession.sparkContext
    held = F.coalesce(bucket_of(F.col("doc_id"), folds) == fold, F.lit(False))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    counted = docs.where(~F.col("held_out")).select("text").mapInArrow(_gather, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "suffix-counts")
    of = lambda kind: counted.where(F.col("kind") == kind).select("key", "n")
    words = of(WORDS)
    doubled = F.floor(F.log2("n")).cast("int")
    histogram = words.groupBy(doubled.alias("power")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()  # at most 63 rows
    train_rows = sum(r.n for r in of(ROWS).collect())
    total, distinct = sum(r.n for r in histogram) + train_rows, sum(r.words for r in histogram) + (train_rows > 0)
    least, room = 63, 2 * HOT_WORDS
    for r in sorted(histogram, key=lambda r: -r.power):
        room -= r.words
        if room < 0:
            break
        least = r.power
    hot = words.where(doubled >= least).toArrow().sort_by("key")  # at most 2 * HOT_WORDS rows, as the histogram shows
    base = lambda n: np.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
    singles = np.zeros(256)
    for r in of(BYTES).collect():  # 256 rows
        singles[r.key] = r.n
    bases = sc.broadcast(Bases(byte_logs(singles), float(base(train_rows)), hot["key"].to_numpy(), base(hot["n"].to_numpy())))
    known_end = int(train_rows > 0)
    tree = materialize(states(of(GRAMS)), "suffix-tree")
    parts = ranges(tree)
    docs = docs.withColumn("rid", F.monotonically_increasing_id())
    if len(parts) > 1:  # every pass must see the same numbers
        docs = materialize(docs, "suffix-texts")

    def part(lo: int, hi: int):
        entry = F.shiftleft("symbol", _SYMBOL_AT).bitwiseOR(F.shiftleft("context", _DEPTH_BITS)).bitwiseOR(F.col("depth").cast("long"))
        return sc.broadcast(build_part(within(tree, lo, hi).select(entry.alias("entry"), "n").toArrow(), lo, hi))  # about PART rows

    model = part(*parts[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bases.value
        for b in batches:
            data, offsets = utf8(b["text"])
            for lo, hi in row_ranges(offsets, PIECE):
                d, o, rows = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hi - lo
                h, s, _, first = hash_words(d, o, SPACE_WORDS)
                context, symbol, bounds = symbols(d, o, s, first)
                each = model.value.logs(context, symbol)
                spread = np.concatenate([[0], np.cumsum(m.byte_logs[d], dtype=np.float64)])
                text_score = np.add.reduceat(each, bounds[:-1]) + spread[o[1:]] - spread[o[:-1]]
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(m.hot, h), max(len(m.hot) - 1, 0))
                found = m.hot[at] == h if len(m.hot) else np.zeros(len(h), bool)
                row = np.repeat(np.arange(rows), np.diff(first))
                sums = np.bincount(row[found], m.hot_logs[at[found]], rows)
                known = np.bincount(row[found], minlength=rows)
                tail_row, tail = row[~found], h[~found]
                order = np.lexsort((tail, tail_row))
                tail_row, tail = tail_row[order], tail[order]
                new = np.flatnonzero(np.concatenate([[True], (tail[1:] != tail[:-1]) | (tail_row[1:] != tail_row[:-1])])) if len(tail) else np.zeros(0, int)
                times = np.diff(np.append(new, len(tail)))
                cuts = pa.array(np.searchsorted(tail_row[new], np.arange(rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        b["rid"].slice(lo, rows), b["doc_id"].slice(lo, rows).cast(pa.int64()), b["held_out"].slice(lo, rows), pa.array(np.diff(first) + 1), pa.array(known + known_end),
                        pa.array(sums + m.end_log), pa.array(text_score), pa.ListArray.from_arrays(cuts, pa.array(tail[new])), pa.ListArray.from_arrays(cuts, pa.array(times)),
                    ],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "keys", "times"],
                )

    def more(model):
        def score_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = utf8(b["text"])
                for lo, hi in row_ranges(offsets, PIECE):
                    d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                    _, s, _, first = hash_words(d, o, SPACE_WORDS)
                    context, symbol, bounds = symbols(d, o, s, first)
                    each = np.add.reduceat(model.value.logs(context, symbol), bounds[:-1])
                    yield pa.RecordBatch.from_arrays([b["rid"].slice(lo, hi - lo), pa.array(each)], ["rid", "more"])

        return score_rest

    scored = materialize(docs.mapInArrow(score, SCORED), "suffix-scores")
    rest = []
    for lo, hi in parts[1:]:
        model.unpersist()
        model = part(lo, hi)
        rest.append(materialize(docs.select("rid", "text").mapInArrow(more(model), "rid long, more double"), "suffix-scores"))
    if rest:
        rest = reduce(DataFrame.union, rest).groupBy("rid").agg(F.sum("more").alias("more"))
        scored = scored.join(rest, "rid").withColumn("score", F.col("score") + F.col("more")).drop("more")
    tail = scored.select("rid", F.explode(F.arrays_zip("keys", "times")).alias("t")).select("rid", F.col("t.keys").alias("key"), F.col("t.times").alias("times"))
    rare = words.where(doubled < least)
    n = F.coalesce("n", F.lit(0))
    tail = tail.join(rare, "key", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(total + 0.1 * (distinct + 1)))).alias("tail_base"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    return scored.drop("keys", "times").join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score",
    )
