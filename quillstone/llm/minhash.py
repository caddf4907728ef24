"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words. Weights are (1 + ln tf) * idf, with document frequencies counted over all documents by hash bucket (a
table of fixed size). HASHES consistent weighted samples a document (Gamma(2,1), Gamma(2,1) and uniform variates read from a
fixed table by shingle hash) are cut into bands. Equal texts are one class from the start. Links between classes are verified by the weighted
Jaccard similarity of their whole texts. In a bucket of up to SMALL classes all pairs are compared. In a larger one a few comparisons
settle most of it first: every class meets two of its bucket (the one that meets most others over all bands, and one drawn by a hash), and the
bucket is cut again by the next band, up to DEPTH bands together, with the same rule. Every pair of a large bucket that is in two components
still is then compared, by blocks of BLOCK classes: each block that has not joined the bucket's main component with each other block of the
bucket, inside tasks that work on two blocks' texts and pass on a row per linked class, never the pairs. A pair is skipped only if its weights
rule the similarity out, if it is in one component already, or if it met in an earlier band. So of the classes that share a band no link is left to
chance. Links are closed to groups by distributed connected components. Nothing groups a bucket or a class in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.graph import connected_components, join_counted
from quillstone.llm.storage import fresh, materialize
from quillstone.llm.words import ALNUM_WORDS, hash_words, mix, row_ranges, shingles, utf8

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
HASHES = BANDS * ROWS
IDF_BITS, BLOCK_BITS = 20, 12
TABLE_BITS = 13
#: How much more the rarest shingle weighs than the most frequent one.
SPAN = 0.25
SMALL, DEPTH = 5, 4
#: Classes of a large bucket, and their weight (about their shingles), that one key of the full comparison holds, twice: what bounds a task's memory.
BLOCK, BLOCK_WEIGHT = 256, 60_000
#: Bytes of text that are worked on at once.
PIECE = 1 << 20
#: Shingles of more classes of two blocks than this are multiplied as a dense matrix, COLUMNS at once; the others pair by pair.
SPARSE, COLUMNS = 24, 2048
#: Ids of 8 bytes that are broadcast to read the candidates' texts without moving all others; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def weighted_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of 44 bits, count) of the distinct shingles of each row, rows in order."""
    h, _, _, first = hash_words(data, offsets, ALNUM_WORDS)
    s, s_first = shingles(h, first, WIDTH)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(s_first))
    both, count = np.unique((row << np.uint64(44)) | (s >> np.uint64(20)), return_counts=True)
    return (both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1), count


def damped(count: np.ndarray) -> np.ndarray:
    """1 + ln tf: a line that is repeated hundreds of times doesn't outweigh the text."""
    return 1 + np.log(count)


def bucket_of_shingle(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44 - IDF_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros(1 << IDF_BITS, np.int64), 0
    for b in batches:
        data, offsets = utf8(b.column(0))
        rows += b.num_rows
        for lo, hi in row_ranges(offsets, PIECE):
            _, h, _ = weighted_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            counts += np.bincount(bucket_of_shingle(h), minlength=1 << IDF_BITS)
    if rows:
        yield _blocks({-1: np.array([rows], np.int64)} | dict(enumerate(counts.reshape(-1, 1 << BLOCK_BITS))))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b["block"].to_pylist(), b["counts"].to_pylist(), strict=True):
            counts = np.frombuffer(counts, np.int64)
            sums[block] = sums[block] + counts if block in sums else counts
    if sums:
        yield _blocks(sums)


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have a shingle of each of 2**IDF_BITS buckets, and documents in all. The blocks of the table are summed by Spark; its size is fixed."""
    schema = "block int, counts binary"
    counted = docs.select(F.coalesce(F.lower("text"), F.lit("")).alias("text")).mapInArrow(_count, schema)
    table, total = np.zeros(1 << IDF_BITS, np.int64), 0
    for r in counted.repartition("block").mapInArrow(_sum, schema).toLocalIterator():
        counts = np.frombuffer(r.counts, np.int64)
        if r.block < 0:
            total += int(counts[0])
        else:
            table[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] += counts
    return table, total


def idf_table(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + SPAN ln((N + 1) / (df + 1)) / ln(N + 2), from 1 to 1 + SPAN: rare shingles weigh more. The span is small, since in a large group of near copies what they share is frequent
    and what sets them apart is rare: a wide one would take their similarity far below what the texts have in common."""
    out = np.empty(len(counts), np.float32)
    for lo in range(0, len(counts), 1 << BLOCK_BITS):  # the driver holds no copies of the whole table in double precision
        out[lo : lo + (1 << BLOCK_BITS)] = (1 + SPAN * np.log((total + 1) / (counts[lo : lo + (1 << BLOCK_BITS)] + 1.0)) / np.log(total + 2)).clip(1, 1 + SPAN)
    return out


class Sampler:
    """The variates of each sample: A = ln c + r beta - r, r, 1 / r and beta, by the top bits of the shingle's hash."""

    def __init__(self, hashes: int = HASHES, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        size = (hashes, 1 << TABLE_BITS)
        r, c, beta = rng.gamma(2, 1, size), rng.gamma(2, 1, size), rng.random(size)
        r = np.maximum(r, 1e-3)
        self.a = (np.log(c) + r * beta - r).astype(np.float32)
        self.r, self.inverse, self.beta = r.astype(np.float32), (1 / r).astype(np.float32), beta.astype(np.float32)
        self.factor = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, first: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(documents x hashes) identities of the samples. first: where each document's shingles start; none is empty."""
        h = mix(h)
        log_weight = np.log(weight).astype(np.float32)
        low = h & np.uint64(0xFFFFFFFF)
        out = np.empty((len(first), len(self.factor)), np.uint32)
        for k in range(len(self.factor)):
            i = ((h * self.factor[k]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            t = np.floor(log_weight * self.inverse[k].take(i) + self.beta[k].take(i))
            value = self.a[k].take(i) - self.r[k].take(i) * t
            bits = value.view(np.uint32)
            ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            identity = low ^ ((t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF))
            out[:, k] = np.minimum.reduceat((ordered << np.uint64(32)) | identity, first) & np.uint64(0xFFFFFFFF)
        return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """(documents x BANDS) hashes of the bands, each with its number."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]) + np.uint64(1)
    for j in range(ROWS):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, j])
    return acc.view(np.int64)


_SIGNED = "doc_id long, text_key string, bands array<long>, weight double"


def _similarity(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts."""
    (da, oa), (db, ob) = utf8(a), utf8(b)
    out = np.zeros(len(a))
    for lo, hi in row_ranges(oa + ob, PIECE):
        n = hi - lo
        ra, ha, ca = weighted_shingles(da[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo])
        rb, hb, cb = weighted_shingles(db[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo])
        key = np.concatenate([(ra.astype(np.uint64) << np.uint64(44)) | ha, (rb.astype(np.uint64) << np.uint64(44)) | hb])
        key, at = np.unique(key, return_inverse=True)
        wa, wb = np.bincount(at[: len(ra)], damped(ca), len(key)), np.bincount(at[len(ra) :], damped(cb), len(key))
        row = (key >> np.uint64(44)).astype(np.int64)
        w = idf[bucket_of_shingle(key & np.uint64((1 << 44) - 1))]
        by = lambda x: np.bincount(row, x, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[lo:hi] = np.nan_to_num(by(np.minimum(wa, wb) * w) / by(np.maximum(wa, wb) * w))
    return out


def similarities(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarities of all pairs of some texts. The minima of the weights are summed shingle by shingle, a count c as c layers that each add what damping leaves of it."""
    data, offsets = utf8(texts)
    n = len(texts)
    row, h, count = weighted_shingles(data, offsets)
    worth = idf[bucket_of_shingle(h)].astype(np.float64)
    totals = np.bincount(row, damped(count) * worth, n)
    upto = np.cumsum(count)
    level = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - count, count) + 1
    row, worth = np.repeat(row, count), np.repeat(worth, count) * (damped(level) - np.where(level > 1, damped(np.maximum(level - 1, 1)), 0))
    key = mix(np.repeat(h, count) + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    key, row, worth = key[order], row[order], worth[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(key)))
    column = np.repeat(np.arange(len(begin)), size)
    shared = np.zeros((n, n))
    few = (size > 1)[column] & (size <= SPARSE)[column]
    c, r, w = column[few], row[few], worth[few]
    for d in range(1, SPARSE):
        same = np.flatnonzero(c[d:] == c[:-d]) if len(c) > d else []
        if not len(same):
            break
        shared += np.bincount(r[same] * n + r[same + d], w[same], n * n).reshape(n, n)  # rows of a column are in order: each pair once
    shared += shared.T
    many = np.flatnonzero(size > SPARSE)
    for at in range(0, len(many), COLUMNS):
        some = many[at : at + COLUMNS]
        x = np.zeros((n, len(some)))
        entries = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(size[some])[:-1]]), size[some]) + np.arange(size[some].sum())
        x[row[entries], np.repeat(np.arange(len(some)), size[some])] = np.sqrt(worth[entries])
        shared += x @ x.T
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(shared / (totals[:, None] + totals[None, :] - shared))


_BLOCKS = ("band", "i", "j")


def _compare(idf, similarity: float):
    """Rows sorted by key to (node, peer): each class that has a link within its key, and the least class that it reaches there."""

    def group(b: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray] | None:
        i, j, tab = (b[c][lo].as_py() for c in ("i", "j", "tab"))
        own, component, node, weight = (b[c].to_numpy()[lo:hi] for c in ("own", "component", "node", "weight"))
        bands = b["bands"].slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, BANDS)
        wanted = np.triu(component[:, None] != component[None, :], 1)
        if i != j:
            wanted &= (own[:, None] == i) != (own[None, :] == i)
        wanted &= np.minimum(weight[:, None], weight[None, :]) >= (similarity - 1e-9) * np.maximum(weight[:, None], weight[None, :])
        for t in range(tab):
            wanted &= bands[:, None, t] != bands[None, :, t]
        some = np.flatnonzero(wanted.any(0) | wanted.any(1))
        if not len(some):
            return None
        texts = b["text"].slice(lo, hi - lo).take(pa.array(some))
        x, y = np.nonzero((similarities(texts, idf.value) >= similarity - 1e-9) & wanted[np.ix_(some, some)])
        if not len(x):
            return None
        x, y = some[x], some[y]
        lowest = node.copy()
        while True:
            before = lowest.copy()
            np.minimum.at(lowest, x, before[y])
            np.minimum.at(lowest, y, before[x])
            if (before == lowest).all():
                break
        linked = np.unique(np.concatenate([x, y]))
        return node[linked], lowest[linked]

    def close(rows: pa.RecordBatch, last: bool) -> tuple[list, pa.RecordBatch]:
        change = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in _BLOCKS:
            values = rows[k].to_numpy()
            change |= values[1:] != values[:-1]
        ends = np.flatnonzero(change) + 1
        ends = np.append(ends, rows.num_rows) if last else ends
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        out = [f for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True) if hi - lo > 1 and (f := group(rows, lo, hi))]
        return out, rows.slice(int(ends[-1]) if len(ends) else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out, held = close(pa.concat_batches([held, b]) if held is not None and held.num_rows else b, False)
            for node, peer in out:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(peer)], ["a", "b"])
        if held is not None and held.num_rows:
            for node, peer in close(held, True)[0]:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(peer)], ["a", "b"])

    return run


def _node(text_key: F.Column) -> F.Column:
    """A class's number: 60 bits of its text's digest."""
    return F.conv(F.substring(text_key, 1, 15), 16, 10).cast("long")


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text (not null). (signed, classes): doc_id and text_key of each row; text_key, rep (its least doc_id, or null), n_equal and component of each class of equal texts."""
    sc = docs.sparkSession.sparkContext
    idf = sc.broadcast(idf_table(*document_frequencies(docs)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for b in batches:
            data, offsets = utf8(b["text"])
            for lo, hi in row_ranges(offsets, PIECE):
                row, h, count = weighted_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                some, first = np.unique(row, return_index=True)
                weight = damped(count) * idf.value[bucket_of_shingle(h)]
                bands = bands_of(sampler.signatures(first, h, weight)) if len(some) else np.zeros((0, BANDS), np.int64)
                cuts = np.zeros(hi - lo + 1, np.int32)
                cuts[some + 1] = BANDS
                arrays = [b["doc_id"].slice(lo, hi - lo), b["text_key"].slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.cumsum(cuts).astype(np.int32)), pa.array(bands.ravel()))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.bincount(row, weight, hi - lo).astype(np.float64))], ["doc_id", "text_key", "bands", "weight"])

    digest = F.md5(F.col("text").cast("binary"))
    signed = materialize(docs.select("doc_id", F.lower("text").alias("text"), digest.alias("text_key")).mapInArrow(sign, _SIGNED), "signatures")
    classes = signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_equal"), F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    classes = materialize(classes.withColumn("node", _node(F.col("text_key"))), "classes")
    total = BANDS * classes.count()
    members = classes.select("node", F.posexplode("bands").alias("tab", "band"))
    size = materialize(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    # all bands of a class are fetched for those that share one
    members = join_counted(members, size, ["band"], total).join(classes.select("node", "bands"), "node")
    members = materialize(members, "members")
    wanted = classes.select("node", "rep").join(members.select("node").distinct(), "node", "left_semi")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    # the text of one row of each class; rows that repeat its least doc_id have equal texts
    texts = docs.select("doc_id", F.lower("text").alias("text"), _node(digest).alias("at"))
    texts = texts.join(wanted, (F.col("at") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts")

    @F.arrow_udf("double")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array(_similarity(a, b, idf.value))

    pairs = materialize(_first_pairs(members, total).distinct(), "pairs")
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", similar("text_a", "text_b").alias("similarity"))
    links = materialize(scored.where(F.col("similarity") >= similarity - 1e-9).select("a", "b"), "links")
    joined = materialize(connected_components(links), "joined")
    blocks = _blocks_apart(members.where(F.col("n") > SMALL), joined, classes.select("node", "weight"), total)
    blocks = materialize(blocks, "blocks")
    compared = blocks.join(texts, "node").repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS)
    rest = materialize(compared.select(*_BLOCKS, "tab", "own", "node", "component", "weight", "bands", "text").mapInArrow(_compare(idf, similarity), "a long, b long"), "rest-links")
    if not rest.isEmpty():  # components of components
        known = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
        joined = materialize(connected_components(known.union(rest)), "joined")
    classes = classes.join(joined.withColumnRenamed("id", "node"), "node", "left")
    return signed.select("doc_id", "text_key"), classes.select("text_key", "rep", "n_equal", F.coalesce("component", "node").alias("component"))


def _first_pairs(members: DataFrame, total: int) -> DataFrame:
    """(a, b): all pairs of small buckets, and those that settle most of a large one. Those of a depth are written before the next, since one plan of all depths is large in the driver: adaptive
    execution writes it out anew at each of its stages."""
    count = F.lit(BANDS)
    central = members.where(F.col("n") > SMALL).groupBy("node").agg(F.sum("n").alias("meets"))
    here, pairs = members.select("node", "bands", "tab", "band", "n").join(central, "node", "left"), None
    for depth in range(DEPTH):
        if depth:  # cut by the next band too: classes that share more bands are nearer to each other
            again = F.xxhash64("band", F.element_at("bands", (F.pmod(F.col("tab") + depth, count) + 1).cast("int")))
            here = here.drop("n").withColumn("band", again)
            shared = here.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
            here = materialize(join_counted(here, shared, ["band"], total), "buckets")
        small = here.where(F.col("n") <= SMALL).select("band", "node")
        found = small.select("band", F.col("node").alias("b")).join(small.select("band", F.col("node").alias("a")), "band").where("a > b").select("a", "b")
        here = here.where(F.col("n") > SMALL)
        centres = here.groupBy("band").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("most"), F.max_by("node", F.xxhash64("band", "node")).alias("any"), F.count("*").alias("n"))
        met = join_counted(here.drop("n"), centres, ["band"], total).select("node", F.explode(F.array("most", "any")).alias("centre")).where("node <> centre")
        found = found.union(met.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")))
        found = materialize(found, "found")
        pairs = found if pairs is None else pairs.union(found)
    return pairs


def _blocks_apart(members: DataFrame, joined: DataFrame, weights: DataFrame, total: int) -> DataFrame:
    """Rows of the full comparison: each large bucket that is not in one component, as pairs (i, j) of blocks of which i has not joined the main component."""
    large = members.join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    large = large.drop("n").join(weights, "node")
    inside = large.groupBy("band", "component").agg(F.struct(F.count("*").alias("k"), F.sum("weight").alias("w"), F.col("component").alias("main")).alias("of"))
    mixed = inside.groupBy("band").agg(F.max("of").alias("of"), F.sum("of.k").alias("n"), F.sum("of.w").alias("w")).where("n > of.k").select("band", "n", "w", "of.main", F.col("of.k").alias("in_main"), F.col("of.w").alias("main_w"))
    large = join_counted(large, mixed, ["band"], total)
    blocks_of = lambda k, w: F.greatest(F.ceil(k / BLOCK), F.ceil(w / BLOCK_WEIGHT)).cast("int")
    apart, joined_blocks = blocks_of(F.col("n") - F.col("in_main"), F.col("w") - F.col("main_w")), blocks_of(F.col("in_main"), F.col("main_w"))
    is_main = F.col("component") == F.col("main")
    large = large.withColumn("ra", apart).withColumn("rm", joined_blocks)
    own = F.when(is_main, F.col("ra") + F.pmod(F.xxhash64("node"), F.col("rm")).cast("int")).otherwise(F.pmod(F.xxhash64("node"), F.col("ra")).cast("int"))
    others = F.when(is_main, F.sequence(F.lit(0), F.col("ra") - 1)).otherwise(F.sequence(F.lit(0), F.col("ra") + F.col("rm") - 1))
    large = large.withColumn("own", own).withColumn("other", F.explode(others))
    return large.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "tab", "own", "node", "component", "bands", "weight")


def _key(doc_id: F.Column) -> F.Column:
    """Orders rows without a doc_id last."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_equal (documents with the same text), kept (doc_id = class_id).

    Null text is empty. A text without words is a near copy of nothing but of texts equal to it. Texts of under five words have one
    shingle. Rows that repeat a doc_id are rows of their own, whose texts may be of different classes; a row without a doc_id is in no
    class of its own (class_id null, kept true), but its text may link others. Columns other than doc_id and text are not read.
    """
    signed, classes = groups(_plain(docs), similarity)
    least = classes.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = classes.join(least, "component").select("text_key", "n_equal", "class_id")
    out = signed.join(named, "text_key", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), "n_equal", F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near copies, with all its columns: of those with the least doc_id (rows without one come last) the one of the first text by digest; of rows that
    are equal in doc_id and text one stays, the first by a hash of all its columns."""
    signed, classes = groups(_plain(docs), similarity)
    chosen = classes.groupBy("component").agg(F.min(F.struct(_key(F.col("rep")).alias("key"), "text_key")).alias("least")).select("least.text_key", F.col("least.key.none").alias("none"), F.col("least.key.id").alias("id"))
    here = signed.select("text_key", _key(F.col("doc_id")).alias("key")).select("text_key", "key.none", "key.id").groupBy("text_key", "none", "id").agg(F.count("*").alias("rows"))
    chosen = chosen.join(here, ["text_key", "none", "id"])
    names = {n: fresh(docs, n) for n in ("text_key", "none", "id", "rows")}
    chosen = chosen.select(*[F.col(old).alias(new) for old, new in names.items()])
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    marked = docs.withColumn(names["text_key"], text).withColumn(names["none"], F.col("doc_id").isNull()).withColumn(names["id"], F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    on = [names[n] for n in ("text_key", "none", "id")]
    kept = marked.join(chosen, on)
    once = kept.where(F.col(names["rows"]) == 1).select(*docs.columns)
    row = F.struct(*docs.columns)
    several = kept.where(F.col(names["rows"]) > 1).groupBy(*on).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return once.unionByName(several)
