"""Ranked lexical search: a hierarchical max tree over document ranges per term, searched best first with branch and bound.

The index has a row a shard, a range of documents that one task read in turn: its terms, and for each the documents that hold it and how often. A term's impact in a
document is what the score adds, but for the term's weight; the tree of a term has in each node the greatest impact in that node's range of FAN documents, ranges, and so on up to the
shard. A search sums a query's maxima to a bound of a node, opens the node of the highest bound first, and ends when no node left reaches the score of the last of the best
documents; nodes that equal it are opened, for the ties. Shards are the level above: the one of each query's highest bound is searched first, and a shard whose bound is below the score found
there is not opened for that query. Queries are searched for in blocks. Documents stay where they were read; only postings of the best cross the network.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.storage import materialize
from quillstone.llm.words import hash_words, row_ranges, utf8

#: A shard's documents and bytes of text, at most (but for one longer document); children of a node, as bits.
SHARD_DOCS, SHARD_BYTES, FAN_BITS = 4096, 4 << 20, 4
#: Bytes of distinct query texts in a block, about.
BLOCK_BYTES = 1 << 20
BEST = 10

_INDEX = "shard long, docs array<long>, filled long, total long, lengths binary, terms binary, ends binary, places binary, counts binary"


def shards_of(batches: Iterator[pa.RecordBatch], number: int, most_docs: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The shards of batches (doc_id, text), a row each, numbered from ``number``."""
    for b in batches:
        data, offsets = utf8(b["text"])
        for lo, hi in ((a, min(a + most_docs, end)) for begin, end in row_ranges(offsets, most_bytes) for a in range(begin, end, most_docs)):
            words, _, _, first = hash_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            size, rows = np.diff(first), hi - lo
            terms, code = np.unique(words, return_inverse=True)
            pairs, counts = np.unique(code * rows + np.repeat(np.arange(rows), size), return_counts=True)
            ends = np.searchsorted(pairs, (np.arange(len(terms)) + 1) * rows)
            blobs = (size.astype(np.int64), terms, ends.astype(np.int32), (pairs % rows).astype(np.uint16), counts.astype(np.uint32))
            columns = [pa.array([number]), pa.array([b["doc_id"][lo:hi].to_pylist()], pa.list_(pa.int64())), pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], [c.split()[0] for c in _INDEX.split(", ")])
            number += 1


def index(docs: DataFrame) -> DataFrame:
    """Rows (shard, docs, filled, total, ...) of all documents (doc_id, text) in the order in which they are read."""
    most_docs, most_bytes = min(SHARD_DOCS, 1 << 16), SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shards_of(batches, TaskContext.get().partitionId() << 32, most_docs, most_bytes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


class Queries:
    """A block of distinct query texts: query i has the terms terms[at[first[i]:first[i+1]]], each with its occurrences; weights are those of the terms."""

    def __init__(self, texts: list[str]):
        words, _, _, starts = hash_words(*utf8(pa.array(texts, pa.string())))
        self.terms, code = np.unique(words, return_inverse=True)
        row = np.repeat(np.arange(len(texts)), np.diff(starts))
        pairs, self.times = np.unique(row * max(1, len(self.terms)) + code, return_counts=True)
        self.at = pairs % max(1, len(self.terms))
        self.first = np.searchsorted(pairs // max(1, len(self.terms)), np.arange(len(texts) + 1))
        self.size = len(texts)
        self.weights = np.zeros(len(self.terms), np.int64)
        self.filled = self.total = 0
        self.floor = np.ones(self.size, np.int64)  # scores below it are of no use

    def weigh(self, filled: int, total: int, holding: np.ndarray) -> None:
        self.filled, self.total = filled, total
        self.weights = np.array([math.floor(1000 * math.log((2 * filled + 2) / (2 * df + 1))) if df else 0 for df in holding.tolist()], np.int64)


def _blob(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _postings(row: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of terms the shard has, first posting, postings) of sorted terms."""
    own, ends = _blob(row, "terms", np.uint64), _blob(row, "ends", np.int32)
    at = np.searchsorted(own, terms)
    have = np.flatnonzero(at < len(own))
    have = have[own[at[have]] == terms[have]]
    at = at[have]
    begin = np.where(at > 0, ends[at - 1], 0) if len(at) else np.zeros(0, np.int64)
    return have, begin.astype(np.int64), ends[at] - begin if len(at) else np.zeros(0, np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i]:begin[i]+size[i], one range after the other."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


class Tree:
    """The max trees of a shard, for the terms of a block of queries. levels: from documents up, sorted keys (term's number << 32 | node) and the greatest impact in each node."""

    def __init__(self, row: dict, queries: Queries):
        have, begin, size = _postings(row, queries.terms)
        at = _ranges(begin, size)
        place, count = _blob(row, "places", np.uint16)[at].astype(np.int64), _blob(row, "counts", np.uint32)[at].astype(np.int64)
        length = _blob(row, "lengths", np.int64)
        if len(length) and int(length.max()) * 75 * queries.filled >= 1 << 63:
            share = np.array([75 * int(n) * queries.filled // max(1, queries.total) for n in length], np.int64)
        else:
            share = 75 * length * queries.filled // max(1, queries.total)
        keys, most = np.repeat(have, size) << 32 | place, 1_000_000_000 * count // (1000 * count + 8 * (25 + share[place]))
        self.docs, self.levels = row["docs"], [(keys, most)]
        for _ in range(-(-max(1, (len(self.docs) - 1).bit_length()) // FAN_BITS)):
            parents = keys >> 32 << 32 | (keys & 0xFFFFFFFF) >> FAN_BITS
            cuts = np.flatnonzero(np.diff(parents, prepend=-1))
            keys, most = parents[cuts], np.maximum.reduceat(most, cuts) if len(cuts) else most
            self.levels.append((keys, most))
        self.roots = np.zeros(len(queries.terms), np.int64)
        self.roots[self.levels[-1][0] >> 32] = self.levels[-1][1]

    def bounds(self, queries: Queries) -> np.ndarray:
        """Each query's bound in this shard."""
        sums = np.concatenate([[0], np.cumsum((queries.weights * self.roots)[queries.at] * queries.times)])
        return sums[queries.first[1:]] - sums[queries.first[:-1]]

    def _children(self, level: int, node: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes below ``node`` with a bound above 0, their bounds); at the lowest level documents and their scores."""
        keys, most = self.levels[level - 1]
        low = np.searchsorted(keys, terms << 32 | node << FAN_BITS)
        size = np.searchsorted(keys, terms << 32 | (node + 1) << FAN_BITS) - low
        at = _ranges(low, size)
        sums = np.zeros(1 << FAN_BITS, np.int64)
        np.add.at(sums, (keys[at] & 0xFFFFFFFF) - (node << FAN_BITS), most[at] * np.repeat(weights, size))
        child = np.flatnonzero(sums)
        return child + (node << FAN_BITS), sums[child]

    def best(self, queries: Queries, q: int, bound: int, floor: int, k: int) -> list[tuple[int, int, int | None]]:
        """The k best (score, doc_id) of query q with a score of ``floor`` or more; equal scores by ascending doc_id, null last."""
        part = slice(queries.first[q], queries.first[q + 1])
        terms = queries.at[part].astype(np.int64)
        weights, here = queries.weights[terms] * queries.times[part], self.roots[terms] > 0
        terms, weights = terms[here], weights[here]
        nodes, found, scores = [(-bound, len(self.levels) - 1, 0)], [], []  # scores: the k highest, least first
        while nodes and -nodes[0][0] >= floor:
            _, level, node = heapq.heappop(nodes)
            for child, sum_ in zip(*(x.tolist() for x in self._children(level, node, terms, weights)), strict=True):
                if sum_ < floor:
                    continue
                if level > 1:
                    heapq.heappush(nodes, (-sum_, level - 1, child))
                    continue
                found.append((sum_, self.docs[child]))
                heapq.heappush(scores, sum_)
                if len(scores) > k:
                    heapq.heappop(scores)
                if len(scores) == k:
                    floor = max(floor, scores[0])
        return _best(found, k)


def _best(found: list[tuple[int, int | None]], k: int) -> list[tuple[int, int | None]]:
    return heapq.nsmallest(k, found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b[name][i].as_py() for name in b.schema.names}


def _holding(shards: DataFrame, queries: Queries) -> np.ndarray:
    """How many documents hold each of the queries' terms."""
    shared = shards.sparkSession.sparkContext.broadcast(queries.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shared.value), np.int64)
        for row in _rows(batches):
            have, _, size = _postings(row, shared.value)
            sums[have] += size
        have = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(sums[have], pa.int64())], ["term", "holding"])

    out = np.zeros(len(queries.terms), np.int64)
    for r in shards.select("terms", "ends").mapInArrow(run, "term long, holding long").groupBy("term").agg(F.sum("holding").alias("holding")).collect():  # a block's terms
        out[r["term"]] = r["holding"]
    return out


def _highest(shards: DataFrame, queries: Queries) -> list[int]:
    """The shards that have the highest bound of one of the queries."""
    shared = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, where = np.zeros(shared.value.size, np.int64), np.zeros(shared.value.size, np.int64)
        for row in _rows(batches):
            bounds = Tree(row, shared.value).bounds(shared.value)
            where[bounds > most] = row["shard"]
            most = np.maximum(most, bounds)
        some = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(most[some]), pa.array(where[some])], ["query", "bound", "shard"])

    best = shards.mapInArrow(run, "query long, bound long, shard long").groupBy("query").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    return [r["shard"] for r in best.select("shard").distinct().collect()]  # a block's queries at most


def _search(shards: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, score, doc_id, rank): each query's k best over the shards."""
    shared = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, found = shared.value, {}
        floor = queries.floor.copy()
        for row in _rows(batches):
            tree = Tree(row, queries)
            bounds = tree.bounds(queries)
            for q in np.flatnonzero(bounds >= floor).tolist():
                found[q] = _best(found.get(q, []) + tree.best(queries, q, int(bounds[q]), int(floor[q]), k), k)
                if len(found[q]) == k:
                    floor[q] = max(floor[q], found[q][-1][0])
        out = [(q, score, doc) for q, best in found.items() for score, doc in best]
        columns = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "score", "doc_id"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return shards.mapInArrow(run, "query long, score long, doc_id long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(shards: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """rank() over an index that is there already. items: (item_id, text)."""
    filled, total = shards.agg(F.sum("filled"), F.sum("total")).first()  # two numbers
    texts = materialize(items.where(F.col("text").isNotNull()).select("text", F.sha2("text", 256).alias("query_key")).distinct(), "queries")
    blocks = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    out = []
    for block in range(blocks if filled else 0):
        some = texts.where(F.pmod(F.xxhash64("query_key"), F.lit(blocks)) == block).orderBy("query_key").collect()  # about BLOCK_BYTES
        queries = Queries([r["text"] for r in some])
        if not len(queries.at):
            continue
        queries.weigh(filled, total, _holding(shards, queries))
        first = _search(shards.where(F.col("shard").isin(_highest(shards, queries))), queries, k).where(F.col("rank") == k)
        for r in first.collect():  # the last of each query's best so far
            queries.floor[r["query"]] = max(1, r["score"])
        keys = items.sparkSession.createDataFrame([(i, r["query_key"]) for i, r in enumerate(some)], "query long, query_key string")
        out.append(materialize(_search(shards, queries, k).join(F.broadcast(keys), "query").select("query_key", "rank", "doc_id", "score"), "ranked"))
    none = items.sparkSession.createDataFrame([], "query_key string, rank int, doc_id long, score long")
    ranked = none
    for part in out:
        ranked = ranked.unionByName(part)
    return items.select("item_id", F.sha2("text", 256).alias("query_key")).join(ranked, "query_key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """Per item: item_id, rank, doc_id, score of its k highest-scoring documents with a score above 0 (all, if fewer).

    A null or empty text, or one without a term, matches nothing and gets no rows. Each row of docs is a document, also where it repeats another or has no doc_id; equal scores come by
    ascending doc_id, null last. Items with one text get the same documents each. Columns other than doc_id, item_id and text are not read; no rows of either give none. Terms
    are told apart by 64-bit hashes.
    """
    return search(materialize(index(docs), "shards"), items, k)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
filled AS (SELECT r, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*)::bigint AS N_all, sum(n)::bigint AS L_all FROM filled),
asked AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
counted AS (
  SELECT r, doc_id, n, term, count(*)::bigint AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM filled) t
  WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * N_all + 2)::double / (2 * df + 1)::double))::bigint AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term) t, corpus),
parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * N_all) // L_all))) AS part
  FROM counted JOIN weights USING (term), corpus),
scored AS (SELECT i, item_id, r, doc_id, sum(part)::bigint AS score FROM asked JOIN parts USING (term) GROUP BY i, item_id, r, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS place FROM scored WHERE score > 0)
SELECT item_id, place::int AS rank, doc_id, score FROM placed WHERE place <= 10
"""
