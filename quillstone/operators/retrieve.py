"""Vector retrieval over batches of queries.

The chunk table is scanned once for each block of query vectors: every Arrow batch is multiplied with the block, by tiles of fixed size, and a task passes on only its best
k rows a query, so what is shuffled is queries x k x tasks, whatever the table holds. Everything after the recall works on
those few rows; payload columns are fetched for them at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone import registry
from quillstone.functions.filters import compile_filters, matching
from quillstone.functions.text import truncate
from quillstone.operators.metrics import Phases
from quillstone.sources.shared import materialize

FETCH_FACTOR, FETCH_LEAST = 5, 50
PER_DOCUMENT, BOOST = 3, 0.1
RERANKED, RERANK_BATCH, RERANK_TOP, RERANK_CHARS = 100, 100, 30, 4096
HYBRID_M, HYBRID_L = 4, 2
#: What a scan compares and holds, in bytes, twice: query vectors, and each query's best rows. More queries are searched for in blocks, a scan each.
BLOCK_BYTES = 64 << 20
#: Bytes of a held row, about.
HELD_BYTES = 48
#: Queries and rows whose scores a task has at once.
QUERIES, ROWS = 128, 2048


def fetch_k(top_k: int) -> int:
    return max(top_k * FETCH_FACTOR, FETCH_LEAST)


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows (n, chunk_id, _score) of each n, ties by chunk_id."""
    found = found.sort_by([("n", "ascending"), ("_score", "descending"), ("chunk_id", "ascending")])
    n = found["n"].to_numpy()
    first = np.searchsorted(n, n)
    return found.filter(pa.array(np.arange(len(n)) - first < k))


class _Tile:
    """The k best rows of each of a few queries, among all rows that are added. What it holds at once is the scores of ROWS rows and its best rows, twice.

    All products have one shape, filled up with zeros, since the last bits of a product depend on its shape: a pair has one score wherever it is compared.
    """

    def __init__(self, numbers: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.numbers, self.vectors, self.k = numbers, np.zeros((QUERIES, vectors.shape[1])), k
        self.vectors[: len(vectors)] = vectors
        self.least, self.held, self.parts, self.more = np.full((len(numbers), 1), -np.inf), None, [], 0

    def add(self, x: np.ndarray, ids: pa.Array) -> None:
        """x: ROWS vectors at unit length, of which the first have ids."""
        scores = (self.vectors @ x.T)[: len(self.numbers), : len(ids)]
        found = scores >= self.least
        if self.k < len(ids) and np.count_nonzero(found) > self.k * len(self.numbers):  # all ties of the k-th stay, for the order by chunk_id
            found = scores >= np.maximum(self.least, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k])
        n, at = np.nonzero(found)
        if len(at):
            self.parts.append(pa.table([pa.array(self.numbers[n]), ids.take(pa.array(at)), pa.array(scores[n, at])], ["n", "chunk_id", "_score"]))
            self.more += len(at)
        if self.more >= self.k * len(self.numbers):
            self.settle()

    def settle(self) -> pa.Table | None:
        """The best rows so far; others below the last of a query that has its k are passed over from now on."""
        if self.parts:
            self.held = _best(pa.concat_tables(self.parts if self.held is None else [self.held, *self.parts]), self.k).combine_chunks()
            self.parts, self.more = [], 0
            n, score = self.held["n"].to_numpy(), self.held["_score"].to_numpy()
            last = np.flatnonzero(np.append(n[1:] != n[:-1], True))
            last = last[last - np.searchsorted(n, n[last]) == self.k - 1]
            self.least[np.searchsorted(self.numbers, n[last]), 0] = score[last]
        return self.held


def _recall(k: int, block):
    """Arrow batches of (chunk_id, embedding) to a task's k best of each query. block: vectors by length, with the numbers of their queries in order."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = {}
        for length, (numbers, q) in block.value.items():
            cuts = np.array_split(np.arange(len(numbers)), -(-len(numbers) // QUERIES))
            tiles[length] = [_Tile(numbers[c], q[c], k) for c in cuts]
        for b in batches:
            lengths = b["embedding"].value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                if length not in tiles:  # vectors of a length that no query has
                    continue
                rows = b.filter(pa.array(lengths == length)) if (lengths != length).any() else b
                for lo in range(0, rows.num_rows, ROWS):
                    some = rows.slice(lo, ROWS)
                    x = some["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, length)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    able = np.isfinite(x).all(1)
                    ids = some["chunk_id"] if able.all() else some["chunk_id"].filter(pa.array(able))
                    x = np.concatenate([x[able], np.zeros((ROWS - len(ids), length))])
                    for tile in tiles[length] if len(ids) else ():
                        tile.add(x, ids)
        for tile in (t for of in tiles.values() for t in of):
            if (held := tile.settle()) is not None:
                yield from held.to_batches()

    return best


def cosine_recall(queries: DataFrame, chunks: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """queries (query_id, query_vector) x chunks (chunk_id, embedding): (query_id, chunk_id, _score, rank), the k best a query, ties by chunk_id.

    The predicate is applied before the ranking. Zero or null vectors, and those of another length than the query's, have no score and are not
    recalled. query_ids are distinct; a query is compared with all chunks. Queries beyond BLOCK_BYTES are searched for in blocks, whose results are written as they come.
    """
    spark = chunks.sparkSession
    types = dict(queries.dtypes) | {"chunk_id": dict(chunks.dtypes)["chunk_id"]}
    queries = queries.select("query_id", "query_vector").where("query_vector IS NOT NULL")
    size = queries.agg(F.count("*"), F.sum(F.size("query_vector")), F.max(F.size("query_vector"))).first()  # three numbers
    blocks = max(1, -(-2 * (size[0] or 0) * ((size[2] or 0) * 8 + k * HELD_BYTES) // BLOCK_BYTES))
    vectors_of = matching(chunks, where).where("embedding IS NOT NULL").select("chunk_id", "embedding")
    out = None
    for i in range(blocks):  # about half of BLOCK_BYTES each
        rows = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = rows.toArrow()
        lengths, by_length = np.array([len(v) for v in rows["query_vector"]], np.int64), {}
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            q = rows["query_vector"].take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)
            with np.errstate(invalid="ignore", divide="ignore"):
                by_length[length] = at, q / np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(by_length)
        found = vectors_of.mapInArrow(_recall(k, shared), f"n long, chunk_id {types['chunk_id']}, _score double")
        order = Window.partitionBy("n").orderBy(F.col("_score").desc(), "chunk_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = rows["query_id"].to_pylist()
        named = spark.createDataFrame(list(enumerate(ids)), f"n long, query_id {types['query_id']}")
        found = found.join(F.broadcast(named), "n").select("query_id", "chunk_id", "_score", "rank")  # a block's ids
        if blocks > 1:
            found = materialize(found, "recall")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _reasons(filters: list[dict] | None) -> Column:
    return F.array(*[F.lit(f"metadata:{f['field']}") for f in filters or ()]).cast("array<string>")


def search(queries: DataFrame, chunks: DataFrame, k: int, filters: list[dict] | None = None, kb_ids: list[str] | None = None, mode: str = "soft", strict_kb: bool = False) -> DataFrame:
    """(query_id, chunk_id, _score, _match_reasons, rank).

    hard: rank what passes the filters. soft: the global recall and the filtered recall together; what an explicit filter matched
    gains BOOST. As knowledge bases bound only the second recall there, ``strict_kb`` bounds both.
    """
    predicate = compile_filters(filters, kb_ids)
    semantic = F.array(F.lit("semantic"))
    if mode == "hard" or predicate is None:
        found = cosine_recall(queries, chunks, k, predicate)
        return found.select("query_id", "chunk_id", "_score", F.concat(semantic, _reasons(filters)).alias("_match_reasons"), "rank")
    everywhere = cosine_recall(queries, chunks, k, compile_filters(None, kb_ids) if strict_kb else None).select("query_id", "chunk_id", F.col("_score").alias("g"))
    narrowed = cosine_recall(queries, chunks, k, predicate).select("query_id", "chunk_id", F.col("_score").alias("f"))
    both = everywhere.join(narrowed, ["query_id", "chunk_id"], "full_outer")
    boosted = F.col("f").isNotNull() & F.lit(bool(filters))
    empty = F.array().cast("array<string>")
    reasons = F.array_distinct(F.concat(semantic, F.when(F.col("f").isNotNull(), _reasons(filters)).otherwise(empty)))
    merged = both.select("query_id", "chunk_id", (F.coalesce("g", "f") + F.when(boosted, F.lit(BOOST)).otherwise(F.lit(0.0))).alias("_score"), reasons.alias("_match_reasons"))
    order = Window.partitionBy("query_id").orderBy(F.col("_score").desc(), "chunk_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def payload(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Adds columns of the chunks to the hits."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")


def lexical_score(question: Column, text: Column) -> Column:
    """The share of the question's distinct words that the text has: a deterministic stand-in for a remote cross-encoder."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    asked = words(question)
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, words(text))) / F.size(asked))


def _scored(hits: DataFrame, top_n: int, scorer: Callable[[Column, Column], Column], batch: int) -> DataFrame:
    """hits with new_rank (null for those that re-ranking leaves out) and new_score."""
    inside = F.col("rank") <= RERANKED
    h = hits.withColumn("relevance", F.when(inside, scorer(F.col("question"), truncate(F.col("text"), RERANK_CHARS))))
    h = h.withColumn("scored", F.max("relevance").over(Window.partitionBy("query_id")).isNotNull())
    able = inside & (F.col("relevance").isNotNull() | ~F.col("scored"))
    h = h.withColumn("able", able).withColumn("key", F.when(F.col("scored"), F.col("relevance")).otherwise(-F.col("rank").cast("double")))
    position = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.col("key").desc_nulls_last(), "rank"))
    h = h.withColumn("in_batch", position("able", F.floor((F.col("rank") - 1) / batch)))
    h = h.withColumn("able", F.col("able") & (~F.col("scored") | (F.col("in_batch") <= top_n)))
    h = h.withColumn("place", position("able"))
    kept = F.col("able") & (F.col("place") <= top_n)
    h = h.withColumn("new_rank", F.when(kept, F.col("place"))).withColumn("new_score", F.when(kept & F.col("scored"), F.col("relevance")).otherwise(F.col("_score")))
    return h.drop("relevance", "scored", "able", "key", "in_batch", "place")


def rerank(hits: DataFrame, top_n: int = RERANK_TOP, scorer: Callable[[Column, Column], Column] = lexical_score, batch: int = RERANK_BATCH) -> DataFrame:
    """hits (query_id, question, text, _score, rank, ...): the best top_n of the first RERANKED by the scorer; where it gives no score at all, the first top_n in order.

    Candidates go to the scorer in batches; each batch yields at most top_n.
    """
    ranked = _scored(hits, top_n, scorer, batch).where("new_rank IS NOT NULL")
    return ranked.withColumn("_score", F.col("new_score")).withColumn("rank", F.col("new_rank")).drop("new_rank", "new_score")


def diversity(hits: DataFrame, most: int = PER_DOCUMENT) -> DataFrame:
    """At most ``most`` hits of a document (its doc_id, else its source_path; rows with neither pass), in order of rank. 0 or less: all."""
    if most <= 0:
        return hits
    key = F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("source_path", F.lit("")))
    hits = hits.withColumn("__doc", key)
    n = F.row_number().over(Window.partitionBy("query_id", "__doc").orderBy("rank"))
    return hits.withColumn("__n", n).where(F.col("__doc").isNull() | (F.col("__n") <= most)).drop("__doc", "__n")


def hybrid(reranked: DataFrame, vector: DataFrame, m: int = HYBRID_M, n: int = HYBRID_L) -> DataFrame:
    """The first m of the re-ranked hits, then those of the first n vector hits whose text is not among them, once each."""
    position = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(by))
    first = reranked.withColumn("pos", position("rank")).where(F.col("pos") <= m)
    more = vector.withColumn("pos", position("rank")).where(F.col("pos") <= n)
    more = more.join(first.select("query_id", "text"), ["query_id", "text"], "left_anti")
    more = more.withColumn("once", F.row_number().over(Window.partitionBy("query_id", "text").orderBy("pos"))).where("once = 1").drop("once")
    return first.withColumn("source", F.lit(0)).unionByName(more.withColumn("source", F.lit(1)), allowMissingColumns=True)


def retrieve(queries: DataFrame, chunks: DataFrame, top_k: int = 20, reranking: bool = True, hybrid_selection: bool = True, phases: Phases | None = None, **search_options) -> DataFrame:
    """queries (query_id, question, query_vector): recall, re-rank, diversity, hybrid selection, order by score. One row per chosen chunk: query_id, rank, chunk_id, doc_id, text, _score.

    The re-ranker and the hybrid selector are the registered ones; the two of this module are done in one pass. phases gets the marks recalled, payload and chosen.
    """
    mark = phases.mark if phases else lambda df, _: df
    recalled = mark(search(queries, chunks, fetch_k(top_k), **search_options), "recalled")
    hits = mark(payload(recalled, chunks, "text", "doc_id", "source_path"), "payload").join(queries.select("query_id", "question"), "query_id")
    reranker, selector = registry.resolve("reranker", rerank), registry.resolve("hybrid_selector", hybrid)
    if hybrid_selection and reranking and reranker is rerank and selector is hybrid:
        chosen = _hybrid_in_place(_scored(hits, RERANK_TOP, lexical_score, RERANK_BATCH))
    elif hybrid_selection and reranking:
        hits = materialize(hits, "hits")  # both selections read the same recall
        chosen = selector(diversity(reranker(hits)), hits)
    else:
        chosen = diversity(reranker(hits) if reranking else hits).withColumn("source", F.lit(0)).withColumn("pos", F.col("rank"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("_score", F.lit(0.0)).desc(), "source", "pos")
    out = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "doc_id", "text", "_score")
    return mark(out, "chosen")


def _hybrid_in_place(h: DataFrame, m: int = HYBRID_M, n: int = HYBRID_L, most: int = PER_DOCUMENT) -> DataFrame:
    """Re-ranked hits under the cap a document, and vector hits, chosen as by ``hybrid`` in one pass over the hits of a query: the recall is planned once. A vector hit that was re-ranked too carries its new score."""
    over = lambda *by: Window.partitionBy("query_id", *by)
    key = F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("source_path", F.lit("")))
    h = h.withColumn("doc", key).withColumn("reranked", F.col("new_rank").isNotNull())
    h = h.withColumn("of_doc", F.row_number().over(over("doc", "reranked").orderBy("new_rank")))
    h = h.withColumn("capped", F.col("reranked") & (F.col("doc").isNull() | (F.col("of_doc") <= most)))
    h = h.withColumn("pos", F.row_number().over(over("capped").orderBy("new_rank", "rank")))
    h = h.withColumn("first", F.col("capped") & (F.col("pos") <= m))
    h = h.withColumn("there", F.max("first").over(over("text"))).withColumn("recalled", ~F.col("there") & (F.col("rank") <= n))
    h = h.withColumn("once", F.row_number().over(over("text", "recalled").orderBy("rank")))
    h = h.where(F.col("first") | (F.col("recalled") & (F.col("once") == 1)))
    h = h.withColumn("source", F.when(F.col("first"), 0).otherwise(1)).withColumn("pos", F.when(F.col("first"), F.col("pos")).otherwise(F.col("rank")))
    return h.withColumn("_score", F.col("new_score"))


def metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """hits (query_id, item, rank), expected (query_id, item): per query recall (1 if any expected item is in the first k) and precision (share of the first k that is expected)."""
    first = hits.where(F.col("rank") <= k)
    marked = first.join(expected.select("query_id", "item", F.lit(1).alias("hit")).distinct(), ["query_id", "item"], "left")
    per = marked.groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("recall"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("precision"))
    every = expected.select("query_id").union(hits.select("query_id")).distinct()
    return every.join(per, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(0)).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"))
