"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, target / source size. The copies are prefix-summed in a
fixed order (small documents first, so that the draw is spread over sizes), one offset in [0, 1) is added, and a document
is emitted once for each integer boundary that its stretch crosses. A third of all rows may share one source: the prefix
sum is taken over counts of (source, size block, salt) cells, and only the rows of one cell are ever ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.storage import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(key, source_size) -> adds target. One row a source; sources are few, so one window over them is small.

    The targets are min(most * size, level * weight): sorted by size / weight, the first source that stays below its limit
    fixes the level at which the excess of those before it is shared.
    """
    order = Window.orderBy("key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("i"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double"))
    s = s.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    s = (
        s.withColumn("before", F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), F.col("key"), F.col("level")))).over(Window.partitionBy())
    s = s.withColumn("chosen", level.getField("level"))
    return s.select("key", "source_size", F.least(F.col("limit"), F.col("chosen") * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, *more: F.Column) -> DataFrame:
    key = F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col("source")))
    spread = F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))  # rows without an id are dealt by their texts
    return docs.select("doc_id", key.alias("key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.substring(F.md5(spread.cast("binary")), 1, 2).alias("salt"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (size * copies).

    Reads doc_id, text and source only; other columns may have any name. Null text counts as empty (size 0, never a word
    taken), a null source is a source of its own (the last one). Repeated rows are rows of their own. No rows: no result rows.
    """
    sized = materialize(_sized(docs), "sizes")
    return _draw(sized, sized, (), weights, most, seed).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """The rows of docs that the mix takes, whole, and after their columns size, target, copies and taken (an underscore before a name that docs has already). Rules as in ``mix``;
    rows that share a doc_id, or have none, are told apart by a hash of all their columns."""
    sized = materialize(_sized(docs), "sizes")
    whole = _sized(docs, F.struct(*docs.columns).alias("row"))
    ties = (F.xxhash64(F.to_json("row")),)
    taken = _draw(sized, whole, ties, weights, most, seed).where("copies > 0").withColumn("taken", F.col("size") * F.col("copies"))
    return taken.select("row.*", *[F.col(n).alias(fresh(docs, n)) for n in ("size", "target", "copies", "taken")])


def _draw(sized: DataFrame, rows: DataFrame, ties: tuple[F.Column, ...], weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """rows with source_size, target and copies. sized: doc_id, key, size and salt of the same rows."""
    targets = source_targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights, most)
    digits = F.col("size").cast("string")
    celled = lambda x: x.withColumn("block", (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int"))
    counts = celled(sized).groupBy("key", "block", "salt").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = celled(sized).groupBy("key", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("key", "block", before(Window.partitionBy("key").orderBy("block")).alias("block_at"))
    offsets = (
        counts.withColumn("salt_at", before(Window.partitionBy("key", "block").orderBy("salt")))
        .join(blocks, ["key", "block"])
        .select("key", "block", "salt", (F.col("salt_at") + F.col("block_at")).alias("at"))
    )
    within = Window.partitionBy("key", "block", "salt").orderBy("size", F.col("doc_id").asc_nulls_last(), *ties)
    ranked = celled(rows).withColumn("rank", F.row_number().over(within)).join(offsets, ["key", "block", "salt"]).join(targets, "key")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    upto = lambda r: F.floor(F.col("start") + F.col("share") * r)
    rank = (F.col("at") + F.col("rank")).cast("double")
    ranked = ranked.withColumn("share", share).withColumn("start", start)
    return ranked.withColumn("copies", (upto(rank) - upto(rank - 1)).cast("long"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key),
weighted AS (
  SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS lim FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size)::DOUBLE FROM sources)
            - coalesce(sum(lim) OVER (ORDER BY lim / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
chosen AS (SELECT level FROM levels WHERE level * weight <= lim ORDER BY lim / weight, key LIMIT 1),
targets AS (SELECT key, source_size, least(lim, (SELECT level FROM chosen) * weight) AS target FROM levels),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY key ORDER BY length(size::VARCHAR) * 100 + left(size::VARCHAR, 2)::INT,
                                 substr(md5(doc_id::VARCHAR), 1, 2), size, doc_id) AS rank FROM sized s),
spread AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share, rank,
         ('0x' || substr(md5('mix' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM ranked JOIN targets USING (key))
SELECT doc_id, size, source_size, target,
       CAST(floor(start + share * rank) - floor(start + share * (rank - 1)) AS BIGINT) AS copies,
       size * CAST(floor(start + share * rank) - floor(start + share * (rank - 1)) AS BIGINT) AS taken
FROM spread
"""
