"""Distributed connected components by alternating large-star and small-star steps.

Edges stay in tables throughout; a node's neighbours are only ever reduced to their minimum, which combines before the
shuffle, so a node with very many neighbours costs no more than its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.storage import materialize

#: Keys that are held to be hot, at most, and the rows from which on a key may be.
HOT_KEYS, HOT_ROWS = 20_000, 500


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows (``total`` of them) joined to counted, which has one row a key with ``n``, its number of rows. Hot keys are joined by broadcast, so that none lands in one task:
    a key is hot above ``total`` / HOT_KEYS rows, so there are fewer than HOT_KEYS of them."""
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(counted.where(F.col("n") > limit))
    cold = rows.join(hot.select(*on), on, "left_anti").join(counted.where(F.col("n") <= limit), on)
    return rows.join(hot, on).unionByName(cold)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (a > b), ``total`` of them. Large: every neighbour above a node is tied to the least of the node and its neighbours; small: a node and its lower neighbours."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        new = join_counted(both.where("b > a"), least, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = join_counted(edges, least.where("n > 1"), ["a"], total).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = tied.union(least.select("a", F.col("m").alias("b")))
    return new.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): for every node of an edge, the least node reachable from it. Edges (a, b) in any direction, repeated or looping; no edges, no rows."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    sums = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())  # noqa: E731  two numbers
    before = sums(e)
    while before[0]:  # the rounds grow with the logarithm of the nodes
        e = materialize(_star(materialize(_star(e, True, before[0]), "edges"), False, before[0]), "edges")
        now = sums(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
