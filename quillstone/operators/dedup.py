"""Deduplication of documents by content. Uploads of a batch see those before them, as they do one by one; the stream form is in streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_metadata(old: Column, new: Column) -> Column:
    """Incoming values win; an empty or null incoming map leaves the old one."""
    old_, new_ = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (old, new))
    return F.map_zip_with(old_, new_, lambda _, a, b: F.coalesce(b, a))


def entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))


def merge_paths(old: Column, new: Column) -> Column:
    """Both without repeats, the old ones first."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


#: What makes uploads copies of one document.
KEY = ("kb_id", "content_hash", "collection_name")
#: Uploads by order in one block, about, and the most blocks.
BLOCK_ROWS, MOST_BLOCKS = 100_000, 10_000


def _known(catalog: DataFrame) -> DataFrame:
    """Documents that completed; those that never did don't count, so that a failed upload can be repeated."""
    return catalog.where("status = 'completed'").withColumn("collection_name", F.coalesce("collection_name", F.lit("chunks")))


def _paths(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*KEY, *more, F.posexplode("source_paths").alias("place", "path"))


def _tags(rows: DataFrame, *more: str) -> DataFrame:
    """Null values leave the old ones, as in merge_metadata."""
    return rows.select(*KEY, *more, F.explode("user_metadata").alias("tag", "value")).where("value IS NOT NULL")


def _new_paths(incoming: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """(key, path, order, place) of the upload that first names a path which the document did not have, and where in its list."""
    first = _paths(incoming, order).groupBy(*KEY, "path").agg(F.min(F.struct(order, "place")).alias("f")).select(*KEY, "path", "f.*")
    return first.join(_paths(known), [*KEY, "path"], "left_anti")


def _new_tags(incoming: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """(key, order) of the uploads that give a tag another value than it had just before. The value before is the one of the upload before in the same block of orders, else the last one
    of the blocks before, else the document's: no tag's uploads all meet in one task."""
    tag = [*KEY, "tag"]
    rows = _tags(incoming, order)
    blocks = max(1, min(MOST_BLOCKS, incoming.count() // BLOCK_ROWS))
    rows = rows.repartitionByRange(blocks, order).withColumn("block", F.spark_partition_id())
    inside = Window.partitionBy(*tag, "block").orderBy(order)
    rows = rows.withColumn("at", F.row_number().over(inside)).withColumn("before", F.lag("value").over(inside))
    heads = rows.where("at = 1").select(*tag, "block", order, "value")
    tails = rows.groupBy(*tag, "block").agg(F.max_by("value", order).alias("last"))
    tails = tails.withColumn("last", F.lag("last").over(Window.partitionBy(*tag).orderBy("block")))
    old = _tags(known).withColumnRenamed("value", "had")
    heads = heads.join(tails, [*tag, "block"]).join(old, tag, "left")
    heads = heads.withColumn("before", F.coalesce("last", "had"))
    changed = lambda df: df.where(~F.col("before").eqNullSafe(F.col("value"))).select(*KEY, order)
    return changed(rows.where("at > 1")).unionByName(changed(heads))


def upload_status(incoming: DataFrame, catalog: DataFrame, order: str) -> DataFrame:
    """incoming (doc_id, kb_id, content_hash, collection_name, source_paths, user_metadata, and ``order``, the column that says which upload came before which) with status.

    accepted: the first upload of a content that no completed document of its knowledge base and collection has; metadata_updated: the content is known by then, from the catalogue or from an upload
    before, and this one adds a path or gives a tag another value; already_exists otherwise. A null or empty map changes nothing, nor does a null value; without a knowledge
    base or a content an upload is accepted; a collection that is null is "chunks". Uploads of one content with equal order count as one. Facts are joined to uploads by key and order, so a content that a third of all uploads share is no single task's.
    """
    incoming = incoming.withColumn("collection_name", F.coalesce("collection_name", F.lit("chunks")))
    known, at = _known(catalog), [*KEY, order]
    first = incoming.groupBy(*KEY).agg(F.min(order).alias(order)).join(known.select(*KEY), list(KEY), "left_anti").withColumn("first_of_all", F.lit(True))
    changed = _new_paths(incoming, known, order).select(*at).unionByName(_new_tags(incoming, known, order)).distinct().withColumn("changes", F.lit(True))
    rows = incoming.join(first, at, "left").join(changed, at, "left")
    alone = F.col("kb_id").isNull() | F.col("content_hash").isNull()
    status = F.when(F.col("first_of_all") | alone, "accepted").when(F.col("changes"), "metadata_updated").otherwise("already_exists")
    return rows.select(*incoming.columns, status.alias("status"))


def merged_records(incoming: DataFrame, catalog: DataFrame, order: str) -> DataFrame:
    """(key, doc_id, source_paths, user_metadata) of each document that uploads name: the doc_id it has, else that of its first upload; its paths and then the new ones in the order of the uploads that
    first name them; of each tag the last value. What meets in one place are a document's distinct paths and tags, not its uploads."""
    incoming = incoming.where("kb_id IS NOT NULL AND content_hash IS NOT NULL").withColumn("collection_name", F.coalesce("collection_name", F.lit("chunks")))
    known = _known(catalog).select(*KEY, F.col("doc_id").alias("old_id"), F.col("source_paths").alias("old_paths"), F.col("user_metadata").alias("old_tags"))
    every = incoming.groupBy(*KEY).agg(F.min_by("doc_id", order).alias("doc_id"))
    paths = _new_paths(incoming, _known(catalog), order).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(order, "place", "path"))).alias("paths"))
    tags = _tags(incoming, order).groupBy(*KEY, "tag").agg(F.max_by("value", order).alias("value")).groupBy(*KEY)
    tags = tags.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")))).alias("tags"))
    rows = every.join(known, list(KEY), "left").join(paths, list(KEY), "left").join(tags, list(KEY), "left")
    new = F.transform("paths", lambda p: p["path"])
    return rows.select(*KEY, F.coalesce("old_id", "doc_id").alias("doc_id"), merge_paths(F.col("old_paths"), F.coalesce(new, F.array().cast("array<string>"))).alias("source_paths"), merge_metadata(F.col("old_tags"), F.col("tags")).alias("user_metadata"))


def distinct_contents(docs: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first document (by ``order``) of each combination of keys and how many share it; counted before the shuffle."""
    return docs.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("copies"))
