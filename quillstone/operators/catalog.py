"""Catalogue reads over the chunk store: documents, metadata keys and values, discovery, document search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.filters import compile_filters, discovery_scope, glob, matching, metadata_equals
from quillstone.operators.retrieve import search

FIXED_FIELDS = (("doc_id", "string"), ("source_path", "string"), ("page_title", "string"), ("language", "string"), ("kb_id", "string"), ("filename", "string"))


def filled(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def list_documents(chunks: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """One row per document, from its chunk with the least chunk_id; rows without a doc_id are left out."""
    chunks = matching(chunks, metadata_equals(metadata or {})).where(F.coalesce(F.col("doc_id"), F.lit("")) != "")
    # min_by of the projected fields combines before the shuffle, so a document of any number of chunks is one row a task
    fields = F.struct(
        "source_path", "page_title", filled("kb_id", "default").alias("kb_id"), filled("filename", "").alias("filename"), F.coalesce("content_size", F.lit(0)).cast("long").alias("content_size"),
        filled("ingestion_status", "completed").alias("ingestion_status"), "created_at", "content_hash", "user_metadata",
    )
    return chunks.groupBy("doc_id").agg(F.min_by(fields, "chunk_id").alias("d")).select("doc_id", "d.*")


def count_documents(chunks: DataFrame) -> DataFrame:
    return chunks.where("doc_id <> ''").agg(F.count_distinct("doc_id").alias("documents"))


def metadata_keys(chunks: DataFrame) -> DataFrame:
    return list_documents(chunks).select(F.explode(F.map_keys("user_metadata")).alias("key")).distinct()


def metadata_values(chunks: DataFrame, key: str) -> DataFrame:
    """Documents by value of a key; most frequent first, then by value. Only the fields of list_documents and keys of user_metadata have values."""
    docs = list_documents(chunks)
    plain = key.removeprefix("user_metadata.")
    value = F.col(key) if key in docs.columns and key != "user_metadata" else F.try_element_at("user_metadata", F.lit(plain))
    return docs.select(value.cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "value")


def metadata_schema(chunks: DataFrame) -> DataFrame:
    """The fields that filters can name: the fixed ones and the keys in use."""
    fixed = chunks.sparkSession.createDataFrame(FIXED_FIELDS, "field string, type string")
    return fixed.unionByName(metadata_keys(chunks).select(F.concat(F.lit("user_metadata."), F.col("key")).alias("field"), F.lit("string").alias("type")))


def search_documents(queries: DataFrame, chunks: DataFrame, limit: int, **options) -> DataFrame:
    """The best chunk of each document, from 5 * limit chunks; reasons of its chunks joined and sorted."""
    hits = search(queries, chunks, limit * 5, **options).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    per = hits.groupBy("query_id", "doc_id").agg(
        F.min("rank").alias("best"), F.min_by("chunk_id", "rank").alias("chunk_id"), F.min_by("_score", "rank").alias("_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_match_reasons")))).alias("_match_reasons")
    )
    order = Window.partitionBy("query_id").orderBy("best")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("best")


def discover(chunks: DataFrame, pattern: str, kb_ids: list[str] | None = None, filters: list[dict] | None = None, limit: int = 0, case_sensitive: bool = False) -> DataFrame:
    """Documents whose file name matches a glob, within knowledge bases and filters; in order of doc_id, at most limit (0: all)."""
    found = matching(chunks, compile_filters(filters)).where(glob(F.col("filename"), pattern, case_sensitive))
    if kb_ids:
        found = found.where(discovery_scope(kb_ids))
    reasons = F.array(F.lit("wildcard_match"), *[F.lit(f"metadata:{f['field']}") for f in filters or ()])
    docs = list_documents(found).withColumn("_match_reasons", reasons)
    return docs.orderBy("doc_id").limit(limit) if limit else docs


def kb_document_counts(kbs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every knowledge base with the number of its documents (by the chunks' own kb_id)."""
    counts = chunks.groupBy("kb_id").agg(F.count_distinct("doc_id").alias("documents"))
    return kbs.join(counts, "kb_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def unknown_kbs(requested: DataFrame, kbs: DataFrame) -> DataFrame:
    return requested.join(kbs, "kb_id", "left_anti")
