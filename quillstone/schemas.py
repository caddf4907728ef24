"""Schemas of the chunk store and its companions. Timestamps are ISO-8601 strings, as callers pass them."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("chunk_id", "text")]
    + [T.StructField("embedding", T.ArrayType(T.FloatType(), False))]
    + [T.StructField(n, T.StringType()) for n in ("doc_id", "source_path")]
    + [T.StructField("source_paths", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("page_title", "section_path")]
    + [T.StructField("chunk_index", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("chunk_type", "language", "image_path", "ingestion_timestamp", "kb_id", "filename")]
    + [T.StructField("content_size", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("ingestion_status", "created_at")]
    + [T.StructField("user_metadata", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("content_hash", "content_hash_algorithm", "metadata_updated_at")]
)

CATALOG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "kb_id", "content_hash", "collection_name", "status")]
    + [T.StructField("source_paths", T.ArrayType(T.StringType())), T.StructField("user_metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("chunk_count", T.LongType())]
)

KNOWLEDGE_BASES = T.StructType([T.StructField(n, T.StringType()) for n in ("kb_id", "name", "description", "created_at", "updated_at", "settings_json")])

DEFAULT_KB = "default"
#: The payload fields that a filter names directly; all others are looked up in user_metadata.
CORE_FIELDS = (
    "doc_id", "chunk_id", "source_path", "page_title", "section_path", "chunk_index", "chunk_type", "language", "kb_id", "filename", "content_size",
    "ingestion_status", "created_at", "content_hash",
)
