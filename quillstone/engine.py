"""The engine as callers use it: files to elements, documents to stored chunks, questions to prompts, rows to artifacts. Each part is the one that is registered when the plan is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import capabilities, registry  # noqa: F401  the first registers the defaults
from quillstone.operators import context, ingest
from quillstone.sources import files


def elements(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """The files below a path as canonical elements, by the parser that the registered router gives for the hint."""
    return registry.get("parser_router")(hint)(files.parse_files(spark, path))


def indexed(docs: DataFrame, now: str) -> DataFrame:
    """docs (canonical_doc_id, content_text, ...) as rows of the chunk store, cut by the registered chunker, with the vectors of the registered embedder."""
    return ingest.embedded(ingest.document_chunks(docs, now))


def found(questions: DataFrame, chunks: DataFrame, top_k: int = 20, **search_options) -> DataFrame:
    """questions (query_id, question) to the hits of the registered retriever (query_id, rank, chunk_id, doc_id, text, _score)."""
    asked = questions.withColumn("query_vector", registry.get("embedder")(F.col("question")))
    return registry.get("retriever")(asked, chunks, top_k, **search_options)


def prompted(questions: DataFrame, chunks: DataFrame, top_k: int = 20, **search_options) -> DataFrame:
    """(query_id, prompt) of the questions that have hits, by the registered prompt builder, from their hits within the budget of a context."""
    hits = found(questions, chunks, top_k, **search_options).select("query_id", "rank", "chunk_id", "text").join(chunks.select("chunk_id", "page_title", "source_path", "user_metadata"), "chunk_id")
    kept = context.budget(hits).withColumnRenamed("text", "kept")
    named = hits.withColumn("page_title", F.coalesce("page_title", F.lit("Unknown Page"))).join(kept, ["query_id", "page_title", "rank"]).withColumn("text", F.col("kept")).drop("kept")
    return registry.get("prompt_builder")(context.group_sources(named))


def rendered(rows: DataFrame, kind: str = "markdown") -> DataFrame:
    """rows (title, content, ...) with content as the registered renderer of a kind writes it; LookupError without one."""
    return rows.withColumn("content", registry.get(f"renderer:{kind}")(F.col("title"), F.col("content")))
