"""The engine's tables, derived from a star schema's tables: in Spark, and as common table expressions for the SQL beside the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a chunk store: five chunks a document."""
    doc, label = F.floor(F.col("vec_id") / 5).cast("string"), F.col("label").cast("string")
    meta = F.create_map(F.lit("label"), label, F.lit("parity"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("doc_"), doc).alias("doc_id"), F.concat(F.lit("kb"), (F.col("label") % 4).cast("string")).alias("kb_id"), "embedding",
        F.concat(F.lit("topic "), label, F.lit(" part "), (F.col("vec_id") % 7).cast("string")).alias("text"), F.concat(F.lit("Title "), doc).alias("page_title"),
        F.concat(F.lit("/docs/"), doc, F.lit(".md")).alias("source_path"), F.concat(doc, F.lit(".md")).alias("filename"), meta.alias("user_metadata"),
        F.lit(None).cast("long").alias("content_size"), F.lit(None).cast("string").alias("ingestion_status"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("content_hash"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query."""
    label = F.col("label").cast("string")
    text = F.concat(F.lit("topic "), label, F.lit(" part "), (F.col("vec_id") % 7).cast("string"))
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), text.alias("question"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a knowledge base, a path and metadata; keys without a value are left out."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("lang", "lang"), ("source", "source"), ("quality", "quality"), ("toxic", "toxic"))])
    meta = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    number = F.substr("source", F.lit(4)).cast("int")
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("kb"), (number % 4).cast("string")).alias("kb_id"), "text", F.col("lang").alias("language"),
        F.concat_ws("/", F.lit(""), F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("source_path"), meta.alias("user_metadata"),
    )


def upload_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, incoming): even documents were uploaded before; all come in with their language as metadata, then every fifth once more. seq is the order of the uploads."""
    d = documents(spark, sf_dir).select("doc_id", "kb_id", content_hash(F.col("text")).alias("content_hash"), F.lit("chunks").alias("collection_name"), "source_path", "language", F.col("doc_id").cast("long").alias("seq"))
    old = d.where("seq % 2 = 0").groupBy("kb_id", "content_hash", "collection_name").agg(F.min_by("doc_id", "seq").alias("doc_id"), F.min("source_path").alias("p"), F.min("language").alias("l"))
    old = old.select("doc_id", "kb_id", "content_hash", "collection_name", F.array("p").alias("source_paths"), F.create_map(F.lit("language"), F.col("l")).alias("user_metadata"), F.lit("completed").alias("status"))
    both = d.unionByName(d.where("seq % 5 = 0").withColumn("seq", F.col("seq") + AGAIN))
    return old, both.select("doc_id", "kb_id", "content_hash", "collection_name", F.array("source_path").alias("source_paths"), F.create_map(F.lit("language"), F.col("language")).alias("user_metadata"), "seq")


#: What is added to the order of uploads that come once more.
AGAIN = 10**12

UPLOADS = f"""i AS (SELECT *, sha256(text) AS h, doc_id::BIGINT AS seq FROM docs),
old AS (SELECT kb_id, h, min(source_path) AS p, min(language) AS l, arg_min(doc_id, seq) AS old_id FROM i WHERE seq % 2 = 0 GROUP BY kb_id, h),
up AS (SELECT * FROM i UNION ALL SELECT * REPLACE (seq + {AGAIN} AS seq) FROM i WHERE seq % 5 = 0),
told AS (
  SELECT up.*, old_id, p, l, row_number() OVER (PARTITION BY up.kb_id, up.h ORDER BY seq) AS n, row_number() OVER (PARTITION BY up.kb_id, up.h, source_path ORDER BY seq) AS m,
         lag(language) OVER (PARTITION BY up.kb_id, up.h ORDER BY seq) AS b
  FROM up LEFT JOIN old ON up.kb_id = old.kb_id AND up.h = old.h),
uploads AS (
  SELECT *, CASE WHEN old_id IS NULL AND n = 1 THEN 'accepted' WHEN m = 1 AND source_path IS DISTINCT FROM p OR language IS DISTINCT FROM coalesce(b, l) THEN 'metadata_updated' ELSE 'already_exists' END AS status
  FROM told)"""


CHUNKS = """chunks AS (
  SELECT vec_id::VARCHAR AS chunk_id, 'doc_' || (vec_id // 5) AS doc_id, 'kb' || (label % 4) AS kb_id, embedding::DOUBLE[] AS e,
         'topic ' || label || ' part ' || (vec_id % 7) AS text, 'Title ' || (vec_id // 5) AS page_title, '/docs/' || (vec_id // 5) || '.md' AS source_path,
         (vec_id // 5) || '.md' AS filename, label, label::VARCHAR AS m_label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS m_parity
  FROM embeddings)"""

QUESTIONS = """questions AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, 'topic ' || label || ' part ' || (vec_id % 7) AS question FROM embeddings WHERE vec_id % 100 = 0)"""

SCORED = f"""{CHUNKS}, {QUESTIONS}, scored AS (
  SELECT query_id, question, chunks.*, list_cosine_similarity(q, e) AS s FROM questions, chunks)"""


def recall_sql(name: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM scored WHERE {where}) WHERE rank <= {k})"""


DOCUMENTS = """docs AS (
  SELECT d.doc_id::VARCHAR AS doc_id, 'kb' || (substr(source, 4)::INT % 4) AS kb_id, text, lang AS language, source, '/' || source || '/' || d.doc_id || '.txt' AS source_path,
         lang AS m_lang, source AS m_source, quality::VARCHAR AS m_quality, toxic::VARCHAR AS m_toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
