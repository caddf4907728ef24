"""The corpus pipeline: documents through five stages, each written and read again.

Quality, near-duplicates, benchmark decontamination, personal data, mixing. A stage works on all that the one before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, minhash, mixing, pii, quality
from quillstone.llm.storage import fresh, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine does not reject: score of THRESHOLD or more.

    Null and empty texts have a score like any other. Repeated rows share their fate. Without labels all scores are 0.5 and nothing
    stays; no rows give none. Columns of docs may have any name.
    """
    score = fresh(docs, "score")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_column(docs, machine, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that with the least doc_id; rows without a doc_id come last.

    Null and empty texts are one class. Rows that repeat a doc_id are classed by their own texts: each stays if its text is not near to another that stays; of equal rows one stays.
    No rows give none. Columns of docs may have any name.
    """
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark.

    Null and empty texts hold none, repeated rows share their fate, a benchmark without rows drops nothing. Columns of docs may have any name.
    """
    leaks = fresh(docs, "leaks")
    return decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), leaks).where(F.col(leaks) == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind in angle brackets, n_chars that of the new text.

    Null texts stay null, empty ones empty; repeated rows are changed alike. Other columns stay as they are, whatever their names.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with size, target, copies and taken after their columns (an underscore before a name that docs has already).

    Null and empty texts have size 0; a null source is a source of its own. Rows that share a doc_id, or have none, are drawn one by one. No rows give none.
    """
    return mixing.mix_rows(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL expresses none of the first four stages; tests/llm/test_pipeline.py holds run() against a version that works by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
