"""Phases of a retrieval: rows and times from its own action."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from quillstone import engine
from quillstone.functions.text import hashed_embedding
from quillstone.operators import jobs
from quillstone.operators.metrics import Phases
from quillstone.operators.retrieve import retrieve


def test_phases_of_a_retrieval(spark):
    docs = spark.createDataFrame([(f"d{i}", f"topic {i % 3} about thing{i}") for i in range(40)], "canonical_doc_id string, content_text string")
    chunks = engine.indexed(docs, "now").cache()
    chunks.count()
    asked = spark.createDataFrame([(1, "thing4 topic 1"), (2, "thing7")], "query_id long, question string").withColumn("query_vector", hashed_embedding(F.col("question")))
    began, phases = datetime.now(UTC), Phases()
    out = retrieve(asked, chunks, 5, phases=phases).collect()
    seen = phases.rows()
    assert [(p, n) for p, n, _, _ in seen] == [("recalled", 80), ("payload", 80), ("chosen", len(out))]
    assert all(began <= first <= last <= datetime.now(UTC) for _, _, first, last in seen)
    assert seen[0][3] <= seen[2][3], "the last row is chosen after the last one is recalled"
    times = jobs.phase_times(phases.marks(spark, "r")).first()
    assert set(times.phases) == {"began", "recalled", "payload", "chosen"} and times.total == max(times.phases.values()) > 0


def test_a_phase_without_rows(spark):
    phases = Phases()
    assert phases.mark(spark.range(3).where("id > 5"), "none").count() == 0
    assert phases.rows() == [("none", 0, None, None)]
