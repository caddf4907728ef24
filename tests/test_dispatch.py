"""Replaced parts change what the plans give, also in the tasks."""

import sys

import pytest
from pyspark.sql import functions as F

from quillstone import capabilities, engine, registry
from quillstone.functions.text import hashed_embedding
from quillstone.operators import retrieve
from quillstone.schemas import CHUNKS
from quillstone.sources import files


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.createDataFrame([(f"d{i}", f"topic {i % 3} about thing{i} and more", f"T{i}") for i in range(12)], "canonical_doc_id string, content_text string, page_title string")
    return engine.indexed(docs, "now").cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "thing4 topic 1"), (2, "thing7")], "query_id long, question string")


def best(hits):
    return {r.query_id: r.doc_id for r in hits.where("rank = 1").collect()}


def test_the_defaults(spark, chunks, questions):
    assert chunks.columns == CHUNKS.fieldNames() and chunks.count() == 12
    assert best(engine.found(questions, chunks)) == {1: "d4", 2: "d7"}
    prompts = {r.query_id: r.prompt for r in engine.prompted(questions, chunks, 3).collect()}
    assert set(prompts) == {1, 2} and "thing4" in prompts[1] and "Source: T7" in prompts[2]
    rows = spark.createDataFrame([("Name", "body")], "title string, content string")
    assert engine.rendered(rows).first().content == "# Name\n\nbody\n"
    with pytest.raises(KeyError):
        engine.rendered(rows, "none")


def test_replaced_embedder_and_chunker(spark, chunks, questions):
    docs = spark.createDataFrame([("d", "one\n\ntwo\n\nthree")], "canonical_doc_id string, content_text string")
    lines = lambda rows, canonical, text, most, overlap: rows.select(
        *[c for c in rows.columns if c != text], F.posexplode(F.split(text, "\n\n")).alias("chunk_index", "text")
    ).withColumns({"chunk_id": F.concat_ws("-", canonical, F.col("chunk_index").cast("string")), "chunk_type": F.lit("line")})
    ones = lambda text: F.array(F.lit(1.0), F.length(text).cast("double")).cast("array<float>")
    with registry.replaced("chunker", lines), registry.replaced("embedder", ones):
        rows = engine.indexed(docs, "now").collect()
    assert sorted((r.chunk_id, r.text, r.chunk_type, r.embedding) for r in rows) == [("d-0", "one", "line", [1.0, 3.0]), ("d-1", "two", "line", [1.0, 3.0]), ("d-2", "three", "line", [1.0, 5.0])]
    backwards = lambda text: hashed_embedding(F.lit("topic 2 about thing8 and more"))
    with registry.replaced("embedder", backwards):
        assert set(best(engine.found(questions, chunks, 5, reranking=False, hybrid_selection=False)).values()) == {"d8"}
    assert {r.chunk_type for r in engine.indexed(docs, "now").collect()} == {"text"}


def test_replaced_reranker_selector_and_retriever(questions, chunks):
    asked = questions.withColumn("query_vector", hashed_embedding(F.col("question")))
    only = lambda doc: lambda hits: hits.where(F.col("doc_id") == doc).withColumn("_score", F.lit(9.0))
    with registry.replaced("reranker", only("d2")):
        assert best(retrieve.retrieve(asked, chunks)) == {1: "d2", 2: "d2"}
        with registry.replaced("hybrid_selector", lambda reranked, vector: vector.where("rank <= 2").withColumn("source", F.lit(0)).withColumn("pos", F.col("rank"))):
            assert retrieve.retrieve(asked, chunks).count() == 4 and best(retrieve.retrieve(asked, chunks)) == {1: "d4", 2: "d7"}
    with registry.replaced("retriever", lambda queries, chunks, top_k: queries.select("query_id", F.lit(1).alias("rank"), F.lit("own").alias("doc_id"))):
        assert best(engine.found(questions, chunks)) == {1: "own", 2: "own"}
    assert best(retrieve.retrieve(asked, chunks)) == {1: "d4", 2: "d7"}


def test_replaced_parsers_renderers_and_builders(spark, tmp_path, chunks, questions):
    for name, body in (("a.html", "<body>x</body>"), ("b.pdf", "%PDF scanned"), ("c.txt", "plain")):
        (tmp_path / name).write_text(body)
    texts = lambda df: {r.path.rsplit("/", 1)[1]: r.content_text for r in df.collect()}
    assert texts(files.parse_files(spark, str(tmp_path))) == {"a.html": "x", "b.pdf": "", "c.txt": "plain"}
    html = lambda page: F.struct(F.lit("T").alias("title"), F.upper(page).alias("content"), F.lit("xx").alias("language"), F.array().cast("array<struct<src:string,alt:string,caption:string,surrounding_text:string>>").alias("images"))
    pages = lambda path, content: F.struct(F.lit("").alias("title"), F.array(F.struct(F.lit(1).alias("page"), F.decode(content, "UTF-8").alias("text"))).alias("pages"))
    layer = lambda found: found.withColumn("content", F.encode(F.regexp_replace(F.decode("content", "UTF-8"), "scanned", "read"), "UTF-8"))
    with registry.replaced("html_parser", html), registry.replaced("pdf_extractor", pages), registry.replaced("ocr_preprocessor", layer):
        assert texts(files.parse_files(spark, str(tmp_path))) == {"a.html": "<BODY>X</BODY>", "b.pdf": "%PDF read", "c.txt": "plain"}
    with registry.replaced("parser_router", lambda hint: lambda parsed: parsed.select(F.lit(hint).alias("hint")).distinct()):
        assert engine.elements(spark, str(tmp_path), "mine").first().hint == "mine"
    assert engine.elements(spark, str(tmp_path)).where("element_type = 'text'").count() == 2
    with registry.replaced("renderer:shout", lambda title, content: F.upper(content)):
        assert engine.rendered(spark.createDataFrame([("t", "body")], "title string, content string"), "shout").first().content == "BODY"
    with registry.replaced("prompt_builder", lambda sources: sources.groupBy("query_id").agg(F.count("*").alias("prompt"))):
        assert {r.query_id for r in engine.prompted(questions, chunks, 3).where("prompt > 0").collect()} == {1, 2}


def test_an_extension_runs_in_the_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "quill_ext.py").write_text(
        "from pyspark.sql import functions as F\n\n\ndef shouted(text):\n    return text.upper() + '!'\n\n\ndef register(registry):\n    registry.register('renderer:loud', lambda title, content: F.udf(shouted, 'string')(content), 300)\n"
    )
    (tmp_path / "quill_broken.py").write_text("1 / 0\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert capabilities.load_extensions("quill_ext, quill_broken, no_such_module_here", spark) == ["quill_ext"]
    assert engine.rendered(spark.createDataFrame([("t", "body")], "title string, content string"), "loud").first().content == "BODY!"
    sys.modules.pop("quill_ext")
