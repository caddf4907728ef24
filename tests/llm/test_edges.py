"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and every stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import decontaminate, embed_dedup, html_template, minhash, mixing, pii, quality, suffix_tree, url_filter, warc

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
CLASH = ("size", "key", "block", "salt", "n", "score", "rank", "host", "path", "label2", "band", "rep", "component", "links", "kind", "rid", "copies")
DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 44),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 44),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, LONG, "de", "a", len(LONG)),
    (5, "one", "fr", "a", 3),
    (None, "mail bob@example.org now", "en", "b", 24),
    (7, "call +1 (555) 123-4567 or 10.0.0.1", "en", None, 34),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = [(1, "http://a.org/x", "<html><body><p>Hi &amp; bye</p></body></html>"), (1, "http://a.org/x", "<html><body><p>Hi &amp; bye</p></body></html>"), (2, None, None), (3, "nothing", ""), (4, "https://B.Example.ORG/es/?q", "<p>" + LONG)]
PAGE_SCHEMA = "page_id long, url string, html string"
VECTORS = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.99, 0.05], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0], 0)]
VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(9).alias(c) for c in CLASH if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS, DOC_SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger.new(pii.SYMBOLS, 9)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is None, x))


WANTED = sorted((r[0] for r in DOCS), key=lambda x: (x is None, x))


def test_url_filter(spark):
    out = {r.page_id: r for r in url_filter.filter_urls(frame(spark, PAGES, PAGE_SCHEMA), url_filter.ALLOW, url_filter.BLOCK, ["a.org"]).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("a.org", "/x", "org/", "allow")
    assert (out[2].host, out[2].path, out[2].rule, out[2].verdict) == ("", "", None, "allow")
    assert (out[4].host, out[4].rule, out[4].verdict) == ("b.example.org", "example.org/es/", "block")
    assert url_filter.filter_urls(spark.createDataFrame([], PAGE_SCHEMA), [], [], []).count() == 0
    assert url_filter.filter_urls(frame(spark, PAGES, PAGE_SCHEMA), [], [], ["a.org"]).where("verdict = 'block'").count() == 2


def test_colliding_keys_are_told_apart():
    index = url_filter.DigestArray.build([("a.org/", 1), ("b.org/", 2)])
    same = url_filter.DigestArray(np.array([5, 5], np.uint64), index.kinds, index.offsets, index.strings)
    texts = [index.strings[a:b].tobytes() for a, b in zip(index.offsets[:-1], index.offsets[1:], strict=True)]
    assert same.probe([*texts, b"c.org/"], np.array([5, 5, 5], np.uint64)).tolist() == [*index.kinds, 0]


def test_html(spark):
    out = {r.page_id: r for r in html_template.extract(frame(spark, PAGES, PAGE_SCHEMA)).collect()}
    assert out[1].text == "Hi & bye" and out[2].text == "" and out[3].text == "" and out[4].text == LONG.strip()
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert html_template.extract(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


def test_html_without_broadcast(spark, monkeypatch):
    pages = frame(spark, PAGES, PAGE_SCHEMA)
    one = sorted(html_template.extract(pages).collect(), key=str)
    monkeypatch.setattr(html_template, "BROADCAST_TOKENS", -1)
    assert sorted(html_template.extract(pages).collect(), key=str) == one


def test_suffix_tree(spark, docs):
    out = suffix_tree.score_texts(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert ids(out) == WANTED
    assert rows[2].n_tokens == 1 and rows[3].n_tokens == 1 and rows[4].n_tokens == 4000 * 6 + 1
    assert all(np.isfinite([r.score, r.base_score]).all() and r.score < 0 for r in rows.values())
    assert suffix_tree.score_texts(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_pii(spark, docs, tagger):
    out = pii.detect(docs, tagger)
    rows = {r.doc_id: r for r in out.collect()}
    assert ids(out) == WANTED
    assert rows[None].spans == "email:5:20" and rows[7].n_phone == 1 and rows[7].n_ip == 1 and rows[2].spans == "" == rows[4].spans
    assert pii.detect(spark.createDataFrame([], DOC_SCHEMA), tagger).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs, tagger).collect()}
    assert clean[None] == "mail <EMAIL> now" and clean[7] == "call <PHONE> or <IP>" and clean[2] is None


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} == {(1, 1)}
    assert decontaminate.find_leaks(docs, items.where("false")).count() == 0
    again = decontaminate.find_leaks(docs, items.union(items.where("item_id = 1")).union(items.where("item_id = 1").selectExpr("7L AS item_id", "text"))).collect()
    assert sorted((r.doc_id, r.item_id) for r in again) == [(1, 1)] * 4 + [(1, 7)] * 2  # two rows of the document, two of the item
    assert decontaminate.find_leaks(spark.createDataFrame([], DOC_SCHEMA), items).count() == 0


def test_mixing(spark, docs):
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(DOCS)
    assert all(r.taken == r["size"] * r.copies and 0 <= r.copies <= 3 for r in rows)
    assert {r.doc_id: r["size"] for r in rows}[2] == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_minhash(spark, docs):
    out = minhash.near_duplicates(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert ids(out) == WANTED
    assert rows[1].class_id == 1 and rows[1].n_equal == 2 and rows[None].kept and rows[None].class_id is None
    assert rows[2].class_id == 2 and rows[3].class_id == 2  # null counts as empty
    assert minhash.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_quality(spark, docs, labels):
    out = quality.classify(docs, labels)
    assert ids(out) == WANTED
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.collect())
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(spark.createDataFrame([], DOC_SCHEMA), labels).count() == 0


def test_warc(spark, monkeypatch):
    pages = frame(spark, [*PAGES, (9, "http://c.org/a\nb", "x" * 200), (8, None, "x" * 200)], PAGE_SCHEMA)
    out = warc.round_trip(pages).collect()
    rows = {r.page_id: r for r in out}
    assert len(out) == 7
    assert (rows[9].record_type, rows[9].refers_to, rows[9].payload_bytes) == ("revisit", 8, 200) and rows[8].record_type == "response" and rows[8].refers_to is None
    assert rows[9].url == "http://c.org/a\nb" and rows[8].url is None
    assert warc.round_trip(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0
    monkeypatch.setattr(warc, "BROADCAST_COPIES", -1)
    more = [*PAGES, (9, "http://c.org/a", "x" * 200), (None, "http://n.org/", "x" * 200), (8, None, "x" * 200), (None, None, "y" * 300), (None, None, "y" * 300), (4, "u", "x" * 99), (5, "u", "x" * 99)]
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark, more, PAGE_SCHEMA)).collect() if r.payload_bytes in (99, 200, 300)]
    assert sorted(got, key=str) == sorted([(9, "revisit", 8), (None, "revisit", 8), (8, "response", None), (None, "response", None), (None, "response", None), (4, "response", None), (5, "response", None)], key=str)


def test_embeddings(spark):
    out = embed_dedup.near_duplicates(frame(spark, VECTORS, VECTOR_SCHEMA)).collect()
    rows = {r.vec_id: r for r in out}
    assert len(out) == len(VECTORS)
    assert rows[3].n_links == 3 and rows[3].component_id == 1 and rows[1].n_links == 3
    assert all(rows[i].n_links == 0 and rows[i].component_id == i and rows[i].kept for i in (4, 5, 6, 7, 8, 9))
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0
    none = embed_dedup.near_duplicates(spark.createDataFrame([*VECTORS[:2], (None, [1.0, 0.0], 0)], VECTOR_SCHEMA)).where("vec_id IS NULL").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in none] == [(0, None, False)]


def test_pipeline_stages(spark, docs, labels, tagger, tmp_path, monkeypatch):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some other words that are nowhere in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(pii, "train", lambda _: tagger)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, str(tmp_path))
            assert set(docs.columns) <= set(out.columns) if name == "mixing" else out.columns == docs.columns, name
            assert out.count() <= rows.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert ids(kept) == [1, 2, 4, 5, 7, None]
