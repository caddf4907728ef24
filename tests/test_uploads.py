"""Uploads of one content: in a batch, in a stream and one by one they have the same outcome."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import dedup
from quillstone.streaming import ingest

CATALOG = "doc_id string, kb_id string, content_hash string, collection_name string, source_paths array<string>, user_metadata map<string,string>, status string"
UPLOAD = "seq long, doc_id string, kb_id string, content_hash string, collection_name string, source_paths array<string>, user_metadata map<string,string>"


def one_by_one(uploads, catalog):
    """(status by seq, final record by key): each upload sees all before it."""
    records = {(r[1], r[2], r[3] or "chunks"): [r[0], list(r[4] or ()), dict(r[5] or {})] for r in catalog if r[6] == "completed"}
    status = {}
    for seq, doc, kb, digest, collection, paths, tags in sorted(uploads):
        key, changed = (kb, digest, collection or "chunks"), False
        record = records.get(key)
        if record is None:
            record = records[key] = [doc, [], {}]
            status[seq] = "accepted"
        for p in paths or ():
            if p not in record[1]:
                record[1].append(p)
                changed = True
        for k, v in (tags or {}).items():
            if v is not None and record[2].get(k) != v:
                record[2][k] = v
                changed = True
        status.setdefault(seq, "metadata_updated" if changed else "already_exists")
    return status, records


@pytest.fixture(scope="module")
def made():
    draw = random.Random(4)
    catalog = [(f"old{i}", f"kb{i % 2}", f"h{i}", "chunks", [f"p{i}"], {"a": "1"} if i % 3 else None, "completed" if i % 4 else "pending") for i in range(8)]
    uploads = []
    for seq in range(400):
        i = 0 if draw.random() < 0.4 else draw.randrange(12)  # one content has many uploads
        paths = [f"p{draw.randrange(6)}" for _ in range(draw.randrange(3))]
        tags = draw.choice([None, {}, {"a": draw.choice("12")}, {"a": "1", "b": draw.choice("xyz")}, {"c": None}])
        uploads.append((seq * 7, f"d{seq}", f"kb{i % 2}", f"h{i}", draw.choice(["chunks", None]), paths, tags))
    draw.shuffle(uploads)
    return uploads, catalog


@pytest.mark.parametrize("rows", [100_000, 20])
def test_a_batch(spark, made, monkeypatch, rows):
    """Also where the orders are cut to many blocks."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", rows)
    uploads, catalog = made
    status, records = one_by_one(uploads, catalog)
    incoming, old = spark.createDataFrame(uploads, UPLOAD).withColumn("at", F.lit(1)), spark.createDataFrame(catalog, CATALOG)
    got = dedup.upload_status(incoming, old, "seq")
    assert got.columns == [*incoming.columns, "status"] and {r.seq: r.status for r in got.collect()} == status
    named = {(u[2], u[3], u[4] or "chunks") for u in uploads}
    merged = {(r.kb_id, r.content_hash, r.collection_name): [r.doc_id, r.source_paths, r.user_metadata] for r in dedup.merged_records(incoming, old, "seq").collect()}
    assert merged == {k: v for k, v in records.items() if k in named}


def test_twins(spark):
    rows = [(1, "a", "k", "h", "c", ["x"], None), (2, "b", "k", "h", "c", ["x"], None), (3, "c", "k", "h", "c", ["y"], None), (4, "d", "k", "h", "c", ["x"], {"t": "1"}), (5, "e", "k", "h", "c", ["y"], {"t": "1"}), (6, "f", "l", "h", "c", ["y"], None)]
    rows += [(7, "g", None, "h", "c", ["x"], None), (8, "h", "k", None, "c", ["x"], None), (9, "i", "k", None, "c", ["x"], None)]
    out = dedup.upload_status(spark.createDataFrame(rows, UPLOAD), spark.createDataFrame([], CATALOG), "seq")
    assert [r.status for r in out.orderBy("seq").collect()] == ["accepted", "already_exists", "metadata_updated", "metadata_updated", "already_exists", "accepted", "accepted", "accepted", "accepted"]
    none = spark.createDataFrame([], UPLOAD)
    assert dedup.upload_status(none, spark.createDataFrame([], CATALOG), "seq").count() == 0 and dedup.merged_records(none, spark.createDataFrame([], CATALOG), "seq").count() == 0


def test_a_stream(spark, made, tmp_path):
    """Three batches of one stream, then a second run from its checkpoint: the same as one by one."""
    uploads, catalog = made
    status, _ = one_by_one(uploads, catalog)
    uploads = sorted(uploads)
    spark.conf.set(*ingest.STATE_STORE)
    folder, old = str(tmp_path / "in"), spark.createDataFrame(catalog, CATALOG)

    def add(some):
        spark.createDataFrame(some, UPLOAD).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).parquet(folder)
        q = ingest.upload_status_stream(stream, old).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        add(uploads[:150])
        run()
        add(uploads[150:300])
        run()
        add(uploads[300:])
        run()
        assert {r.seq: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == status
    finally:
        spark.conf.unset(ingest.STATE_STORE[0])


def test_files_with_one_content_keep_all_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.txt", "same"), ("b.txt", "same"), ("c.txt", "other")):
        (tmp_path / "in" / name).write_text(body)
    seen = []
    ingest.ingest(ingest.new_files(spark, str(tmp_path / "in"), "kb"), lambda df: seen.extend(df.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted([p.rsplit("/", 1)[1] for p in r.source_paths] for r in seen) == [["a.txt", "b.txt"], ["c.txt"]]
    assert all(r.path == r.source_paths[0] and bytes(r.content) in (b"same", b"other") for r in seen)
