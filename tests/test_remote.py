"""Calls out of Spark: how many, how often, in what order, and what a failure costs."""

import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillstone.operators import ingest, remote

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import the tests


def noted(path, line):
    """A line in a file that callee and test share: tasks run in other processes."""
    with open(path, "a") as f:
        f.write(f"{line}\n")


def lines(path):
    return path.read_text().split("\n")[:-1] if path.exists() else []


def test_order_and_concurrency():
    now, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 * (5 - x % 5))
        with lock:
            now[0] -= 1
        return -x

    assert remote.in_order(call, [*range(20), 3, 3], 4) == [-x for x in [*range(20), 3, 3]] and most[0] == 4
    assert remote.in_order(call, [], 4) == []


def test_attempts(monkeypatch):
    slept, tries = [], []
    monkeypatch.setattr(time, "sleep", slept.append)

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise TimeoutError
        return "ok"

    assert remote.attempt(call, "a") == "ok" and slept == [2.0, 4.0] and tries == ["a"] * 3
    with pytest.raises(ValueError):
        remote.attempt(lambda _: int("x"), "a", again=(TimeoutError,))
    assert slept == [2.0, 4.0]
    with pytest.raises(TimeoutError):
        remote.attempt(lambda _: (_ for _ in ()).throw(TimeoutError()), "a", 2)
    assert slept == [2.0, 4.0, 2.0]


def test_one_call_for_each_content(spark, tmp_path):
    log = tmp_path / "calls"

    def call(text):
        noted(log, text)
        if text == "flaky" and lines(log).count("flaky") < 2 or text == "broken":
            raise RuntimeError(text)
        return None if text == "silent" else text.upper()

    texts = ["hot"] * 300 + ["flaky", "broken", "silent", "flaky", None, ""] + [f"t{i}" for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(6)
    out = remote.called(df, F.col("text"), call, "answer", pause=0.01)
    got = {r.i: r.answer for r in out.collect()}
    assert got == {i: "" if t in (None, "broken", "silent", "") else t.upper() for i, t in enumerate(texts)}
    assert out.count() == len(texts), "answers are there by now"
    counts = {t: lines(log).count(t) for t in set(lines(log))}
    assert counts == {"hot": 1, "flaky": 2, "broken": 3, "silent": 1, "": 1} | {f"t{i}": 1 for i in range(30)}
    assert remote.called(df.limit(0), F.col("text"), call, "answer").count() == 0


def test_pictures(spark, tmp_path):
    log = tmp_path / "calls"
    png, jpg = b"\x89PNG\r\n\x1a\n one", b"\xff\xd8\xff two"

    def call(content):
        noted(log, len(content))
        if content.endswith(b"two"):
            raise OSError("quota")
        return f"{len(content)} bytes"

    files = spark.createDataFrame([("a.png", png), ("copy.png", png), ("b.jpg", jpg), ("page.png", b"<html>"), ("c.txt", png), ("gone.png", None)], "path string, content binary")
    told = ingest.described(files, call, pause=0.01)
    assert {r.path: r.description for r in told.collect()} == {"a.png": "12 bytes", "copy.png": "12 bytes", "b.jpg": "", "page.png": "", "c.txt": "", "gone.png": ""}
    assert sorted(lines(log)) == ["12"] + ["7"] * 3
    image = "struct<src:string,alt:string,caption:string,surrounding_text:string>"
    docs = spark.createDataFrame([("d", "text", [("b.jpg", "x", "", ""), ("a.png", "", "", "near")]), ("e", "more", [])], f"canonical_doc_id string, content_text string, images array<{image}>")
    chunks = ingest.document_chunks(ingest.with_descriptions(docs, told), "now", describe=ingest.own_description)
    texts = [r.text for r in chunks.where("chunk_type = 'image'").collect()]
    assert len(texts) == 2 and sum("12 bytes" in t for t in texts) == 1 and chunks.where("doc_id = 'e'").count() == 1


def test_embedding_is_tried_again(spark, tmp_path):
    log = tmp_path / "calls"

    def call(texts):
        noted(log, ",".join(texts))
        if "slow" in texts and len(lines(log)) < 3:
            raise TimeoutError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["slow", "a", "a", "slow", "bb"])], "i int, text string").coalesce(1)
    got = [r.v for r in df.select(ingest.remote_embedder(call, 1, 10, pause=0.01)(F.col("text")).alias("v")).collect()]
    assert got == [[4.0], [1.0], [1.0], [4.0], [2.0]] and lines(log) == ["slow,a,bb"] * 3
