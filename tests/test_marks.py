"""Marks of answers that come in tokens, against those of whole answers."""

import random
import time

import pytest

from quillstone.operators.answers import MarkReader, Reading, mark_sources
from quillstone.streaming import answers

NAMES = ["Guide.pdf", "notes.md", "Board A"]
TITLES = [["The Guide"], None, ["Specs", "A. b"]]
TEXTS = [
    "It is so [guide]. And then. It goes on [notes.md] here\n [unknown. x] said [the guide] and [] or [x] end",
    "[guide][notes] a.  [Board A] b .[specs]", "no marks at all.", "", "open [guide and no end", "a [b [notes] c] [A. b]. ]x[", "... [guide]   [guide", "[]x] [guide]",
]
TOKENS = "answer_id string, seq long, token string, last boolean, names array<string>, titles array<array<string>>"


def read(parts):
    """The parts through one reader after the other, each going on from the reading that the one before left."""
    reading, clean, compat, refs = Reading(), "", "", []
    for p in parts:
        reader = MarkReader(NAMES, TITLES, Reading(**vars(reading)))
        a, b, c = reader.feed(p)
        clean, compat, refs, reading = clean + a, compat + b, refs + c, reader.reading
    reader = MarkReader(NAMES, TITLES, reading)
    rest = reader.finish()
    return {"clean": clean + rest, "compat": compat + rest, "refs": refs}


@pytest.mark.parametrize("text", TEXTS)
def test_cut_at_any_character(text):
    whole = mark_sources(text, NAMES, True, TITLES)
    assert read([text]) == whole and read(list(text)) == whole
    for cut in range(len(text)):
        assert read([text[:cut], text[cut:]]) == whole
    draw = random.Random(len(text))
    for _ in range(20):
        cuts = sorted(draw.choices(range(len(text) + 1), k=5))
        assert read([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]) == whole


@pytest.fixture
def store(spark):
    spark.conf.set(*answers.STATE_STORE)
    yield
    spark.conf.unset(answers.STATE_STORE[0])


def run_until(marked, checkpoint, answers_over, seconds=60):
    """(batch, row) of a stream until so many answers are over. Timers keep a stream going, so it is stopped."""
    rows = []
    q = marked.writeStream.foreachBatch(lambda df, n: rows.extend((n, r) for r in df.collect())).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + seconds
        while sum(r.over for _, r in rows) < answers_over and time.time() < end and q.isActive:
            time.sleep(0.1)
    finally:
        q.stop()
    return rows


def test_a_stream_of_tokens(spark, tmp_path, store):
    """Answers cut to small tokens, dealt over batches out of order and with repetitions."""
    draw = random.Random(3)
    batches = [[], [], []]
    for i, text in enumerate(TEXTS):
        parts = [text[a : a + 3] for a in range(0, len(text), 3)] or [""]
        for seq, part in enumerate(parts):
            row = (f"a{i}", seq, part, seq + 1 == len(parts), NAMES, TITLES)
            batches[draw.randrange(3)].append(row)
            if draw.random() < 0.2:
                batches[draw.randrange(3)].append(row)
    for b in batches:
        spark.createDataFrame(draw.sample(b, len(b)), TOKENS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = run_until(answers.mark_stream(stream, 10**8), str(tmp_path / "check"), len(TEXTS))
    for i, text in enumerate(TEXTS):
        own = [r for _, r in sorted(rows, key=lambda x: x[0]) if r.answer_id == f"a{i}"]
        got = {"clean": "".join(r.clean for r in own), "compat": "".join(r.compat for r in own), "refs": [x.asDict() for r in own for x in r.refs]}
        assert got == mark_sources(text, NAMES, True, TITLES) and [r.over for r in own] == [False] * (len(own) - 1) + [True]


def test_an_answer_that_stops(spark, tmp_path, store):
    """Nothing says that it is over, and a token is missing: after a while what is held comes out."""
    rows = [("a", 0, "So it is [gui", False, NAMES, TITLES), ("b", 0, "One [notes", False, NAMES, TITLES), ("b", 2, " two", False, NAMES, TITLES)]
    spark.createDataFrame(rows, TOKENS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TOKENS).parquet(str(tmp_path / "in"))
    out = [r for _, r in run_until(answers.mark_stream(stream, idle=1000), str(tmp_path / "check"), 2)]
    assert {i: "".join(r.clean for r in out if r.answer_id == i) for i in "ab"} == {"a": "So it is [gui", "b": "One [notes two"}
