"""Jobs folded whole, by blocks and by blocks of blocks, against one event after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillstone.operators import jobs

EVENTS = "job_id string, seq long, event string, stage string"


def one_by_one(rows):
    moves = {(name, s): to for name, legal, to in jobs.MOVES for s in legal}
    out = {}
    for job, _, event, stage in sorted(rows, key=lambda r: (r[0], r[1])):
        status, current, done = out.setdefault(job, ["PENDING", None, []])
        if event == "stage" and status == "RUNNING":
            if current is not None and current not in done:
                done.append(current)
            out[job][1] = stage
        out[job][0] = moves.get((event, status), status)
    return {job: (s, c, d) for job, (s, c, d) in out.items()}


def folded(df, **more):
    return {r.job_id: (r.status, r.current_stage, r.stages_completed) for r in jobs.job_states(df, **more).collect()}


@pytest.fixture(scope="module")
def events():
    draw = random.Random(6)
    rows = []
    for seq in range(3000):
        job = "hot" if draw.random() < 0.4 else f"j{draw.randrange(60)}"
        event = draw.choices(["stage", "start", "complete", "fail", "cancel", "cancelled", "other"], [60, 6, 0.3, 0.3, 0.5, 0.5, 2])[0]
        rows.append((job, seq * 3, event, f"s{draw.randrange(9)}" if event == "stage" else None))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [10_000, 100, 7, 2])
def test_blocks(spark, events, monkeypatch, block):
    monkeypatch.setattr(jobs, "RANGE_ROWS", 900)
    assert folded(spark.createDataFrame(events, EVENTS), block=block) == one_by_one(events)


def test_a_million_events_of_one_job(spark):
    n = 1_000_000
    stage = F.concat(F.lit("s"), (F.floor(F.col("id") / 1000) % 300).cast("string"))
    df = spark.range(n).select(F.lit("one").alias("job_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "start").when(F.col("id") == n - 1, "complete").otherwise("stage").alias("event"), stage.alias("stage"))
    status, current, done = folded(df)["one"]
    assert (status, current) == ("COMPLETED", "s99") and done == [f"s{i}" for i in range(300)]


def test_no_events(spark):
    assert folded(spark.createDataFrame([], EVENTS)) == {}


def wait_for(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "it never came"
        time.sleep(0.05)


def in_thread(f):
    """Runs f beside the test; (thread, list that gets what it raised or returned)."""
    from pyspark import InheritableThread

    out = []

    def run():
        try:
            out.append(f())
        except Exception as e:  # handed to the test
            out.append(e)

    thread = InheritableThread(target=run)
    thread.start()
    return thread, out


def test_a_cancelled_run_stops_its_stage_and_publishes_nothing(spark, tmp_path):
    from quillstone import schemas
    from quillstone.runs import Cancelled, Runs
    from quillstone.sources import store

    table, runs = store.Table(spark, f"file://{tmp_path}/t", schemas.KNOWLEDGE_BASES, None), Runs(spark)
    slow = F.udf(lambda x: time.sleep(0.2) or str(x), "string")

    def work():
        runs.stage("parse")
        rows = spark.range(0, 4000, 1, 4).select(slow("id").alias("kb_id"), *[F.lit("x").alias(c) for c in schemas.KNOWLEDGE_BASES.fieldNames()[1:]])
        runs.stage("write")
        table.commit(rows)

    began = time.time()
    thread, out = in_thread(lambda: runs.run("one", work))
    active = spark.sparkContext.statusTracker().getActiveStageIds
    wait_for(lambda: runs.state("one") == "RUNNING" and len(active()) > 0)
    assert runs.cancel("one") and runs.cancel("one")
    thread.join(60)
    assert not thread.is_alive() and time.time() - began < 60, "the stage alone would take 200 seconds"
    assert isinstance(out[0], Cancelled) and runs.state("one") == "CANCELLED" and table.version() == 0
    wait_for(lambda: not active())
    assert folded(runs.events())["one"] == ("CANCELLED", "write", ["parse"])
    assert not runs.cancel("one") and not runs.cancel("unknown")
    with pytest.raises(FileExistsError):
        runs.run("one", work)


def test_a_cancellation_between_spark_jobs(spark, tmp_path):
    """Nothing runs when it comes: the next stage, or the commit, is where it is seen."""
    from quillstone import schemas
    from quillstone.runs import Cancelled, Runs
    from quillstone.sources import store

    table, runs = store.Table(spark, f"file://{tmp_path}/t", schemas.KNOWLEDGE_BASES, None), Runs(spark)
    row = spark.createDataFrame([("k", "n", "", "t", "t", "{}")], schemas.KNOWLEDGE_BASES)
    for job, last in (("stage", lambda: runs.stage("next")), ("end", lambda: None)):
        with pytest.raises(Cancelled):
            runs.run(job, lambda: (runs.cancel(job), last()))  # noqa: B023
        assert runs.state(job) == "CANCELLED"

    claim = store.Table.snapshot

    def cancelled_meanwhile(self):
        runs.cancel("commit")
        return claim(self)

    other = store.Table(spark, table.path, schemas.KNOWLEDGE_BASES, None)
    other.snapshot = cancelled_meanwhile.__get__(other)
    with pytest.raises(Cancelled):
        runs.run("commit", lambda: other.commit(row))
    assert table.version() == 0 and runs.state("commit") == "CANCELLED"


def test_other_runs_go_on(spark):
    from quillstone.runs import Cancelled, Runs

    runs, slow = Runs(spark), F.udf(lambda x: time.sleep(0.1) or x, "long")
    total = lambda n: spark.range(0, n, 1, 2).select(slow("id").alias("x")).agg(F.sum("x")).first()[0]
    a, b = in_thread(lambda: runs.run("a", lambda: total(100))), in_thread(lambda: runs.run("b", lambda: total(8000)))
    wait_for(lambda: runs.state("a") == runs.state("b") == "RUNNING" and len(spark.sparkContext.statusTracker().getActiveStageIds()) > 0)
    runs.cancel("b")
    a[0].join(90)
    b[0].join(90)
    assert a[1] == [sum(range(100))] and isinstance(b[1][0], Cancelled)


def test_failures(spark):
    from quillstone.runs import Cancelled, Runs

    runs = Runs(spark)
    with pytest.raises(ZeroDivisionError):
        runs.run("f", lambda: 1 / 0)
    assert runs.state("f") == "FAILED" and "division" in runs.error("f") and runs.state("never") is None
    runs.create("w")
    with pytest.raises(FileExistsError):
        runs.create("w")
    assert runs.cancel("w")
    with pytest.raises(Cancelled):
        runs.run("w", lambda: 1)
    assert runs.state("w") == "CANCELLED" and runs.run("ok", lambda: 5) == 5
