"""Job states folded from their events: a state is what transitions make of PENDING, and transitions compose. The stream form is in streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.shared import materialize

STATES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLING", "CANCELLED")
#: (event, states from which it is legal, the next state); anything else leaves the job as it is.
MOVES = (
    ("start", ("PENDING",), "RUNNING"),
    ("complete", ("RUNNING",), "COMPLETED"),
    ("fail", ("RUNNING", "CANCELLING"), "FAILED"),
    ("cancel", ("PENDING", "RUNNING", "CANCELLING"), "CANCELLING"),
    ("cancelled", ("CANCELLING",), "CANCELLED"),
)


def next_state(state: Column, event: Column) -> Column:
    out = F.when(F.lit(False), state)
    for name, legal, to in MOVES:
        out = out.when((event == name) & state.isin(*legal), F.lit(to))
    return out.otherwise(state)


#: Rows of one job that meet in one array, at most; rows of a range of orders, about, and the most ranges.
BLOCK, RANGE_ROWS, MOST_RANGES = 10_000, 1_000_000, 10_000

def _start(state: Column) -> Column:
    """A job in some state: no stage is known, none is completed."""
    unknown = F.lit(None).cast("string")
    return F.struct(state.alias("status"), unknown.alias("stage"), F.array().cast("array<string>").alias("done"), unknown.alias("first"))


def _event(acc: Column, e: Column) -> Column:
    """After one event: a stage event counts while RUNNING, and completes the stage before it. first: the first stage that came."""
    advance = (e["event"] == "stage") & (acc["status"] == "RUNNING")
    done = F.when(advance & acc["stage"].isNotNull(), F.array_union(acc["done"], F.array(acc["stage"]))).otherwise(acc["done"])
    first = F.when(advance & acc["first"].isNull(), e["stage"]).otherwise(acc["first"])
    return F.struct(next_state(acc["status"], e["event"]).alias("status"), F.when(advance, e["stage"]).otherwise(acc["stage"]).alias("stage"), done.alias("done"), first.alias("first"))


def _transition(acc: Column, b: Column) -> Column:
    """After a transition: what a run of events makes of the state that it finds. The stage before it is completed if the run brings one."""
    out = F.when(F.lit(False), b[STATES[0]])
    for s in STATES:
        out = out.when(acc["status"] == s, b[s])
    before = F.when(out["first"].isNotNull() & acc["stage"].isNotNull(), F.array(acc["stage"])).otherwise(F.array().cast("array<string>"))
    done = F.array_union(F.array_union(acc["done"], before), out["done"])
    return F.struct(out["status"].alias("status"), F.coalesce(out["stage"], acc["stage"]).alias("stage"), done.alias("done"), F.coalesce(acc["first"], out["first"]).alias("first"))


def _blocked(rows: DataFrame, order: str, block: int) -> DataFrame:
    """rows with ``next``: numbers that rise with the order, each for at most ``block`` rows of a job. Rows are cut to ranges of the order first, so that a job's rows need not be sorted in one task."""
    ranges = max(1, min(MOST_RANGES, -(-rows.count() // RANGE_ROWS)))
    rows = rows.repartitionByRange(ranges, order).withColumn("range", F.spark_partition_id().cast("long"))
    rank = F.row_number().over(Window.partitionBy("job_id", "range").orderBy(order)) - 1
    return rows.withColumn("next", F.shiftleft("range", 32) + F.floor(rank / block)).drop("range")


def _folded(rows: DataFrame, order: str, columns: list[str], step, starts: dict[str, str], *key: str) -> DataFrame:
    """The rows of each key folded in order from each start."""
    each = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
    return each.select(*key, *[F.aggregate("rows", _start(F.lit(s)), step).alias(name) for name, s in starts.items()])


def job_states(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """events (job_id, seq, event, stage): (job_id, status, current_stage, stages_completed). A stage event counts while RUNNING; the stage before it is completed, once.

    Where no job has more than ``block`` events, each job's are folded in turn. Otherwise events are folded by blocks of a job's own rank, from every state that a job may have before a block: these
    transitions compose, so blocks of them are folded again until a job has no more than ``block``, and what is left is applied to a pending job. So a job's events never meet in one array,
    however many there are; its distinct completed stages do.
    """
    rows, order, columns, step, every = events.select("job_id", "seq", "event", "stage"), "seq", ["event", "stage"], _event, {s: s for s in STATES}
    while (rows.groupBy("job_id").count().agg(F.max("count")).first()[0] or 0) > block:
        rows = materialize(_folded(_blocked(rows, order, block), order, columns, step, every, "job_id", "next").withColumnRenamed("next", "block"), "transitions")
        order, columns, step = "block", list(STATES), _transition
    out = _folded(rows, order, columns, step, {"s": "PENDING"}, "job_id")
    return out.select("job_id", F.col("s.status").alias("status"), F.col("s.stage").alias("current_stage"), F.col("s.done").alias("stages_completed"))


def phase_times(marks: DataFrame) -> DataFrame:
    """marks (request_id, phase, ts): milliseconds since the request's first mark, to two places, as a map; and the total."""
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("start") + 5) / 10) / 100
    first = marks.groupBy("request_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("start"))
    timed = marks.join(first, "request_id").select("request_id", "phase", at.alias("ms"))
    timed = timed.groupBy("request_id", "phase").agg(F.max("ms").alias("ms"))
    return timed.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "ms")))).alias("phases"), F.max("ms").alias("total"))
