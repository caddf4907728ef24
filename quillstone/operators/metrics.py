"""Rows and times of a plan's phases, observed while its one action runs."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The clock of the machine that a row is on; not a constant of the query, so that each row has its own.
_NOW = "reflect('java.lang.System', 'currentTimeMillis')"


class Phases:
    """Marks of one plan. What they counted is there once an action of the plan has ended."""

    def __init__(self) -> None:
        self._began = datetime.now(UTC)
        self._seen: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, phase: str) -> DataFrame:
        """df, whose rows are counted, and the first and the last of them timed, as they pass. A phase that the plan runs twice counts once."""
        seen = Observation(f"{phase}-{len(self._seen)}")
        self._seen.append((phase, seen))
        at = F.expr(_NOW).cast("long")
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))

    def rows(self) -> list[tuple[str, int, datetime | None, datetime | None]]:
        """(phase, rows, time of the first, time of the last), in order of the marks; no times without rows. Waits for the action."""
        time = lambda ms: None if ms is None else datetime.fromtimestamp(ms / 1000, UTC)
        return [(phase, got["rows"], time(got["first"]), time(got["last"])) for phase, seen in self._seen if (got := seen.get)]

    def marks(self, spark: SparkSession, request_id: str) -> DataFrame:
        """(request_id, phase, ts) for operators.jobs.phase_times: when the request began, and when the last row of each phase passed."""
        found = [(request_id, phase, last) for phase, _, _, last in self.rows() if last is not None]
        return spark.createDataFrame([(request_id, "began", self._began), *found], "request_id string, phase string, ts timestamp")
