"""Running work of jobs: started, marked by stage, and cancelled, with the Spark jobs that it has in flight.

A run's Spark jobs carry its tag, so that a cancellation stops the stages that are running, wherever the driver's thread stands; between Spark jobs it is seen at the next checkpoint, and a
table's commit is one. What happens is kept as events, from which operators.jobs folds the states.
"""

from __future__ import annotations

import contextvars
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators.jobs import MOVES

EVENTS = "job_id string, seq long, event string, stage string"
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
_MOVES = {(name, state): to for name, legal, to in MOVES for state in legal}


class Cancelled(RuntimeError):
    """The run was cancelled."""


_current: contextvars.ContextVar[tuple[Runs, str] | None] = contextvars.ContextVar("run", default=None)


def checkpoint() -> None:
    """Raises Cancelled if the run that this thread works for has been cancelled; does nothing outside of runs."""
    here = _current.get()
    if here and here[0].cancelling(here[1]):
        raise Cancelled(here[1])


class Runs:
    """The runs of one session. Any thread may start and cancel them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._lock = spark, threading.RLock()
        self._events: list[tuple[str, int, str, str | None]] = []
        self._states: dict[str, str] = {}
        self._errors: dict[str, str] = {}

    def _note(self, job_id: str, event: str, stage: str | None = None) -> str:
        """The state after the event; one that is not legal there changes nothing."""
        with self._lock:
            self._events.append((job_id, len(self._events), event, stage))
            state = self._states.get(job_id, "PENDING")
            self._states[job_id] = _MOVES.get((event, state), state)
            return self._states[job_id]

    @staticmethod
    def tag(job_id: str) -> str:
        return f"run-{job_id}".replace(",", "_")

    def events(self) -> DataFrame:
        """All events so far, for operators.jobs.job_states."""
        with self._lock:
            return self.spark.createDataFrame(list(self._events), EVENTS)

    def state(self, job_id: str) -> str | None:
        with self._lock:
            return self._states.get(job_id)

    def error(self, job_id: str) -> str | None:
        with self._lock:
            return self._errors.get(job_id)

    def cancelling(self, job_id: str) -> bool:
        return self.state(job_id) in ("CANCELLING", "CANCELLED")

    def create(self, job_id: str) -> None:
        """A run that waits; FileExistsError if there is one of that id."""
        with self._lock:
            if job_id in self._states:
                raise FileExistsError(job_id)
            self._states[job_id] = "PENDING"

    def stage(self, name: str) -> None:
        """The next stage of the run that this thread works for, which is a checkpoint."""
        checkpoint()
        here = _current.get()
        if here:
            self._note(here[1], "stage", name)

    def cancel(self, job_id: str) -> bool:
        """Whether the run will end: false for one that is unknown or over. Its Spark jobs are stopped."""
        with self._lock:
            if self._states.get(job_id, TERMINAL[0]) in TERMINAL:
                return False
            self._note(job_id, "cancel")
        self.spark.sparkContext.cancelJobsWithTag(self.tag(job_id))
        return True

    def run[T](self, job_id: str, work: Callable[[], T]) -> T:
        """``work`` in this thread as the run ``job_id``, which is created if it is not there; what it returns. Cancelled if the run is cancelled before it is over, whatever the work raises then; other errors
        end the run as FAILED and go on to the caller. A run that is over is not run again (FileExistsError)."""
        with self._lock:
            if self._states.get(job_id, "PENDING") not in ("PENDING", "CANCELLING"):
                raise FileExistsError(job_id)
            if self._note(job_id, "start") != "RUNNING":  # cancelled before it began
                self._note(job_id, "cancelled")
                raise Cancelled(job_id)
        sc, token = self.spark.sparkContext, _current.set((self, job_id))
        sc.addJobTag(self.tag(job_id))
        try:
            out = work()
            if self._note(job_id, "complete") != "COMPLETED":
                raise Cancelled(job_id)
            return out
        except BaseException as error:
            with self._lock:
                cancelled = self.cancelling(job_id)
                self._note(job_id, "cancelled" if cancelled else "fail")
                if not cancelled:
                    self._errors[job_id] = str(error)
            if cancelled and not isinstance(error, Cancelled):
                raise Cancelled(job_id) from error
            raise
        finally:
            sc.removeJobTag(self.tag(job_id))
            _current.reset(token)
