"""Calls to what is outside of Spark (models, services): few at once in a task, repeated after failures, one for each distinct content, and in order."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.shared import materialize

#: Calls in flight in one task, attempts, and the seconds before the second one, which double with each.
WORKERS, ATTEMPTS, PAUSE = 20, 3, 2.0
_DIGEST = "digest_of_content"


def attempt(call: Callable[[Any], Any], value: Any, attempts: int = ATTEMPTS, pause: float = PAUSE, again: tuple[type[BaseException], ...] = (Exception,)) -> Any:
    """call(value), anew after a failure of the kinds ``again``, ``pause`` * 2**n seconds later; the last failure, or one of another kind, is raised."""
    for n in range(attempts):
        try:
            return call(value)
        except again:
            if n + 1 == attempts:
                raise
            time.sleep(pause * 2**n)
    raise ValueError("no attempts")


def in_order(call: Callable[[Any], Any], values: list, workers: int = WORKERS) -> list:
    """call of each value, ``workers`` at once; results in the order of the values, each distinct one called once."""
    distinct = list(dict.fromkeys(values))
    with ThreadPoolExecutor(max(1, min(workers, len(distinct)))) as pool:
        known = dict(zip(distinct, pool.map(call, distinct), strict=True))
    return [known[v] for v in values]


def called(
    df: DataFrame, content: Column, call: Callable[[Any], str], name: str, workers: int = WORKERS, attempts: int = ATTEMPTS, pause: float = PAUSE, failed: str = "", again: tuple[type[BaseException], ...] = (Exception,),
) -> DataFrame:
    """df and ``name``, the text that ``call`` (a function of one Python value, run in the tasks) gives for ``content``, a text or bytes. A call that fails for good gives ``failed``, and so does null.

    There is one call for each distinct content of the table, whatever the number of rows that share it: the answers are written once and joined to the rows. Only an attempt that fails, or a task whose
    executor is lost, calls again.
    """
    asked = df.withColumn(_DIGEST, F.sha2(content.cast("binary"), 256))
    distinct = asked.where(F.col(_DIGEST).isNotNull()).select(_DIGEST, content.alias("content")).dropDuplicates([_DIGEST])

    def one(value: Any) -> str:
        try:
            out = attempt(call, value, attempts, pause, again)
        except Exception:  # whatever the callee fails with costs this content's answer alone
            return failed
        return failed if out is None else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(in_order(one, b.column(1).to_pylist(), workers), pa.string())], [_DIGEST, name])

    answers = materialize(distinct.mapInArrow(run, f"{_DIGEST} string, `{name}` string"), "answers")
    return asked.join(answers, _DIGEST, "left").select(*df.columns, F.coalesce(F.col(name), F.lit(failed)).alias(name))
