"""Streaming forms: incremental ingestion from a folder; uploads, and job states, kept as stream state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.functions.text import content_hash, doc_identity
from quillstone.operators.jobs import MOVES

_MOVE = {(name, s): to for name, legal, to in MOVES for s in legal}


def new_files(spark: SparkSession, folder: str, kb_id: str, pattern: str = "*") -> DataFrame:
    """A stream of the files that appear in a folder: path, content, arrived, content_hash, doc_id, kb_id."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    digest = content_hash(F.col("content"))
    return files.select("path", "content", F.col("modificationTime").alias("arrived"), digest.alias("content_hash"), F.lit(kb_id).alias("kb_id"), doc_identity(F.lit(kb_id), digest).alias("doc_id"))


def distinct_files(files: DataFrame) -> DataFrame:
    """One row a knowledge base and content: the first path to arrive, and all of them as source_paths, in order. Contents are compared by digest before one of each is kept."""
    key = ["kb_id", "content_hash"]
    order = F.struct("arrived", "path")
    paths = files.groupBy(*key, "path").agg(F.min("arrived").alias("arrived")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("arrived", "path"))).alias("p"))
    first = files.groupBy(*key).agg(F.min_by(F.struct(*[c for c in files.columns if c not in key]), order).alias("f"))
    return first.join(paths, key).select(*key, "f.*", F.transform("p", lambda x: x["path"]).alias("source_paths")).select(*files.columns, "source_paths")


def ingest(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str):
    """Pass each micro-batch, one row a content with all its paths, to ``write`` (which upserts by key, so a batch that is repeated after a failure changes nothing)."""

    def batch(df: DataFrame, _: int) -> None:
        write(distinct_files(df))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


UPLOADED = "kb_id string, content_hash string, collection_name string, seq long, doc_id string, status string"


class _Uploads(StatefulProcessor):
    """The state of one content: whether it is known, its paths, and the last value of each tag. An upload reads the paths and tags that it names, not all that the content has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean")
        self.paths = handle.getMapState("paths", "path string", "there boolean")
        self.tags = handle.getMapState("tags", "tag string", "value string")

    def _add(self, paths, tags) -> bool:
        """Whether the upload changes the document."""
        changed = False
        for path in paths if paths is not None else ():
            if not self.paths.containsKey((path,)):
                self.paths.updateValue((path,), (True,))
                changed = True
        for tag, value in dict(tags if tags is not None else ()).items():
            if value is not None and not (self.tags.containsKey((tag,)) and self.tags.getValue((tag,))[0] == value):
                self.tags.updateValue((tag,), (value,))
                changed = True
        return changed

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002  named by the interface
        batch = pd.concat(list(rows)).sort_values("seq")
        known, status = self.seen.exists(), []
        for paths, tags in zip(batch["source_paths"], batch["user_metadata"], strict=True):
            changed = self._add(paths, tags)
            status.append(("metadata_updated" if changed else "already_exists") if known else "accepted")
            known = True
        self.seen.update((True,))
        yield pd.DataFrame({"kb_id": key[0], "content_hash": key[1], "collection_name": key[2], "seq": batch["seq"], "doc_id": batch["doc_id"], "status": status})

    def handleInitialState(self, key, initial, timerValues) -> None:  # noqa: N802, N803, ARG002
        self.seen.update((True,))
        for paths, tags in zip(initial["source_paths"], initial["user_metadata"], strict=True):
            self._add(paths, tags)

    def close(self) -> None:
        pass


def upload_status_stream(uploads: DataFrame, catalog: DataFrame) -> DataFrame:
    """dedup.upload_status of a stream of uploads (doc_id, kb_id, content_hash, collection_name, source_paths, user_metadata, seq): a row each with its status. The catalogue is the state at the
    start; from then on each content's state is kept by key, across batches. Uploads of a batch are taken in order of seq. Rows without a knowledge base or a content are passed over.

    State lives in RocksDB: spark.sql.streaming.stateStore.providerClass must name its provider when the query starts (STATE_STORE).
    """
    key = ["kb_id", "content_hash", "collection_name"]
    named = lambda df: df.withColumn("collection_name", F.coalesce("collection_name", F.lit("chunks"))).where("kb_id IS NOT NULL AND content_hash IS NOT NULL")
    known = named(catalog.where("status = 'completed'")).select(*key, "source_paths", "user_metadata")
    return named(uploads).groupBy(*key).transformWithStateInPandas(_Uploads(), UPLOADED, "append", "None", initialState=known.groupBy(*key))


#: The setting that upload_status_stream needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def job_state_stream(events: DataFrame) -> DataFrame:
    """events (job_id, seq, event, stage) as a stream: the job's row each time its events arrive. Events of a batch are taken in order of seq."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, stage, done = state.get if state.exists else ("PENDING", None, "")
        rows = pd.concat(list(frames)).sort_values("seq")
        for event, to in zip(rows["event"], rows["stage"], strict=True):
            if event == "stage" and status == "RUNNING":
                if stage and stage not in done.split(","):
                    done = f"{done},{stage}" if done else stage
                stage = to
            status = _MOVE.get((event, status), status)
        state.update((status, stage, done))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "current_stage": [stage], "stages_completed": [done]})

    return events.groupBy("job_id").applyInPandasWithState(
        fold, "job_id string, status string, current_stage string, stages_completed string", "status string, stage string, done string", "update", GroupStateTimeout.NoTimeout
    )
