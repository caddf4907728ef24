"""The chunk store: keyed writes as pure functions of DataFrames, and a Parquet table that commits their results.

A commit writes new files beside the old ones, then a manifest under a name of its own, and gives it its version's name by one step that fails if that name is taken. So a
job that dies leaves the table as it was, readers keep the version that they began with, and of several writers one is first: the others apply their change to
the version that they find then, if it touches no partition that they read or write, and are refused otherwise.
"""

from __future__ import annotations

import contextlib
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone import runs
from quillstone.functions.filters import metadata_equals
from quillstone.schemas import CATALOG, CHUNKS, DEFAULT_KB

COUNT_MOST = 10_000
_COPY = "partition_of_row"


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those with the same key; of equal keys in ``new`` the last by ``order`` stays."""
    if order:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
        new = new.withColumn("__n", last).where("__n = 1").drop("__n", order)
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(existing: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold (null: stays)."""
    return existing.where(~F.coalesce(condition, F.lit(False)))


def delete_document(existing: DataFrame, doc_id: str) -> DataFrame:
    return delete(existing, F.col("doc_id") == doc_id)


def delete_metadata(existing: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Nothing is deleted by an empty filter."""
    c = metadata_equals(wanted)
    return existing if c is None else delete(existing, c)


def patch(existing: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The listed columns set where the condition holds; the rest stays."""
    hit = F.coalesce(condition, F.lit(False))
    return existing.withColumns({c: F.when(hit, v).otherwise(F.col(c)) if c in existing.columns else F.when(hit, v) for c, v in values.items()})


class Conflict(RuntimeError):
    """Another writer changed what a commit is based on."""


@dataclass(frozen=True)
class Snapshot:
    """A version of a table, and the folder of each of its partitions."""

    version: int
    folders: dict[str, str]

    def changed(self, other: Snapshot) -> set[str]:
        return {p for p in self.folders.keys() | other.folders.keys() if self.folders.get(p) != other.folders.get(p)}


def retried[T](work: Callable[[], T], attempts: int = 5, pause: float = 0.2) -> T:
    """``work`` done anew on each Conflict, after pause * 2**n seconds."""
    for n in range(attempts):
        try:
            return work()
        except Conflict:
            if n + 1 == attempts:
                raise
            time.sleep(pause * 2**n)
    raise ValueError("no attempts")


class Table:
    """A Parquet table of partitions: path/data holds their files, path/current one manifest a version, which lists the folders in force by partition.

    A commit writes the partitions that it touches, and a manifest that keeps the folders of all others; a job that dies before its manifest has its version's name leaves the table
    as it was. Files that no manifest lists are never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema=CHUNKS, partition: str | None = "kb_id") -> None:
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []

    def version(self) -> int:
        return max((int(n) for n in self._names(f"{self.path}/current") if n.isdigit()), default=0)

    def snapshot(self) -> Snapshot:
        """The version in force."""
        fs, path = self._fs()
        version = self.version()
        if not version:
            return Snapshot(0, {})
        stream = fs.open(path(f"{self.path}/current/{version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(version, dict(line.split("\t") for line in text.splitlines()))

    def folders(self) -> dict[str, str]:
        """Of the version in force: partition -> folder."""
        return self.snapshot().folders

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, partitions: list[str] | None = None, at: Snapshot | None = None) -> DataFrame:
        """The table, or some of its partitions (the files of all others are not looked at), in the version in force or ``at`` one."""
        found = (at or self.snapshot()).folders
        return self._load([f for k, f in sorted(found.items()) if partitions is None or k in partitions])

    def commit(self, rows: DataFrame, touched: list[str] | None = None, base: Snapshot | None = None, clash: Callable[[DataFrame], bool] | None = None) -> int:
        """``rows`` are all rows of the partitions ``touched`` (None: of the whole table), derived from version ``base``; the number of the version that has them.

        Conflict if another writer changed one of these since, or if ``clash`` holds for the rows of the partitions that did change.
        """
        base = base or self.snapshot()
        _, written = self._write(rows.select(*self.schema.fieldNames(), self._copy()))
        return self._publish(written, touched, base, clash)

    def _copy(self) -> Column:
        value = F.coalesce(F.col(self.partition), F.lit("")) if self.partition else F.lit("")
        return F.concat(F.lit("p"), value).alias(_COPY)

    def _write(self, rows: DataFrame) -> tuple[str, dict[str, str]]:
        """(new folder, the folder in it of each partition)"""
        folder = f"{self.path}/data/v-{uuid.uuid4().hex}"
        rows.write.partitionBy(_COPY).parquet(folder)
        return folder, {unquote(n.split("=", 1)[1])[1:]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_COPY}=")}

    def cluster(self, key: str = "chunk_id", rows_per_file: int = 100_000) -> int:
        """Rewrites the table so that each file holds a range of keys of its partition, and lists the ranges beside the files for scroll; the new version. Conflict if another writer was quicker."""
        base = self.snapshot()
        rows = self.read(at=base).select(*self.schema.fieldNames(), self._copy())
        files = max(1, -(-rows.count() // rows_per_file))
        folder, written = self._write(rows.repartitionByRange(files, _COPY, key).sortWithinPartitions(_COPY, key))
        if written:
            listed = self.spark.read.schema(self.schema).parquet(*written.values()).groupBy(F.col("_metadata.file_path").alias("file"))
            listed.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{folder}/_ranges")
        return self._publish(written, None, base)

    def _ranges(self, at: Snapshot, partitions: list[str] | None) -> list[tuple[str, str | None, str | None, int]]:
        """(file or folder, first key, last key, rows) of the files in force; the keys of folders that are not clustered are not known."""
        folders = [f for k, f in sorted(at.folders.items()) if partitions is None or k in partitions]
        listed = {}
        for top in sorted({f.rsplit("/", 1)[0] for f in folders}):
            if "_ranges" in self._names(top):
                listed |= {r.file: (r.first, r.last, r.n) for r in self.spark.read.parquet(f"{top}/_ranges").collect()}  # a row a file
        own = lambda file: unquote(file).rsplit("/data/", 1)[-1].rsplit("/", 1)[0]
        by_folder: dict[str, list] = {}
        for file, (first, last, n) in listed.items():
            by_folder.setdefault(own(file), []).append((file, first, last, n))
        name = lambda folder: folder.rsplit("/data/", 1)[-1]
        return [x for f in folders for x in by_folder.get(name(f), [(f, None, None, 0)])]

    def scroll(self, after: str | None = None, limit: int = 1000, key: str = "chunk_id", partitions: list[str] | None = None, at: Snapshot | None = None) -> DataFrame:
        """The ``limit`` rows whose keys follow ``after``, in order of the key; None begins. Of a clustered table only the files that can hold them are read. The last row's key is the next cursor; give ``at`` for
        pages of one version."""
        files = [r for r in self._ranges(at or self.snapshot(), partitions) if r[2] is None or after is None or r[2] > after]
        held, end = 0, None
        for _, first, last, n in sorted((r for r in files if r[1] is not None), key=lambda r: r[1]):
            held += n if after is None or first > after else 0
            end = last if end is None else max(end, last)
            if held >= limit:  # so many keys lie up to here
                break
        else:
            end = None
        wanted = [unquote(f) if first is not None else f for f, first, _, _ in files if first is None or end is None or first <= end]
        rows = self._load(wanted)
        return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)

    def pages(self, limit: int = 1000, key: str = "chunk_id", partitions: list[str] | None = None) -> Iterator[list]:
        """All rows of the version in force, ``limit`` at a time; keys are unique."""
        at, after = self.snapshot(), None
        while page := self.scroll(after, limit, key, partitions, at).collect():
            yield page
            after = page[-1][key]

    def _publish(self, written: dict[str, str], touched: list[str] | None, base: Snapshot, clash: Callable[[DataFrame], bool] | None = None) -> int:
        """A version in which ``written`` takes the place of the partitions ``touched``."""
        while True:
            runs.checkpoint()  # a cancelled run publishes nothing
            last = self.snapshot()
            if changed := base.changed(last):
                if touched is None or changed.intersection(touched) or changed & written.keys():
                    raise Conflict(f"{self.path}: version {last.version} changed what version {base.version} was read for")
                if clash and clash(self._load([last.folders[p] for p in sorted(changed & last.folders.keys())])):
                    raise Conflict(f"{self.path}: version {last.version} has rows that clash with the new ones")
            kept = {} if touched is None else {k: f for k, f in last.folders.items() if k not in touched}
            if self._claim(last.version + 1, kept | written):
                return last.version + 1
            base = last  # its own changes have been looked at

    def _claim(self, version: int, folders: dict[str, str]) -> bool:
        """Whether this writer is the one that made the version. The manifest is whole before it has the version's name."""
        fs, path = self._fs()
        mine, name = f"{self.path}/current/_{uuid.uuid4().hex}", f"{self.path}/current/{version}"
        out = fs.create(path(mine), False)
        try:
            out.write(bytearray("".join(f"{k}\t{f}\n" for k, f in sorted(folders.items())).encode()))
        finally:
            out.close()
        return self._rename(mine, name)

    def _rename(self, mine: str, name: str) -> bool:
        """``mine`` under a new name, in one step that fails if the name is taken: a hard link in a local folder, elsewhere the file system's rename without overwriting."""
        fs, path = self._fs()
        if fs.getUri().getScheme() == "file":
            local = [path(p).toUri().getPath() for p in (mine, name)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            finally:
                fs.delete(path(mine), False)
            return True
        return self._rename_without_links(mine, name)

    def _rename_without_links(self, mine: str, name: str) -> bool:
        fs, path = self._fs()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(path(mine), path(name), gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Exception:
            fs.delete(path(mine), False)
            if fs.exists(path(name)):
                return False
            raise
        return True

    def _partitions(self, rows: DataFrame) -> list[str]:
        value = F.coalesce(F.col(self.partition), F.lit("")) if self.partition else F.lit("")
        return [r[0] for r in rows.select(value).distinct().collect()]  # names of partitions

    def upsert(self, new: DataFrame, key: str = "chunk_id", order: str | None = None, base: Snapshot | None = None) -> None:
        """Rewrites the partitions that get rows or lose some to a key of another partition. Writers of other keys in other partitions don't stand in its way; Conflict else."""
        base = base or self.snapshot()
        keys = new.select(key).distinct()
        touched = sorted({*self._partitions(new), *self._partitions(self.read(at=base).join(keys, key, "left_semi"))})
        self.commit(upsert(self.read(touched, base), new, key, order), touched, base, lambda rows: not rows.join(keys, key, "left_semi").isEmpty())

    def delete(self, condition: Column) -> None:
        base = self.snapshot()
        touched = self._partitions(self.read(at=base).where(F.coalesce(condition, F.lit(False))))
        self.commit(delete(self.read(touched, base), condition), touched, base)

    def patch(self, condition: Column, values: dict[str, Column]) -> int:
        """1 if any row was patched, else 0. The partition column is not patched."""
        base = self.snapshot()
        touched = self._partitions(self.read(at=base).where(F.coalesce(condition, F.lit(False))))
        if touched:
            self.commit(patch(self.read(touched, base), condition, values), touched, base)
        return int(bool(touched))

    def drop_partition(self, name: str, base: Snapshot | None = None) -> None:
        """Nothing is rewritten."""
        self._publish({}, [name], base or self.snapshot())

    def clear(self) -> None:
        """An empty version after all others, whatever these have changed."""
        retried(lambda: self._publish({}, None, self.snapshot()))


def chunk_table(spark: SparkSession, path: str, dimension: int) -> Table:
    """The chunk store at a path; made if it is absent, else its vectors' length must be ``dimension``. Similarity is by cosine throughout."""
    table = Table(spark, path)
    if not table.version():
        table.clear()
    other = table.read().where((F.size("embedding") != dimension)).limit(1).select(F.size("embedding")).collect()
    if other:
        raise ValueError(f"{path} holds vectors of {other[0][0]} components, not {dimension}")
    return table


class DocumentCatalog:
    """The records of uploaded documents, one a knowledge base, content and collection."""

    KEY = ("kb_id", "content_hash", "collection_name")

    def __init__(self, table: Table) -> None:
        self.table = table

    def create(self, rows: DataFrame) -> None:
        """Adds records; FileExistsError if one has the key of another, also of one that another writer adds meanwhile."""
        key = [F.coalesce(c, F.lit("")).alias(c) for c in self.KEY]

        def add() -> None:
            base = self.table.snapshot()
            every = self.table.read(at=base).select(*key).union(rows.select(*key))
            taken = every.groupBy(*self.KEY).count().where("count > 1").limit(1).collect()
            if taken:
                raise FileExistsError(str(taken[0][:3]))
            self.table.upsert(rows, "doc_id", base=base)

        retried(add)

    def update(self, doc_id: str, **values: Column) -> None:
        """Sets columns of a document's record; LookupError if there is none."""
        if not retried(lambda: self.table.patch(F.col("doc_id") == doc_id, values)):
            raise LookupError(doc_id)

    def finalize(self, doc_id: str, chunks: int) -> None:
        self.update(doc_id, status=F.lit("completed"), chunk_count=F.lit(chunks).cast("long"))

    def delete_kb(self, kb_id: str) -> int:
        """The number of records that are gone."""

        def drop() -> int:
            base = self.table.snapshot()
            gone = self.table.read([kb_id], base).count()
            self.table.drop_partition(kb_id, base)
            return gone

        return retried(drop)


_RECORD = "doc_id string, kb_id string, content_hash string, collection_name string, ingestion_status string, source_paths array<string>, user_metadata map<string,string>, chunk_count long"


def catalog_file(spark: SparkSession, path: str) -> DataFrame:
    """The records of a catalogue kept as a JSON file ({"records": [...]}), in the catalogue's columns, to be created in a DocumentCatalog. A file that is missing or can't be parsed has none; fields that a record does not
    have are null, its collection "chunks"."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CATALOG)
    found = spark.read.schema(f"records array<struct<{_RECORD.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = found.select(F.explode("records").alias("r")).select("r.*").where("doc_id IS NOT NULL")
    return rows.withColumn("collection_name", F.coalesce("collection_name", F.lit("chunks"))).withColumnRenamed("ingestion_status", "status").select(*CATALOG.fieldNames())


def remove_document(chunks: Table, catalog: DocumentCatalog, doc_id: str) -> bool:
    """Whether the document was there. Its record goes with its chunks, so that it can be uploaded again; without it nothing is done."""
    here = not chunks.read().where(F.col("doc_id") == doc_id).limit(1).isEmpty()
    if here:
        retried(lambda: chunks.delete(F.col("doc_id") == doc_id))
    retried(lambda: catalog.table.delete(F.col("doc_id") == doc_id))
    return here


class KnowledgeBases:
    """Typed errors stand for those of the service: LookupError (unknown), FileExistsError (taken), ValueError (not allowed)."""

    def __init__(self, table: Table, chunks: Table, catalog: Table) -> None:
        self.table, self.chunks, self.catalog = table, chunks, catalog

    def list(self) -> DataFrame:
        return self.table.read().orderBy("kb_id")

    def _has(self, kb_id: str, at: Snapshot | None = None) -> bool:
        return not self.table.read(at=at).where(F.col("kb_id") == kb_id).isEmpty()

    @staticmethod
    def _check(kb_id: str, name: str, description: str, settings_json: str) -> None:
        import json
        import re

        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", kb_id) or not name.strip() or len(name.strip()) > 128 or len(description) > 1024:
            raise ValueError(f"not a valid knowledge base: {kb_id!r}, {name!r}")
        if not isinstance(json.loads(settings_json), dict):
            raise ValueError("settings must be an object")

    def create(self, kb_id: str, name: str, now: str, description: str = "", settings_json: str = "{}") -> None:
        self._check(kb_id, name, description, settings_json)
        row = self.table.spark.createDataFrame([(kb_id, name.strip(), description, now, now, settings_json)], self.table.schema)

        def add() -> None:
            base = self.table.snapshot()
            if self._has(kb_id, base):
                raise FileExistsError(kb_id)
            self.table.upsert(row, "kb_id", base=base)

        retried(add)

    def update(self, kb_id: str, now: str, name: str | None = None, description: str | None = None, settings_json: str | None = None) -> None:
        """Sets what is given, and updated_at."""
        self._check(kb_id, "x" if name is None else name, description or "", settings_json or "{}")
        given = {"name": name and name.strip(), "description": description, "settings_json": settings_json, "updated_at": now}
        if not retried(lambda: self.table.patch(F.col("kb_id") == kb_id, {k: F.lit(v) for k, v in given.items() if v is not None})):
            raise LookupError(kb_id)

    def seed(self, now: str) -> None:
        """The default knowledge base is there afterwards, also where several writers seed at once: the first one's stays."""
        if not self._has(DEFAULT_KB):
            with contextlib.suppress(FileExistsError):
                self.create(DEFAULT_KB, "Default", now)

    def delete(self, kb_id: str) -> int:
        """Chunks, then catalogue, then the registry; returns the number of chunks seen (counted up to COUNT_MOST)."""
        if kb_id == DEFAULT_KB:
            raise ValueError("the default knowledge base can't be deleted")
        if not self._has(kb_id):
            raise LookupError(kb_id)
        seen = self.chunks.read([kb_id]).limit(COUNT_MOST).count()
        for t in (self.chunks, self.catalog, self.table):
            retried(lambda t=t: t.delete(F.col("kb_id") == kb_id) if t.partition != "kb_id" else t.drop_partition(kb_id))
        return seen
