"""WARC archives as a chunked record table.

An archive is a table of rows (archive, record_id, seq, chunk_no, data, ...): the bytes of its chunks, in order of seq and
chunk_no, are a WARC/1.1 file. A payload of any size passes as chunks of bounded size; each carries the SHA-256 of the
payload so far, so a reader verifies as it goes and never holds a record. The table is Parquet in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.graph import HOT_KEYS, HOT_ROWS
from quillstone.llm.storage import materialize, new_path

CHUNK = 1 << 16
LEAST_REVISIT = 100
#: Digests of several pages that are broadcast, about 100 bytes each.
BROADCAST_COPIES = 200_000
DATE = "2024-01-01T00:00:00Z"
TABLE = "archive int, record_id string, seq long, chunk_no int, last boolean, data binary, digest string"
_TABLE = pa.schema([("archive", pa.int32()), ("record_id", pa.string()), ("seq", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("digest", pa.string())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
_BATCH_BYTES = 8 << 20


def _record_uuid(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{nth}')}>"


def _header(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, record_id: str) -> bytes:
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else size}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    archive, seq, rows, held = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        ids, urls, digests, sizes, refers = (b[c].to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "refers_to"))
        for i in range(b.num_rows):
            record_id = _record_uuid(ids[i], f"{digests[i]}:{archive}", seq)
            body = b["html"][i].as_buffer() if refers[i] is None and sizes[i] else None
            view, at, sha, n = memoryview(body) if body is not None else memoryview(b""), 0, hashlib.sha256(), 0
            lead = _header(ids[i], urls[i], digests[i], sizes[i], refers[i], record_id)
            while True:
                piece = view[at : at + chunk]
                sha.update(piece)
                at += len(piece)
                last = at >= len(view)
                rows.append((archive, record_id, seq, n, last, b"".join((lead, piece, b"\r\n\r\n" if last else b"")), sha.hexdigest()))
                held += len(lead) + len(piece)
                n, lead = n + 1, b""
                if held >= _BATCH_BYTES:
                    yield _batch(rows, _TABLE)
                    rows, held = [], 0
                if last:
                    break
            seq += 1
    if rows:
        yield _batch(rows, _TABLE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to: the smallest page_id of an equal payload of ``least`` bytes or more, null for that page itself.

    What pages share is found without their html, among payloads of ``least`` bytes or more. It is then broadcast if it is small; else only
    such pages are joined to it, and digests of very many pages by broadcast, so that none of them lands in one task.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest")
    )
    long = F.col("payload_bytes") >= least
    copies = p.where(long).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(copies, "copies")
    shared = copies.count()
    if shared <= BROADCAST_COPIES:
        p = p.join(F.broadcast(copies.drop("n")), (p["payload_digest"] == copies["payload_digest"]) & long, "left").drop(copies["payload_digest"])
    else:
        found = p.where(long)
        limit = max(HOT_ROWS, -(-found.count() // HOT_KEYS))
        hot, cold = F.broadcast(copies.where(F.col("n") > limit).drop("n")), copies.where(F.col("n") <= limit).drop("n")
        rest = found.join(hot.select("payload_digest"), "payload_digest", "left_anti").join(cold, "payload_digest", "left")
        p = p.where(~long).withColumn("first", F.lit(None).cast("long")).unionByName(found.join(hot, "payload_digest")).unionByName(rest)
    revisits = F.col("first").isNotNull() & F.coalesce(F.col("first") < F.col("page_id"), F.lit(True))
    return p.withColumn("refers_to", F.when(revisits, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, chunk: int = CHUNK) -> None:
    """Write a WARC record per page to the chunk table at ``path``; a lost task is redone from its pages alone."""
    plan_records(pages, least).mapInArrow(lambda batches: _write(batches, chunk), TABLE).write.option("compression", "zstd").parquet(path)


class _Reader:
    """Folds the chunks of a record, in order: the header up to the blank line, then the payload into a running digest."""

    def __init__(self, record_id: str) -> None:
        self.record_id, self.head, self.fields, self.sha, self.seen = record_id, bytearray(), None, hashlib.sha256(), 0

    def feed(self, data: bytes, digest: str) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = bytes(self.head[:at]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"record {self.record_id} does not start with WARC/")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.length = int(self.fields["Content-Length"])
            data, self.head = bytes(self.head[at + 4 :]), bytearray()
        piece = data[: max(0, self.length - self.seen)]
        self.sha.update(piece)
        self.seen += len(piece)
        if self.sha.hexdigest() != digest:
            raise ValueError(f"record {self.record_id} is damaged at byte {self.seen}")

    def row(self) -> tuple:
        f = self.fields
        if f is None or self.seen != self.length:
            raise ValueError(f"record {self.record_id} is cut off")
        kind, said, size = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
        if kind == "response" and (said != self.sha.hexdigest() or size != self.seen):
            raise ValueError(f"record {self.record_id} has another payload than its digest")
        number = lambda k: int(f[k]) if k in f else None
        url = f.get("WARC-Target-URI")
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None
        return number("X-Page"), size, said, kind, number("X-Refers-To-Page"), url


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, rows = None, []
    for b in batches:
        for record_id, data, digest in zip(b["record_id"].to_pylist(), b["data"], b["digest"].to_pylist(), strict=True):
            if reader is None or reader.record_id != record_id:
                if reader is not None:
                    rows.append(reader.row())
                reader = _Reader(record_id)
            reader.feed(data.as_py(), digest)
        if len(rows) >= 1000:
            yield _batch(rows, _RECORDS)
            rows = []
    if reader is not None:
        rows.append(reader.row())
    if rows:
        yield _batch(rows, _RECORDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url. Raises on a damaged or cut record."""
    chunks = spark.read.schema(TABLE).parquet(path)
    whole = F.col("last") & (F.col("chunk_no") == 0)
    parts = chunks.where(~whole).select("record_id", "chunk_no", "data", "digest").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    read = lambda x: x.select("record_id", "data", "digest").mapInArrow(_read, RECORDS)
    return read(chunks.where(whole)).unionByName(read(parts))  # only records of several chunks are brought together


def export_archive(spark: SparkSession, path: str, archive: int) -> Iterator[bytes]:
    """The bytes of one archive as a stream, a chunk at a time: a WARC/1.1 file."""
    rows = spark.read.schema(TABLE).parquet(path).where(F.col("archive") == archive).orderBy("seq", "chunk_no").select("data")
    return (bytes(r.data) for r in rows.toLocalIterator())


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back.

    Null html is an empty payload; null urls leave the record without WARC-Target-URI. Rows that repeat the smallest page_id of
    a payload are all responses; a null page_id is never chosen as the first, and revisits it like any other. No pages: an archive without records.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


ORACLE = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN coalesce(first < page_id, first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN coalesce(first < page_id, first IS NOT NULL) THEN first END AS refers_to, url
FROM f
"""
