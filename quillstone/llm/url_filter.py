"""URL filtering by a sorted digest array.

Rules and blocked hosts are compiled to one file: 64-bit xxhash keys in sorted order, then the entries' full strings.
The file goes to every executor by SparkContext.addFile; each task memory-maps it, hashes each url's candidate entries
(host suffixes, and those with each rule length of the path), probes the keys by a vectorised binary search and
confirms the stored string, so that a collision of keys never decides. The index is the size of the lists, not of the
pages; its pages in memory are shared by all workers of a machine.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_ALLOW, RULE_BLOCK, HOST_BLOCK = 1, 2, 4
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_FRAME = np.dtype("<i8")


@dataclass
class DigestArray:
    """Sorted keys, and for each the kind and the full string of its entry."""

    keys: np.ndarray
    kinds: np.ndarray
    offsets: np.ndarray
    strings: np.ndarray

    @staticmethod
    def build(entries: Iterable[tuple[str, int]]) -> DigestArray:
        """Kinds of an entry that is given twice are joined. Arrays throughout: a million entries take some tens of bytes each beside their strings."""
        data, ends, kinds, digests = bytearray(), array("q", [0]), array("q"), array("Q")
        for text, kind in entries:
            entry = text.encode()
            data += entry
            ends.append(len(data))
            kinds.append(kind)
            digests.append(xxhash.xxh64_intdigest(entry))
        keys, kinds, offsets = np.array(digests, np.uint64), np.array(kinds, np.int64), np.array(ends, np.int64)
        order = np.argsort(keys, kind="stable")
        entry = lambda i: bytes(data[offsets[i] : offsets[i + 1]])
        keep = np.ones(len(order), bool)
        again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]]) + 1
        for k in again.tolist():  # repeated entries, and different ones whose keys collide
            for j in range(k - 1, -1, -1):
                if keys[order[j]] != keys[order[k]]:
                    break
                if keep[j] and entry(order[j]) == entry(order[k]):
                    kinds[order[j]] |= kinds[order[k]]
                    keep[k] = False
                    break
        order = order[keep]
        lengths = offsets[order + 1] - offsets[order]
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        strings = np.frombuffer(bytes(data), np.uint8)[np.repeat(offsets[order] - at[:-1], lengths) + np.arange(at[-1])]
        return DigestArray(keys[order], kinds[order], at, strings)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(self.keys), len(self.strings)], _FRAME).tobytes())
            for part in (self.keys, self.kinds, self.offsets, self.strings):
                f.write(np.ascontiguousarray(part).tobytes())

    @staticmethod
    def open(path: str) -> DigestArray:
        n, m = np.fromfile(path, _FRAME, 2)
        at, parts = 16, []
        for kind, count in ((np.uint64, n), (np.int64, n), (np.int64, n + 1), (np.uint8, m)):
            parts.append(np.memmap(path, kind, "r", at, (int(count),)) if count else np.zeros(0, kind))
            at += int(count) * np.dtype(kind).itemsize
        return DigestArray(*parts)

    def probe(self, candidates: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """For each candidate the kinds of the entry with the same string, or 0."""
        kinds = np.zeros(len(candidates), np.int64)
        if not len(self.keys) or not candidates:
            return kinds
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates)) if digests is None else digests
        lo = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == digests):
            at = lo[i]
            while at < len(self.keys) and self.keys[at] == digests[i]:  # entries whose keys collide lie side by side
                if self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes() == candidates[i]:
                    kinds[i] = self.kinds[at]
                    break
                at += 1
        return kinds


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): the host is what follows the first :// up to / ? # or the end, A-Z lower-cased; the path what follows up to ? # or the end."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, parts, 1), upper, upper.lower())
    return F.when(has, host).otherwise(F.lit("")), F.when(has, F.regexp_extract(url, parts, 2)).otherwise(F.lit(""))


def _suffixes(host: str, longest: int) -> list[str]:
    """The host and its parents, of ``longest`` characters at most: no entry has a longer host."""
    out, at = [host] if len(host) <= longest else [], host.find(".", max(0, len(host) - longest - 1))
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def _judge(lengths: list[int], longest: int, host: str, path: str, out: list[bytes]) -> None:
    """Appends the url's candidate entries, longest first: a rule is host suffix + path prefix, a blocked host is the bare suffix."""
    suffixes = _suffixes(host, longest)
    out += [x.encode() for x in sorted((s + path[:n] for s in suffixes for n in lengths if len(path) >= n), key=len, reverse=True)]
    out += [s.encode() for s in suffixes if s]


def filter_urls(pages: DataFrame, allow: Iterable[str], block: Iterable[str], blocked_hosts: Iterable[str]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``allow`` and ``block`` are rules host + path prefix; a rule fits its host and the subdomains when the path starts with
    the rule's, and the longest fitting rule decides (block before allow on a tie of one string). Else a page is blocked
    when its host or a parent of it is in ``blocked_hosts``. A null url, or one without ://, has an empty host and path, no
    rule, and is allowed. Repeated rows each have their verdict; no pages give no rows.
    """
    spark = pages.sparkSession
    rules = [(r, RULE_ALLOW) for r in allow] + [(r, RULE_BLOCK) for r in block]
    lengths = sorted({len(r) - r.index("/") for r, _ in rules}, reverse=True)
    hosts = [(h, HOST_BLOCK) for h in blocked_hosts]
    longest = max([r.index("/") for r, _ in rules] + [len(h) for h, _ in hosts], default=0)
    name = _publish(spark, DigestArray.build(rules + hosts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray.open(SparkFiles.get(name))
        for b in batches:
            wanted: list[bytes] = []
            ends = []
            for host, path in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True):
                _judge(lengths, longest, host, path, wanted)
                ends.append(len(wanted))
            kinds = index.probe(wanted)
            hit = np.flatnonzero(kinds)
            rules_out, verdicts, start = [], [], 0
            for end in ends:
                lo, hi = np.searchsorted(hit, (start, end))
                rule, verdict = None, "allow"
                for i in hit[lo:hi]:
                    if b"/" in wanted[i] and kinds[i] & (RULE_ALLOW | RULE_BLOCK):
                        rule, verdict = wanted[i].decode(), "block" if kinds[i] & RULE_BLOCK else "allow"
                        break
                    if kinds[i] & HOST_BLOCK:
                        verdict = "block"
                rules_out.append(rule)
                verdicts.append(verdict)
                start = end
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["host"], b["path"], pa.array(rules_out, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"]
            )

    host, path = split_url(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(run, SCHEMA)


def _publish(spark: SparkSession, index: DigestArray) -> str:
    """Ship the file to all executors; its name is its content's, so a second call ships nothing new."""
    digest = hashlib.sha256(b"".join(np.ascontiguousarray(x).tobytes() for x in (index.keys, index.kinds, index.offsets, index.strings))).hexdigest()
    name = f"urls-{digest[:32]}.bin"
    if name not in _published.setdefault(spark.sparkContext.applicationId, set()):
        path = os.path.join(tempfile.mkdtemp(prefix="urls-"), name)
        index.save(path)
        spark.sparkContext.addFile(path)
        _published[spark.sparkContext.applicationId].add(name)
    return name


_published: dict[str, set[str]] = {}

#: The lists of the registered query.
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
BLOCKED_HOSTS = tuple(
    f"{label}.example.{top}" for label in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")
)

ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM hosts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
