"""Byte-level BPE: DuckDB recursive queries inside each partition contract token rows; an ordered aggregation decodes.

A text is cut into pieces by vector operations over the classes of its characters. A batch's distinct pieces become rows (piece, position,
token), first one token a byte. A recursive query joins neighbouring rows to the merge table and contracts each piece's leftmost pair of least rank,
until no piece has a pair left. Pieces that the worker has met before are looked up. Decoding joins token rows to the vocabulary and aggregates the bytes in
order. A task's memory follows its batches' ranges of rows (PIECE_BYTES of text, SPAN tokens), not its partition.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.storage import fresh
from quillstone.llm.words import row_ranges, utf8

PIECE_BYTES, SPAN = 8 << 20, 1 << 18
#: Pieces of more bytes than SHORT go through the query that also contracts all repeats of a pair, as many steps at a time as leave about STEP_ROWS rows.
SHORT, STEP_ROWS = 48, 4 << 20
#: Pieces that a Python worker remembers, at most; the file's bytes that may be broadcast, at most.
KNOWN, FILE_BYTES = 1_000_000, 64 << 20
DUCKDB = {"threads": 1, "memory_limit": "600MB"}

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The endings that the split pattern takes off, without their apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: The characters of white space, by the Unicode property of that name.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        out[c] = kind.get(unicodedata.category(chr(c))[0], OTHER)
    out[list(WHITE)] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = char_classes()
    out = table[data]  # right for ASCII
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        return out
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    lead, rest = padded[at], [padded[at + k] & 0x3F for k in (1, 2, 3)]
    two, three = (lead & 0x1F) << 6 | rest[0], (lead & 0x0F) << 12 | rest[0] << 6 | rest[1]
    four = (lead & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
    out[at] = table[np.minimum(np.select([lead < 0xE0, lead < 0xF0], [two, three], four), 0x10FFFF)]
    follows = (data & 0xC0) == 0x80
    return out[np.maximum.accumulate(np.where(follows, 0, np.arange(len(data))))] if follows.any() else out


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first): the pieces' first bytes, and one past the last; row i has pieces first[i]:first[i+1].

    Runs of letters, of numbers and of other characters are pieces, each with one blank before it; so are an apostrophe's endings where the apostrophe begins a piece.
    White space is a piece up to its last character if something follows in the row, and that character another unless it is the next piece's blank.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    kind = byte_classes(data)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    begins = row[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    white = (kind[runs] == SPACE) & ~row[ends]  # white space with something after it in the row
    last = ends[white] - 1
    while len(back := np.flatnonzero((data[last] & 0xC0) == 0x80)):  # to the first byte of its last character
        last[back] -= 1
    begins[last] = True
    blank = data[last] == 0x20
    begins[ends[white][blank]] = False
    alone = np.flatnonzero(begins[:n] & (data == 0x27))  # apostrophes that begin a piece
    if len(alone):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        stop = offsets[np.searchsorted(offsets, alone, "right")]  # each one's row's end
        for ending in ENDINGS:
            hit = np.ones(len(alone), bool)
            for k, byte in enumerate(ending, 1):
                hit &= padded[alone + np.minimum(k, n + 1 - alone)] == byte
            at = alone[hit & (alone + len(ending) < stop)]
            begins[at + 1] = False
            after = at + 1 + len(ending)
            begins[after[after < n]] = True
    starts = np.append(np.flatnonzero(begins), n)
    return starts, np.searchsorted(starts, offsets)


class Vocabulary:
    """Token bytes by rank, and the merge table: each way to cut a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no token")
        self.ids, self.tokens = np.array(list(ranks.values()), np.int32), list(ranks)
        cut = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.merges = np.array(cut, np.int32).reshape(-1, 3)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    @staticmethod
    def read(content: bytes) -> Vocabulary:
        """Lines of a token in base64 and its rank."""
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, content.splitlines()))})

    def connect(self) -> duckdb.DuckDBPyConnection:
        con = duckdb.connect(config=DUCKDB)
        con.register("given", pa.table({"id": self.ids, "piece": pa.array(self.tokens, pa.binary())}))
        con.execute("CREATE TABLE vocabulary AS SELECT id, hex(piece) AS digits FROM given")
        con.unregister("given")
        con.register("given", pa.table({"l": self.merges[:, 0], "r": self.merges[:, 1], "m": self.merges[:, 2]}))
        # all repeats of a pair may be contracted at once if no pair that its token can be part of has a lower rank
        con.execute("""CREATE TABLE merges AS WITH low AS (SELECT l AS t, m FROM given WHERE m < l UNION ALL SELECT r, m FROM given WHERE m < r)
          SELECT l, r, m, m NOT IN (SELECT t FROM low) AS safe FROM given""")
        con.unregister("given")
        return con


#: key: piece << 32 | position. A row's pair is the one with the row after it. A piece's rows leave the recursion together once it has no pair.
CONTRACT = """
WITH RECURSIVE steps(key, tok, live) AS (
  SELECT key, tok, true FROM seed
  UNION ALL
  (WITH pairs AS (
     SELECT key, tok, lead(key) OVER w AS next, lead(tok) OVER w AS right_tok, lag(key) OVER w AS previous FROM steps WHERE live WINDOW w AS (ORDER BY key)),
   ranked AS (
     SELECT key, tok, previous, (m::bigint << 32) | (key & 4294967295) AS place
     FROM pairs LEFT JOIN merges ON l = tok AND r = right_tok AND next >> 32 = key >> 32),
   best AS (SELECT key >> 32 AS piece, min(place) AS place FROM ranked GROUP BY 1)
   SELECT key, CASE WHEN r.place = b.place THEN (b.place >> 32)::int ELSE tok END, b.place IS NOT NULL
   FROM ranked r JOIN best b ON piece = key >> 32
   WHERE b.place IS NULL OR previous IS NULL OR previous <> ((piece << 32) | (b.place & 4294967295)))
) SELECT key, tok, live FROM steps WHERE NOT live ORDER BY key
"""

#: The same for long pieces, with all repeats of the pair, from the left, where that comes to the same.
CONTRACT_LONG = """
WITH RECURSIVE steps(key, tok, live, step) AS (
  SELECT key, tok, true, 0 FROM seed
  UNION ALL
  (WITH pairs AS (
     SELECT key, tok, step, lead(key) OVER w AS next, lead(tok) OVER w AS right_tok, lag(key) OVER w AS previous, row_number() OVER w AS line
     FROM steps WHERE live AND step < {steps} WINDOW w AS (ORDER BY key)),
   ranked AS (
     SELECT key, tok, step, previous, line, m, safe, (m::bigint << 32) | (key & 4294967295) AS place
     FROM pairs LEFT JOIN merges ON l = tok AND r = right_tok AND next >> 32 = key >> 32),
   best AS (SELECT key >> 32 AS piece, min(place) AS place FROM ranked GROUP BY 1),
   repeats AS (
     SELECT key, line - row_number() OVER (ORDER BY key) AS run FROM ranked r JOIN best b ON piece = key >> 32
     WHERE m = (b.place >> 32) AND (safe OR r.place = b.place)),
   taken AS (SELECT key FROM repeats QUALIFY row_number() OVER (PARTITION BY run ORDER BY key) % 2 = 1)
   SELECT r.key, CASE WHEN t.key IS NOT NULL THEN m ELSE tok END, b.place IS NOT NULL, step + 1
   FROM ranked r JOIN best b ON piece = r.key >> 32 LEFT JOIN taken t ON t.key = r.key LEFT JOIN taken gone ON gone.key = r.previous
   WHERE gone.key IS NULL)
) SELECT key, tok, live FROM steps WHERE NOT live OR step = {steps} ORDER BY key
"""

#: Spans of token rows to their bytes, in order.
DECODE = """
SELECT span, unhex(array_to_string(list(digits ORDER BY place), '')) AS piece FROM tokens JOIN vocabulary USING (id) GROUP BY span ORDER BY span
"""


class Coder:
    """Encodes and decodes the batches of a worker's partitions."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.con = vocabulary, vocabulary.connect()
        self._forget()

    def _forget(self) -> None:
        """Back to the pieces that are tokens themselves."""
        self.known = pa.array(self.vocabulary.tokens, pa.large_binary())
        self.flat, self.ends = self.vocabulary.ids, np.arange(1, len(self.vocabulary.ids) + 1)

    def _contract(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ends) of distinct pieces."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, sizes = np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds)
        place = np.arange(len(data)) - np.repeat(bounds[:-1] - bounds[0], sizes)
        key = np.repeat(np.arange(len(pieces)), sizes) << 32 | place
        token, long = self.vocabulary.bytes[data], np.repeat(sizes > SHORT, sizes)
        found = []
        for query, rows in ((CONTRACT, ~long), (CONTRACT_LONG, long)):
            key_left, token_left = key[rows], token[rows]
            while len(key_left):
                self.con.register("seed", pa.table({"key": key_left, "tok": token_left}))
                out = self.con.sql(query.format(steps=max(1, min(64, STEP_ROWS // len(key_left))))).to_arrow_table()
                self.con.unregister("seed")
                k, t, live = (out[c].to_numpy() for c in ("key", "tok", "live"))
                found.append((k[~live], t[~live]))
                key_left, token_left = k[live], t[live]
        k, t = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(k, kind="stable")
        return t[order].astype(np.int32), np.searchsorted(k[order] >> 32, np.arange(len(pieces)), "right")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of a column of texts; null has no ids."""
        data, offsets = utf8(column)
        parts, ends, done = [np.zeros(0, np.int32)], [], 0
        for lo, hi in row_ranges(offsets, PIECE_BYTES):
            starts, first = split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            buffers = [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data[offsets[lo] : offsets[hi]])]
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, buffers).dictionary_encode()
            pieces, codes = coded.dictionary, coded.indices.to_numpy()
            if len(pieces) + len(self.known) > KNOWN + len(self.vocabulary.ids):
                self._forget()
            new = pieces.filter(pc.is_null(pc.index_in(pieces, self.known)))
            if len(new):
                ids, stops = self._contract(new)
                self.known, self.flat, self.ends = pa.concat_arrays([self.known, new]), np.concatenate([self.flat, ids]), np.concatenate([self.ends, stops + self.ends[-1]])
            at = pc.index_in(pieces, self.known).to_numpy()
            begin, size = np.concatenate([[0], self.ends])[at][codes], np.diff(self.ends, prepend=0)[at][codes]
            stop = np.concatenate([[0], np.cumsum(size)])
            parts.append(self.flat[np.repeat(begin - stop[:-1], size) + np.arange(stop[-1])])
            ends.append(stop[first[1:]] + done)
            done += int(stop[-1])
        return np.concatenate(parts), np.concatenate(ends) if ends else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids. An id that is no token is an error."""
        if not np.isin(ids, self.vocabulary.ids).all():
            raise ValueError("ids without a token")
        rows = np.concatenate([np.zeros(1, np.int64), ends])
        cuts = np.unique(np.concatenate([rows, np.arange(0, len(ids), SPAN)]))  # no span is longer, or of two rows
        pieces: list[bytes] = []
        for lo, hi in row_ranges(cuts, SPAN):
            part = ids[cuts[lo] : cuts[hi]]
            span, size = np.arange(hi - lo, dtype=np.int32), np.diff(cuts[lo : hi + 1])
            self.con.register("tokens", pa.table({"span": np.repeat(span, size), "place": np.arange(len(part), dtype=np.int32), "id": part}))
            out = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("tokens")
            pieces += out["piece"].to_pylist()
        at = np.searchsorted(cuts, rows)
        return [b"".join(pieces[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def _coder(content: bytes) -> Coder:
    """One a worker; what it remembers changes no result."""
    return Coder(Vocabulary.read(content))


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends.astype(np.int32)]), pa.int32()), pa.array(ids, pa.int32()))


def _broadcast(df: DataFrame, path: str):
    """The vocabulary file, read by the driver; its size is checked."""
    with open(path, "rb") as f:
        content = f.read(FILE_BYTES + 1)
    if len(content) > FILE_BYTES:
        raise ValueError(f"a vocabulary of more than {FILE_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(content)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a column of lists; null is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(sizes, dtype=np.int64)


def _whole(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _mapped(df: DataFrame, used: str, path: str, added: list[tuple[str, str]], columns: Callable[[Coder, pa.Array], list[pa.Array]]) -> DataFrame:
    """df and the columns that ``columns`` makes of column ``used``."""
    vocabulary = _broadcast(df, path)
    at, names = df.columns.index(used), [fresh(df, name) for name, _ in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coder = _coder(vocabulary.value)
            yield pa.RecordBatch.from_arrays([*b.columns, *columns(coder, b.column(at))], [*b.schema.names, *names])

    empty = df.limit(0).select("*", *[F.lit(None).cast(kind).alias(name) for name, (_, kind) in zip(names, added, strict=True)])
    return df.mapInArrow(run, empty.schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs and ``ids``, the token ids of column ``text`` (an underscore before a name that docs has already).

    A null or empty text has an empty list. Rows keep all their columns and are coded one by one, repeated ones alike; no rows give none.
    """
    return _mapped(docs, text, path, [("ids", "array<int>")], lambda coder, column: [_lists(*coder.encode(column))])


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """coded and ``decoded``, the bytes of column ``ids``. A null or empty list has no bytes; an id that is no token is an error; no rows give none."""
    return _mapped(coded, ids, path, [("decoded", "binary")], lambda coder, column: [_whole(coder.decode(*_flat(column)))])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, from the ids of the whole text and the bytes decoded from them.

    Encoded and decoded in one pass over the rows, in one worker. A null or empty text has no tokens, its digests are those of no bytes. A null doc_id stays null,
    repeated rows are coded alike, other columns are not read, no rows give none.
    """
    kinds = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def columns(coder: Coder, column: pa.Array) -> list[pa.Array]:
        ids, ends = coder.encode(column)
        raw, bounds = ids.astype("<u4"), [0, *ends.tolist()]
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in coder.decode(ids, ends)], pa.string())]

    return _mapped(docs.select("doc_id", "text"), "text", path, kinds, columns).select("doc_id", *(name for name, _ in kinds))
