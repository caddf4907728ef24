"""Vectorised word hashing over Arrow string buffers.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed; it depends on the word
alone, so every task and every run agrees. Words are told apart by these 64 bits: two of a corpus's words collide by chance alone, but
long words made to collide (periods of thousands of bytes) can. Cost is a few nanoseconds a byte, with no Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 19  # bytes hashed at once, so that the working arrays stay in cache

_codes = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
_space = (_codes == 32) | ((_codes >= 9) & (_codes <= 13))
_alnum = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)

#: Byte value after lower-casing A-Z, plus one; 0 marks a separator.
SPACE_WORDS = np.where(_space, 0, _LOWER.astype(np.uint16) + 1).astype(np.uint64)
ALNUM_WORDS = np.where(~_alnum, 0, _LOWER.astype(np.uint16) + 1).astype(np.uint64)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _PIECE + 4096)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray = ALNUM_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte starts, byte ends, first): the words of all rows in order; row i has words first[i]:first[i+1].

    A word never crosses a row's end. Long rows are hashed in pieces cut at separators.
    """
    n = len(data)
    hashes, starts, ends = [], [], []
    cuts = np.zeros(n + 1, bool)
    cuts[offsets] = True
    pos = 0
    while pos < n:
        end = min(n, pos + _PIECE)
        if end < n:  # back to the last place where no word is cut, or on to the next
            back = end
            while back > pos and not cuts[back] and lut[data[back]] and lut[data[back - 1]]:
                back -= 1
            if back > pos:
                end = back
            else:
                while end < n and not cuts[end] and lut[data[end]]:
                    end += 1
        v = lut[data[pos:end]]
        word = v != 0
        before = np.empty(len(word), bool)
        before[0] = True
        np.logical_or(~word[:-1], cuts[pos + 1 : end], out=before[1:])
        s = np.flatnonzero(word & before)
        if len(s):
            after = np.empty(len(word), bool)
            after[-1] = True
            np.logical_or(~word[1:], cuts[pos + 1 : end], out=after[:-1])
            e = np.flatnonzero(word & after) + 1
            power, inverse = _power_tables(len(v))
            sums = np.empty(len(v) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(v * power[: len(v)], dtype=np.uint64, out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
            starts.append(s + pos)
            ends.append(e + pos)
        pos = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, offsets)


def word_hash(word: str, lut: np.ndarray = ALNUM_WORDS) -> int:
    """The hash of one word, as in hash_words."""
    data, offsets = utf8(pa.array([word]))
    return int(hash_words(data, offsets, lut)[0][0])


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the runs of ``width`` words in each row; a row with fewer words has one shingle of all of them, an empty row none."""
    rows, n = len(first) - 1, len(h)
    lengths = np.diff(first)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    out_first = np.zeros(rows + 1, np.int64)
    np.cumsum(counts, out=out_first[1:])
    if not n:
        return np.zeros(0, np.uint64), out_first
    # positions of the shingles: the first counts[i] words of each row
    at = np.repeat(first[:-1] - out_first[:-1], counts) + np.arange(out_first[-1])
    last = np.repeat(first[1:], counts)
    acc = np.zeros(len(at), np.uint64)
    for k in range(width):
        p = at + k
        inside = p < last
        term = h[np.minimum(p, n - 1)]
        acc = np.where(inside, acc * np.uint64(0xD6E8FEB86659FD93) + term, acc)
    return mix(acc), out_first


def row_ranges(offsets: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Consecutive ranges of rows of about ``most`` bytes each (at least one row), so that working memory follows neither batch nor table."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(end, n)))
        at = min(end, n)
    return out
