"""Personal data: patterns, and a character BiLSTM with CRF transitions that adds what the patterns miss.

The tagger is trained on the driver from at most FIT_WINDOWS windows of the corpus, labelled with the patterns' spans, and from
written forms that no pattern covers (national phone numbers, cards with other separators), with dates, versions, amounts and
keys as counter-examples. A text is cut into overlapping windows of WINDOW characters; those with a digit or an @ are
decoded (no span of any kind is without one, so all others are outside by definition) and each character takes the tag of the
window in whose middle it lies, so that spans are reconciled over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.tagger import WINDOW, Tagger
from quillstone.llm.words import utf8

KINDS = ("email", "ip", "card", "phone")
STRIDE, EDGE = WINDOW // 2, WINDOW // 4
#: Documented bounds of what the tagger is trained on.
FIT_WINDOWS, FIT_WRITTEN = 700, 700
#: Documents (in expectation) that the corpus's windows are taken from.
FIT_DOCS = 20_000
DECODED_AT_ONCE = 1024

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans: leftmost, not overlapping within a kind; failing matches are dropped. Linear in the text."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        else:
            end = max(end, at)  # a local part holds no @, so none starts before this one
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _symbols() -> np.ndarray:
    table = np.full(128, 1, np.int16)
    for c in range(32):
        table[c] = 2
    order = "abcdefghijklmnopqrstuvwxyz .,:;@+-_()/%#='\"[]!"
    for i, c in enumerate(order):
        table[ord(c)] = 3 + i
    table[ord("0") : ord("9") + 1] = 3 + len(order)
    table[ord("A") : ord("Z") + 1] = 4 + len(order)
    return table


_TABLE = _symbols()
SYMBOLS = int(_TABLE.max()) + 2  # and one for all beyond ASCII; 0 pads


def encode(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], SYMBOLS - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hits(points: np.ndarray) -> np.ndarray:
    return np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))


def windows_of(points: np.ndarray) -> np.ndarray:
    """Numbers k of the windows [k * STRIDE, k * STRIDE + WINDOW) that hold a digit or an @."""
    at = hits(points) // STRIDE
    return np.unique(np.concatenate([at, at - 1]).clip(0)) if len(at) else at


def cut(symbols: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols, np.zeros(WINDOW, symbols.dtype)])
    return padded[np.minimum(numbers[:, None] * STRIDE + np.arange(WINDOW), len(padded) - 1)]


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    """0 outside, 1 + 2k begins kind k, 2 + 2k goes on. Where spans overlap the first one stays."""
    y = np.zeros(n, np.int8)
    for s, k, e in spans:
        if not y[s:e].any():
            y[s:e] = 2 + 2 * k
            y[s] = 1 + 2 * k
    return y


def spans_of(tags: np.ndarray) -> list[Span]:
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    begins = np.flatnonzero((kind >= 0) & ((tags % 2 == 1) | (np.concatenate([[-1], kind[:-1]]) != kind)))
    stops = np.flatnonzero(np.concatenate([kind[1:] != kind[:-1], [True]]) | np.concatenate([tags[1:] % 2 == 1, [True]])) + 1
    return [(int(b), int(kind[b]), int(stops[np.searchsorted(stops, b, "right")])) for b in begins]


def plausible(text: str, span: Span) -> bool:
    """What an added span must hold at least: the tagger's cuts are checked against the kind's necessary form."""
    s, kind, e = span
    part, n = text[s:e], len(_digits(text[s:e]))
    edge = not (s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum())
    if kind == 0:
        return edge and "@" in part[1:-1]
    if kind == 1:
        return edge and [bool(re.fullmatch("[0-9]{1,3}", p)) and int(p) < 256 for p in part.split(".")] == [True] * 4
    if kind == 2:
        return edge and 14 <= n <= 19 and luhn(_digits(part)) and not re.search(r"[^0-9 .\-/_]", part)
    groups = re.findall(r"[0-9]+", part)
    sizes = [len(g) for g in groups[part.startswith(("+", "00")) :]]
    return edge and 9 <= n <= 15 and 2 <= len(groups) <= 5 and bool(sizes) and 2 <= min(sizes) <= max(sizes) <= 4 and max(sizes) >= 3 and not re.search(r"[^0-9().+\- /]", part)


class Finder:
    def __init__(self, tagger: Tagger) -> None:
        self.tagger = tagger

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """The tagger's spans that touch no span of the patterns, for each text."""
        points = [code_points(t) for t in texts]
        numbers = [windows_of(p) for p in points]
        out: list[list[Span]] = []
        decoded = self._decode(points, numbers)
        for text, p, k, d, b in zip(texts, points, numbers, decoded, base, strict=True):
            tags = np.zeros(len(p), np.int8)
            for number, row in zip(k, d, strict=True):  # each character from the window in whose middle it lies
                lo = number * STRIDE
                a, z = (0 if number == 0 else EDGE), min(WINDOW - EDGE, len(p) - lo)
                if z > a:
                    tags[lo + a : lo + z] = row[a:z]
            taken = np.zeros(len(p) + 1, bool)
            for s, _, e in b:
                taken[s:e] = True
            found = []
            for span in spans_of(tags) if tags.any() else []:
                s, kind, e = span
                while e > s and text[e - 1] in " .,-(":
                    e -= 1
                if not taken[s:e].any() and plausible(text, (s, kind, e)):
                    found.append((s, kind, e))
            out.append(found)
        return out

    def _decode(self, points: list[np.ndarray], numbers: list[np.ndarray]) -> list[np.ndarray]:
        rows, sizes = [], [len(n) for n in numbers]
        held: list[np.ndarray] = []
        for p, n in zip(points, numbers, strict=True):
            x = cut(encode(p), n) if len(n) else np.zeros((0, WINDOW), np.int64)
            for at in range(0, len(x), DECODED_AT_ONCE):
                held.append(x[at : at + DECODED_AT_ONCE])
                if sum(map(len, held)) >= DECODED_AT_ONCE:
                    rows.append(self.tagger.decode(np.concatenate(held)))
                    held = []
        if held:
            rows.append(self.tagger.decode(np.concatenate(held)))
        every = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int8)
        return np.split(every, np.cumsum(sizes)[:-1]) if sizes else []

    def find(self, texts: pa.Array) -> Iterator[tuple[int, list[Span], list[Span]]]:
        """(row, pattern spans, all spans) of the rows that have any, in order of rows."""
        data, offsets = utf8(texts)
        mark = ((data >= 48) & (data <= 57)) | (data == 64)
        upto = np.concatenate([[0], np.cumsum(mark)])
        some = np.flatnonzero(upto[offsets[1:]] > upto[offsets[:-1]])
        for at in range(0, len(some), 256):
            rows = some[at : at + 256]
            strings = [texts[int(i)].as_py() for i in rows]
            base = [base_spans(t) for t in strings]
            for i, b, more in zip(rows, base, self.added(strings, base), strict=True):
                if b or more:
                    yield int(i), b, sorted(b + more)


def _written(rng: np.random.Generator, count: int) -> list[tuple[str, list[Span]]]:
    """Synthetic windows: written forms of each kind, and numbers that are no personal data, between invented words."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwy"), rng.integers(2, 9)))

    def card() -> str:
        body = str(rng.integers(3, 7)) + d(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def grouped(x: str, by: str) -> str:
        return by.join(x[i : i + 4] for i in range(0, len(x), 4))

    makers = (
        (0, lambda: f"{word()}.{word()}{d(2)}@{word()}.{word()}.com"), (0, lambda: f"{word()}@{word()}.org"),
        (1, lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))),
        (2, card), (2, lambda: grouped(card(), " ")), (2, lambda: grouped(card(), "-")), (2, lambda: grouped(card(), ".")),
        (3, lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"{d(3)}-{d(3)}-{d(4)}"), (3, lambda: f"{d(3)}.{d(3)}.{d(4)}"),
        (3, lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}"),
        (-1, lambda: f"20{d(2)}-{d(2)}-{d(2)}"), (-1, lambda: f"{d(1)}.{d(2)}.{d(1)}"), (-1, lambda: f"${d(3)}.{d(2)}"), (-1, lambda: f"{d(2)}:{d(2)}:{d(2)}"),
        (-1, lambda: "".join(rng.choice(list("0123456789abcdef"), 40))), (-1, lambda: d(int(rng.integers(1, 12)))), (-1, lambda: f"{d(1)},{d(3)},{d(3)}"),
        (-1, lambda: f"AKIA{''.join(rng.choice(list('ABCDEFGH0123456789'), 16))}"), (-1, lambda: f"key={''.join(rng.choice(list('0123456789abcdef'), 20))}"),
        (-1, lambda: f"@{word()}"), (-1, lambda: " ".join(str(x) for x in rng.integers(0, 100, 8))), (-1, lambda: f"{word()}{d(2)}"),
    )
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.integers(0, 5))), []
        for _ in range(rng.integers(1, 3)):
            kind, make = makers[rng.integers(0, len(makers))]
            text += " " if text else ""
            s = len(text)
            text += make()
            if kind >= 0:
                spans.append((s, kind, len(text)))
            text += rng.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(rng.integers(1, 6)))
        out.append((text[:WINDOW], [x for x in spans if x[2] <= WINDOW]))
        if len(text) > WINDOW and any(x[0] < WINDOW < x[2] for x in spans):
            out.pop()
    return out


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a digit or an @, with the tags of the patterns' spans."""
    for b in batches:
        orders, windows, tags = [], [], []
        data, offsets = utf8(b["text"])
        upto = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
        for i in np.flatnonzero(upto[offsets[1:]] > upto[offsets[:-1]]):
            text = b["text"][int(i)].as_py()
            points = code_points(text)
            y = np.concatenate([tags_of(base_spans(text), len(points)), np.zeros(WINDOW, np.int8)])
            numbers = windows_of(points)
            for k, x in zip(numbers, cut(encode(points), numbers), strict=True):
                x, t = x.astype(np.int16).tobytes(), y[k * STRIDE : k * STRIDE + WINDOW]
                t = np.concatenate([t, np.zeros(WINDOW - len(t), np.int8)]).tobytes()
                orders.append(int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "big"))
                windows.append(x)
                tags.append(t)
        if orders:
            yield pa.RecordBatch.from_arrays([pa.array(orders, pa.int64()), pa.array(windows, pa.binary()), pa.array(tags, pa.binary())], ["ord", "x", "y"])


def train(docs: DataFrame, windows: int = FIT_WINDOWS, written: int = FIT_WRITTEN) -> Tagger:
    """Fit on the windows of about FIT_DOCS documents that come first by hash, at most ``windows``, and ``written`` synthetic ones."""
    share = FIT_DOCS / max(docs.count(), 1)  # so that the tasks together pass on the windows of few documents
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < (1 << 30) * min(share, 1.0))
    found = some.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_samples, "ord long, x binary, y binary").distinct().orderBy("ord", "y").limit(windows).collect()
    xs, ys = [np.frombuffer(r.x, np.int16) for r in found], [np.frombuffer(r.y, np.int8) for r in found]
    for text, spans in _written(np.random.default_rng(2), written):
        points = code_points(text)
        xs.append(cut(encode(points), np.zeros(1, np.int64))[0])
        ys.append(np.concatenate([tags_of(spans, len(points)), np.zeros(WINDOW, np.int8)])[:WINDOW])
    tagger = Tagger.new(SYMBOLS, 1 + 2 * len(KINDS))
    tagger.fit(np.stack(xs).astype(np.int64), np.stack(ys).astype(np.int64))
    return tagger


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per document: doc_id, the number of the patterns' spans by kind, n_added (spans that the tagger adds), base_sha256, spans.

    Null text is empty and has no spans. Positions are code points, the end exclusive. Repeated rows have equal results; columns other
    than doc_id and text are not read.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(tagger or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, nothing = Finder(model.value), hashlib.sha256(b"").hexdigest()
        for b in batches:
            counts = np.zeros((len(KINDS) + 1, b.num_rows), np.int64)
            digests, spans = [nothing] * b.num_rows, [""] * b.num_rows
            for i, base, every in finder.find(b["text"]):
                for _, k, _ in base:
                    counts[k, i] += 1
                counts[-1, i] = len(every) - len(base)
                digests[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RESULT)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span, overlapping ones together, replaced by its (first) kind in angle brackets."""
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with the personal data in text replaced and n_chars of the new text; the columns stay as they are, null text stays null."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(tagger or train(docs))

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(model.value)
        for texts in batches:
            changed = {i: redact_text(texts[i].as_py(), every) for i, _, every in finder.find(texts)}
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], texts.type))
            yield texts

    import pyarrow.compute  # noqa: F401

    columns = docs.columns
    out = docs.withColumn("text", cleaned("text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*columns)
