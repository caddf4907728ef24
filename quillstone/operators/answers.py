"""Citation marks in answers: a fold over the marks of one answer, so an Arrow UDF over whole answers; the stream form, token by token, is in streaming."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F

_MARK = re.compile(r"\[([^\]]+)\]")
REFS = "struct<clean:string,compat:string,refs:array<struct<start:int,stop:int,citation:int>>>"
_REFS = pa.struct([("clean", pa.string()), ("compat", pa.string()), ("refs", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("citation", pa.int32())])))])


def keys_of(names: list[str], titles: list[list[str] | None] | None = None) -> dict[str, int]:
    """What a mark may say for each source, later sources winning: its name, the name without extension, or one of its titles, as written or in lower case."""
    keys: dict[str, int] = {}
    for i, name in enumerate(names):
        stem = re.sub(r"(?<=.)\.[^.]*$", "", name)
        for k in (name, stem, *((titles[i] if titles and i < len(titles) else None) or ())):
            keys |= {k: i, k.lower(): i} if k else {}
    return keys


def resolve(said: str, keys: dict[str, int], fuzzy: bool) -> int | None:
    """A name as written, else in lower case; fuzzy (streams): in lower case, else the first name that holds it or is held by it."""
    low = said.lower()
    if not fuzzy:
        return keys.get(said, keys.get(low))
    lowered = {k.lower(): i for k, i in keys.items()}
    return lowered.get(low, next((i for k, i in lowered.items() if k and (k in low or low in k)), None))


def mark_sources(answer: str, names: list[str], fuzzy: bool = False, titles: list[list[str] | None] | None = None) -> dict:
    """The answer without the known marks, the answer with numbers in their place, and a reference from the start of the sentence before each mark.

    The start is behind the last full stop of the text since the last mark (fuzzy: of all text so far), else behind its last line end, white space passed over.
    """
    keys, clean, compat, refs, last = keys_of(names, titles), "", "", [], 0
    for m in _MARK.finditer(answer):
        i = resolve(m[1], keys, fuzzy)
        part = answer[last : m.start() if i is not None else m.end()]
        base = len(clean)
        clean, compat, last = clean + part, compat + part, m.end()
        if i is None:
            continue
        if fuzzy:
            start = clean.rfind(".") + 1
        else:
            cut = part.rfind(".") if "." in part else part.rfind("\n")
            start = base + cut + 1
        while start < len(clean) and clean[start].isspace():
            start += 1
        refs.append({"start": start, "stop": len(clean), "citation": i})
        compat += f"[{i + 1}]"
    return {"clean": clean + answer[last:], "compat": compat + answer[last:], "refs": refs}


@dataclass
class Reading:
    """Where the reader of a stream of tokens stands: characters of clean text so far, where its last sentence begins (blank: only white space since), and what may become a mark."""

    length: int = 0
    sentence: int = 0
    blank: bool = True
    held: str = ""


class MarkReader:
    """mark_sources(fuzzy) of an answer that comes in tokens: a token's text, marks replaced, as soon as it is known. What it has read so far matters by its Reading alone, so that it goes on from one
    that was kept; how an answer is cut to tokens changes nothing."""

    def __init__(self, names: list[str], titles: list[list[str] | None] | None = None, reading: Reading | None = None) -> None:
        self.keys, self.reading = keys_of(names, titles), reading or Reading()

    def _plain(self, text: str) -> str:
        r = self.reading
        last = text.rfind(".")
        if last >= 0:
            r.sentence, r.blank = r.length + last + 1, True
        rest = text[last + 1 :]
        if r.blank:
            after = rest.lstrip()
            r.sentence, r.blank = r.length + len(text) - len(after), not after
        r.length += len(text)
        return text

    def feed(self, token: str) -> tuple[str, str, list[dict]]:
        """(clean text, text with numbers in place of marks, references) that the token brings."""
        r, clean, compat, refs = self.reading, "", "", []
        text, r.held = r.held + token, ""
        while text:
            opens = text.find("[")
            if opens < 0:
                part, text = text, ""
            elif opens > 0:
                part, text = text[:opens], text[opens:]
            elif (shuts := text.find("]")) < 0:
                r.held = text
                break
            else:
                part, text = text[: shuts + 1], text[shuts + 1 :]
                cited = resolve(part[1:-1], self.keys, True) if shuts > 1 else None
                if cited is not None:
                    refs.append({"start": r.length if r.blank else r.sentence, "stop": r.length, "citation": cited})
                    compat += f"[{cited + 1}]"
                    continue
            clean, compat = clean + self._plain(part), compat + part
        return clean, compat, refs

    def finish(self) -> str:
        """What was held and is no mark after all."""
        part, self.reading.held = self.reading.held, ""
        return self._plain(part)


def source_marks(fuzzy: bool = False):
    """An Arrow UDF (answer, names, titles array<array<string>>) -> struct clean, compat, refs."""

    @F.arrow_udf(REFS)
    def marks(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([None if a is None else mark_sources(a, n or [], fuzzy, t) for a, n, t in zip(*(c.to_pylist() for c in columns), strict=True)], _REFS)

    return marks
