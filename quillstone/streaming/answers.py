"""Answers that come in tokens: each batch's tokens with their marks replaced, the state of an answer kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators.answers import MarkReader, Reading
from quillstone.streaming.ingest import STATE_STORE

__all__ = ["STATE_STORE", "mark_stream"]

#: Milliseconds without a token after which an answer is over.
IDLE = 60_000
#: The number of the next token of an answer that is over; it is known for another IDLE, so that repeated tokens don't begin it anew.
OVER = -1
MARKED = "answer_id string, clean string, compat string, refs array<struct<start:int,stop:int,citation:int>>, over boolean"
_STATE = "length int, sentence int, blank boolean, held string, next long, names array<string>, titles array<array<string>>"


class _Answers(StatefulProcessor):
    """One answer: where its reader stands, the number of the token that comes next, and tokens that came before their turn."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reading", _STATE)
        self.early = handle.getMapState("early", "seq long", "token string, last boolean")

    def _restored(self, rows: pd.DataFrame | None) -> tuple[MarkReader, int, list, list]:
        if self.state.exists():
            length, sentence, blank, held, due, names, titles = self.state.get()
            return MarkReader(list(names or ()), list(titles or ()), Reading(length, sentence, blank, held)), due, names, titles
        first = rows.iloc[0]
        names = list(first["names"]) if first["names"] is not None else []
        titles = [list(t) if t is not None else [] for t in first["titles"]] if first["titles"] is not None else []
        return MarkReader(names, titles), 0, names, titles

    def _wait(self, timerValues) -> None:  # noqa: N803
        """The answer's timer begins anew."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by the interface
        batch = pd.concat(list(rows)).sort_values("seq")
        reader, due, names, titles = self._restored(batch)
        if due == OVER:  # repetitions
            return
        clean, compat, refs, over = "", "", [], False
        for seq, token, last in zip(batch["seq"].tolist(), batch["token"], batch["last"], strict=True):
            if seq >= due:  # one that came before is a repetition
                self.early.updateValue((seq,), (token or "", bool(last)))
        while not over and self.early.containsKey((due,)):
            token, over = self.early.getValue((due,))
            self.early.removeKey((due,))
            a, b, c = reader.feed(token)
            clean, compat, refs, due = clean + a, compat + b, refs + c, due + 1
        if over:
            rest = reader.finish()
            clean, compat, due = clean + rest, compat + rest, OVER
            self.early.clear()
        r = reader.reading
        self.state.update((r.length, r.sentence, r.blank, r.held, due, names, titles))
        self._wait(timerValues)
        if clean or refs or over:
            yield pd.DataFrame({"answer_id": [key[0]], "clean": [clean], "compat": [compat], "refs": [refs], "over": [over]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        if not self.state.exists():
            return
        reader, due, _, _ = self._restored(None)
        self.state.clear()
        if due == OVER:
            return
        clean, compat, refs = "", "", []
        for (_,), (token, _) in sorted(self.early.iterator()):  # tokens are missing before these; they come as they are
            a, b, c = reader.feed(token)
            clean, compat, refs = clean + a, compat + b, refs + c
        rest = reader.finish()
        self.early.clear()
        yield pd.DataFrame({"answer_id": [key[0]], "clean": [clean + rest], "compat": [compat + rest], "refs": [refs], "over": [True]})

    def close(self) -> None:
        pass


def mark_stream(tokens: DataFrame, idle: int = IDLE) -> DataFrame:
    """tokens (answer_id, seq from 0, token, last, names array<string>, titles array<array<string>>) as a stream: for each answer and batch what its tokens bring (clean text, text with numbers in place of the known
    marks, references), as operators.answers.mark_sources(fuzzy) has them for the whole answer. A mark may be cut anywhere. Tokens are read in order of seq, and one that comes early waits for those before
    it; repeated ones are passed over; names and titles are those of the answer's first batch. An answer is over with its last token, or ``idle`` milliseconds after the newest; then what was held comes out as text.

    State lives in RocksDB (STATE_STORE).
    """
    return tokens.groupBy("answer_id").transformWithStateInPandas(_Answers(idle), MARKED, "append", "ProcessingTime")
