"""An answer's stream of chunks as events: token, replace, done or error.

Chunks may come in any order and more than once; those of a message are told in order of seq. What may be
reasoning is held back while it streams. When the last chunk has come, the answer is stripped as a whole; if that isn't
what was streamed, as where a block was never closed, it replaces it. A message's state is bounded: an
answer over `LONGEST` characters, held chunks included, ends in an error, and so does one of which nothing new comes
within `patience`. What comes after the end is ignored until the state expires.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Tags of reasoning.
_BLOCK, _TAG = re.compile(r"(?is)<think>.*?</think>"), re.compile(r"(?i)<(/?)think>")
_TAGS = ("<think>", "</think>")
#: Characters of an answer; milliseconds that a message's state lasts after its last chunk.
LONGEST, LASTING = 1 << 20, 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stripped(text: str) -> str:
    """The whole answer without reasoning: closed blocks go, then tags that are left."""
    return _TAG.sub("", _BLOCK.sub("", text))


def streamed(text: str) -> str:
    """What of an answer's beginning can be shown: no open block, nothing that may become a tag."""
    out, at, inside = "", 0, False
    for tag in _TAG.finditer(text):
        out += "" if inside else text[at : tag.start()]
        at = tag.end()
        inside = tag[1] == "" or (inside and tag[1] != "/")
    if inside:
        return out
    tail = text[at:]
    low = tail.lower()
    held = next((n for n in range(min(len(tail), 7), 0, -1) if any(t.startswith(low[-n:]) for t in _TAGS)), 0)
    return out + tail[: len(tail) - held]


class Answers(StatefulProcessor):
    """Events of messages, a key each."""

    def __init__(self, patience: int | None, longest: int = LONGEST, lasting: int = LASTING):
        self.patience, self.longest, self.lasting = patience, longest, lasting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lasting = None if self.patience is None else self.lasting
        self.answer = handle.getValueState("answer", "next long, text string, shown long, events long, ended boolean", lasting)
        self.waiting = handle.getMapState("waiting", "seq long", "text string, last boolean", lasting)

    def _state(self) -> list:
        return list(self.answer.get()) if self.answer.exists() else [0, "", 0, 0, False]

    def _told(self, key: tuple, state: list, events: list[tuple[str, str]]) -> pd.DataFrame:
        rows = [(key[0], state[3] + i, kind, content) for i, (kind, content) in enumerate(events)]
        state[3] += len(events)
        return pd.DataFrame(rows, columns=["message", "n", "type", "content"])

    def _end(self, state: list) -> None:
        state[1], state[4] = "", True
        for seq in [k for k in self.waiting.keys()]:
            self.waiting.removeKey(seq)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, events = self._state(), []
        for frame in rows:
            for seq, text, last in zip(frame.seq, frame.text, frame["last"]):
                if not state[4] and seq >= state[0] and not self.waiting.containsKey((int(seq),)):
                    self.waiting.updateValue((int(seq),), (text or "", bool(last)))
        if state[4]:
            return
        ended = False
        while not ended and self.waiting.containsKey((state[0],)):
            text, ended = self.waiting.getValue((state[0],))
            self.waiting.removeKey((state[0],))
            state[0], state[1] = state[0] + 1, state[1] + text
        held = sum(len(v[0]) for v in self.waiting.values()) if not ended else 0
        if len(state[1]) + held > self.longest:
            events.append(("error", "ANSWER_TOO_LONG"))
            self._end(state)
        else:
            show = streamed(state[1])
            if len(show) > state[2]:
                events.append(("token", show[state[2] :]))
                state[2] = len(show)
            if ended:
                whole = stripped(state[1])
                events += [("replace", whole)] * (whole != show) + [("done", whole)]
                self._end(state)
        for timer in [t for t in self.handle.listTimers()] if self.patience is not None else ():
            self.handle.deleteTimer(timer)
        if not state[4] and self.patience is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        out = self._told(key, state, events)
        self.answer.update(tuple(state))
        if len(out):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._state()
        if not state[4]:
            out = self._told(key, state, [("error", "ANSWER_TIMEOUT")])
            self._end(state)
            self.answer.update(tuple(state))
            yield out

    def close(self) -> None:
        pass


def answer_events(chunks: DataFrame, patience: int | None = 600_000, longest: int = LONGEST, lasting: int = LASTING) -> DataFrame:
    """(message, n, type, content) of a stream of chunks (message, seq, text, last): a message's events are numbered from 0.

    Without `patience` there are no timers and state stays, so that a stream of what is there now comes to an end.
    Its state needs a store with timers and column families, so the session is set to it.
    """
    chunks.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(chunks.dtypes)["message"]
    return chunks.groupBy("message").transformWithStateInPandas(Answers(patience, longest, lasting), f"message {kind}, n long, type string, content string", "Append", "None" if patience is None else "ProcessingTime")
