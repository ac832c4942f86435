"""Conversation memory as stream state: the last messages of each thread, one entry each."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import ROLES, contextualized, history_block, needs_context

OUT = "conv_id long, turn long, text string, history array<struct<turn:bigint,role:string,text:string>>"
_COLUMNS = ["conv_id", "turn", "text", "history"]
_MESSAGE = "turn bigint, role string, text string"
ROWS = 2000  # user messages that leave together


class Memory(StatefulProcessor):
    """Per conv_id: up to n messages; a user message goes out with the history before it. Idle threads end after idle_ms.

    State: what turn comes next, how many wait and how many were said; the last n messages in a ring, of which a message
    rewrites one entry; and the turns that came too early, by number. A task holds one Arrow batch and n messages of a
    thread at a time, however many there are.
    """

    def __init__(self, n: int, idle_ms: int | None, first: int):
        self.n, self.idle_ms, self.first = n, idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next bigint, waiting bigint, said bigint")
        self.ring = handle.getMapState("ring", "slot bigint", _MESSAGE)
        self.early = handle.getMapState("early", "turn bigint", "role string, text string")

    def _open(self) -> None:
        self.next, self.waiting, self.said = self.place.get() if self.place.exists() else (self.first, 0, 0)
        self.held = deque(sorted((tuple(m) for m in self.ring.values()), key=lambda m: m[0]) if self.n > 0 and self.said else [], self.n)
        self.fresh: dict[int, tuple] = {}

    def _close(self) -> None:
        for slot, message in self.fresh.items():
            self.ring.updateValue((slot,), message)
        self.place.update((self.next, self.waiting, self.said))

    def _say(self, key, turn: int, role: str, text: str | None) -> Iterator[tuple]:
        if role in ROLES:
            if role == "user":
                yield key[0], turn, text, [{"turn": a, "role": b, "text": c} for a, b, c in self.held]
            if self.n > 0:
                self.held.append((turn, role, text))
                self.fresh[self.said % self.n] = (turn, role, text)
            self.said += 1

    def _hear(self, key, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in rows:
            for turn, role, text in frame.sort_values("turn")[["turn", "role", "text"]].itertuples(index=False):
                turn = int(turn)
                if turn < self.next:
                    continue  # said before
                if turn > self.next:
                    if not self.early.containsKey((turn,)):
                        self.early.updateValue((turn,), (role, text))
                        self.waiting += 1
                    continue
                yield from self._say(key, turn, role, text)
                self.next += 1
                while self.waiting and (late := self.early.getValue((self.next,))) is not None:
                    self.early.removeKey((self.next,))
                    self.waiting -= 1
                    yield from self._say(key, self.next, *late)
                    self.next += 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        out = []
        for message in self._hear(key, rows):
            out.append(message)
            if len(out) == ROWS:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        self._close()
        if self.idle_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What still waits goes out over the gaps, and the thread is forgotten."""
        self._open()
        out = []
        for turn in sorted(k[0] for k in self.early.keys()) if self.waiting else ():
            out += self._say(key, turn, *self.early.getValue((turn,)))
        for state in (self.place, self.ring, self.early):
            state.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def remember(turns: DataFrame, n: int = 10, idle_ms: int | None = None, *, first: int = 0) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) as user turns with history, needs_context, standalone, block.

    Turns of a thread are numbered without gaps from `first` on, roles that memory does not know included, and may come in
    any order: one that is early waits in the state for those before it, one that comes again is passed over. After idle_ms
    without a turn, what waits goes out as it is and the thread ends.
    """
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text").where("conv_id is not null and turn is not null")
    rows = known.groupBy("conv_id").transformWithStateInPandas(Memory(n, idle_ms, first), outputStructType=OUT, outputMode="append", timeMode="None" if idle_ms is None else "ProcessingTime")
    has = F.size("history") > 0
    users = F.filter("history", lambda t: (t["role"] == "user") & (t["text"] != ""))
    last = F.when(F.size(users) > 0, F.element_at(users, -1)["text"])
    return rows.withColumns({"needs_context": needs_context(F.col("text"), has), "standalone": contextualized(F.col("text"), has, last), "block": history_block(F.col("history"))})
