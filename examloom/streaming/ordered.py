"""Streams whose events come late and out of order, and give what the batch operators give (ST4, ST7, ST8).

Keyed state lives in the engine's state store. Sessions that run these set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class InOrder(StatefulProcessor):
    """Holds each key's events until the watermark has passed them, and then hands them to ``passed`` in the order of (time, seq).

    What comes behind the watermark is late and dropped by the engine, so nothing can come before an event that was handed on. One
    timer for each key is set to its earliest event held.
    """

    held_schema = "micros long, seq long, event string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(m), int(q), e) for some in rows for m, q, e in zip(some["micros"], some["seq"], some["event"], strict=True)]
        if not new:
            return iter(())
        self.held.appendList(new)
        at, set_to = self._moment(new), [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if not set_to or at < min(set_to):
            for t in set_to:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(h) for h in self.held.get())
        ready, rest = [h for h in held if h[0] <= until], [h for h in held if h[0] > until]
        # The engine deletes the timer that went off, and a key has no other.
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(self._moment(rest))
        else:
            self.held.clear()
        if ready:
            yield self.passed(key, ready)

    @staticmethod
    def _moment(held: list[tuple]) -> int:
        """The millisecond that the earliest event lies in has ended by then."""
        return -(-min(h[0] for h in held) // 1000)

    def passed(self, key: Any, ready: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class SlidingWindow(InOrder):
    """State: the times of passed events that a later one may still look back to, and the last one's time."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "micros long")

    def passed(self, key: Any, ready: list[tuple]) -> pd.DataFrame:
        times = sorted(r[0] for r in self.recent.get())
        out, last = [], times[-1] if times else None
        times += [h[0] for h in ready]
        low = high = 0
        for at, seq, _ in ready:
            while times[low] < at - self.micros:
                low += 1
            # Events of one moment see each other.
            while high < len(times) and times[high] <= at:
                high += 1
            out.append((key[0], seq, high - low, None if last is None else (at - last) / 1_000_000))
            last = at
        self.recent.put([(t,) for t in times if t >= last - self.micros])
        return pd.DataFrame(out, columns=["run_id", "seq", "recent", "gap_s"])


class Streaks(InOrder):
    """State: how many failures came in a row."""

    def __init__(self, strikes: int):
        self.strikes = strikes

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.streak = handle.getValueState("streak", "n long")

    def passed(self, key: Any, ready: list[tuple]) -> pd.DataFrame:
        before = self.streak.get()
        n = was = before[0] if before else 0
        out = []
        for _, seq, event in ready:
            n = n + 1 if event == "error" else 0
            if n:
                out.append((key[0], seq, n, n >= self.strikes))
        if n != was:
            self.streak.update((n,))
        return pd.DataFrame(out, columns=["run_id", "seq", "streak", "demoted"])


class Newest(StatefulProcessor):
    """State: the greatest ``keep`` numbers so far. An event that is not among them changes nothing, whenever it comes."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = [r[0] for r in self.kept.get()]
        both = sorted([*before, *(int(s) for some in rows for s in some["seq"])], reverse=True)
        after = both[: self.keep]
        self.kept.put([(s,) for s in after])
        out = [(key[0], s, "kept") for s in sorted(set(after) - set(before))] + [(key[0], s, "dropped") for s in sorted(set(before) - set(after))]
        yield pd.DataFrame(out, columns=["run_id", "seq", "change"])

    def close(self) -> None:
        pass


def _events(log: DataFrame, lateness: str) -> DataFrame:
    return log.withWatermark("t", lateness).select("run_id", "t", F.unix_micros("t").alias("micros"), "seq", "event")


def rate_window(log: DataFrame, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """ST4: for each event, those of its run in the last ``seconds``, and the gap before it; told once the watermark has passed it.

    ``log``: a stream of run_id (long), t, seq, event. Equal to ``operators.telemetry.rate_window`` of all events that were not late.
    """
    by = _events(log, lateness).groupBy("run_id")
    return by.transformWithStateInPandas(SlidingWindow(seconds * 1_000_000), "run_id long, seq long, recent long, gap_s double", "append", "eventtime")


def failure_streaks(log: DataFrame, strikes: int = 3, lateness: str = "10 minutes") -> DataFrame:
    """ST7, W12: consecutive failures per run, whatever order the events of a run come in within ``lateness``. Equal to the batch form."""
    by = _events(log, lateness).groupBy("run_id")
    return by.transformWithStateInPandas(Streaks(strikes), "run_id long, seq long, streak long, demoted boolean", "append", "eventtime")


def newest(log: DataFrame, keep: int = 500) -> DataFrame:
    """ST8, W13: changes to the newest ``keep`` entries of each run: what came in, and what it pushed out. Each change is told once; all of them together give the batch form."""
    by = log.select("run_id", "seq").groupBy("run_id")
    return by.transformWithStateInPandas(Newest(keep), "run_id long, seq long, change string", "append", "none")
