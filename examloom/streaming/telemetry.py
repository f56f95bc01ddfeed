"""Telemetry over a stream of log events (ST5, ST7, ST8): the same results as the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.operators.telemetry import utc_day
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_quota(log: DataFrame, lateness: str = "1 day", limit: int = 500) -> DataFrame:
    """ST5: requests per UTC day and model; a day closes when events are ``lateness`` past its end."""
    day = F.window("t", "1 day")
    counted = log.withWatermark("t", lateness).groupBy(day, "model").agg(F.count("*").alias("requests"))
    return counted.select(utc_day(F.col("window.start")).alias("day"), "model", "requests", F.greatest(F.lit(0), F.lit(limit) - F.col("requests")).alias("left"))


def run_timings(log: DataFrame) -> DataFrame:
    """A13 as a running total per run."""
    return log.groupBy("run_id").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("n"))


def failure_streaks(log: DataFrame, strikes: int = 3) -> DataFrame:
    """ST7, W12: consecutive failures per run so far; any other event starts anew.

    Each run's state is one number. Within a batch events are put in order; between batches they must arrive in order.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for seq, event in zip(rows["seq"], rows["event"], strict=True):
            streak = streak + 1 if event == "error" else 0
            if streak:
                out.append((key[0], seq, streak, streak >= strikes))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["run_id", "seq", "streak", "demoted"])

    narrow = log.select("run_id", "seq", "t", "event")
    return narrow.groupBy("run_id").applyInPandasWithState(advance, "run_id long, seq long, streak long, demoted boolean", "streak long", "append", GroupStateTimeout.NoTimeout)
