"""Structured Streaming forms of the keyed state machines: review states, run totals and the login throttle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.catalog import run_totals

SRS_STATE = "ease double, interval double, reps int, lapses int"
SRS_OUT = "student_id long, card_id long, seq long, ease double, interval double, reps int, lapses int"


def step(state: tuple, grade: int) -> tuple:
    """One review: (ease, interval, reps, lapses) before and after."""
    ease, days, reps, lapses = state
    if grade < 3:
        return max(1.3, ease - 0.2), 0.0, 0, lapses + 1
    new = 1.0 if reps == 0 else 3.0 if reps == 1 else float(math.floor(days * ease + 0.5))
    if grade == 3:
        new = max(1.0, float(math.floor(new * 0.7 + 0.5)))
    return max(1.3, ease + (-0.15 if grade == 3 else 0.15 if grade >= 5 else 0.0)), new, reps + 1, lapses


def review_states(reviews: DataFrame) -> DataFrame:
    """E02 over a stream of reviews (student_id, card_id, seq, ts, grade): the state after each micro-batch's last review of a card.

    Reviews of a batch are taken in order of ts and seq; one that comes after a later one of an earlier batch counts
    when it comes.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (2.5, 0.0, 0, 0)
        rows = pd.concat(list(frames)).dropna(subset=["grade", "ts"]).sort_values(["ts", "seq"])
        for grade in rows["grade"]:
            now = step(now, int(grade))
        state.update(now)
        if len(rows):
            yield pd.DataFrame([(*key, int(rows["seq"].iloc[-1]), *now)], columns=[c.split()[0] for c in SRS_OUT.split(", ")])

    return reviews.groupBy("student_id", "card_id").applyInPandasWithState(run, SRS_OUT, SRS_STATE, "update", GroupStateTimeout.NoTimeout)


def run_totals_stream(runs: DataFrame) -> DataFrame:
    """G09 over a stream of runs, for the update or complete output mode; the batch aggregate serves as it is."""
    return run_totals(runs)


def throttled(logins: DataFrame, limit: int = 6, block_seconds: int = 60) -> DataFrame:
    """G19 over a stream of logins (ip, ts, seq, ok): each with blocked; state is a count and the end of a block for each address."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, until = state.get if state.exists else (0, None)
        until = None if until is None or pd.isna(until) else pd.Timestamp(until)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        blocked = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            shut = until is not None and ts < until
            blocked.append(shut)
            if not shut:
                n = 0 if ok else n + 1
                if n >= limit:
                    n, until = 0, ts + timedelta(seconds=block_seconds)
        state.update((n, until))
        yield pd.DataFrame({"ip": key[0], "ts": rows["ts"].to_numpy(), "seq": rows["seq"].to_numpy(), "blocked": blocked})

    return logins.groupBy("ip").applyInPandasWithState(run, "ip long, ts timestamp, seq long, blocked boolean", "n int, until timestamp", "append", GroupStateTimeout.NoTimeout)
