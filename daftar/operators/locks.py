"""Locks after failures in a row, with their ends, in batch and in streaming by the same step.

The rule: `most` failures without a success between lock a user for some minutes from the last of them on. While a lock holds, attempts are turned away
and count as nothing. A success, the end of a lock, and a day without a counted failure (FORGET) set the count back to 0. Every lock is a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000
FORGET = 24 * 60 * MINUTE


class State(NamedTuple):
    """A user's failures so far, when the last of them was, and until when the user is locked; times in microseconds."""

    failures: int = 0
    last: int = 0
    until: int = 0


def locks(ts: np.ndarray, failed: np.ndarray, state: State, most: int, lock: int, forget: int = FORGET) -> tuple[list[int], State]:
    """Begins of the locks that a user's attempts, in order of time, lead to, and the state after them. Goes from one long run of failures to the next, not from attempt to attempt."""
    failures, last, until = state
    begins: list[int] = []
    if not len(ts):
        return begins, state
    at = int(np.searchsorted(ts, until, "left")) if until else 0
    # A run: failures beside each other, none long after the one before.
    turn = np.r_[True, (failed[1:] != failed[:-1]) | (failed[1:] & (ts[1:] - ts[:-1] >= forget))]
    starts = np.flatnonzero(turn)
    ends = np.r_[starts[1:], len(ts)]
    failing = failed[starts]
    starts, ends = starts[failing], ends[failing]
    if failures and at < len(ts) and not (failed[at] and ts[at] - last < forget):
        failures = 0
    carried = failures if at < len(ts) else 0
    need = np.maximum(most - np.where((starts <= at) & (at < ends), carried, 0), 1)
    for a, b, n in zip(starts.tolist(), ends.tolist(), need.tolist(), strict=True) if at < len(ts) else ():
        if b - a < n:
            continue
        p = max(a, at)
        while b - p >= n:
            p += n - 1
            begins.append(int(ts[p]))
            until, n = begins[-1] + lock, most
            p = max(p + 1, int(np.searchsorted(ts, until, "left")))
            at = p
    if at >= len(ts):  # all later attempts were turned away, or the last one led to a lock
        return begins, State(0, 0, until) if until > state.until or begins else State(failures, last, until)
    # What is left of the last run is carried on.
    if not failed[-1]:
        return begins, State(0, 0, until)
    a = max(int(starts[-1]), at)
    held = carried if not begins and starts[-1] <= int(np.searchsorted(ts, state.until, "left") if state.until else 0) else 0
    return begins, State(len(ts) - a + held, int(ts[-1]), until)


def locked(attempts: DataFrame, failed: Column, most: int = 5, minutes: int = 30) -> DataFrame:
    """user_id, locked_at, locked_until: every lock. attempts: user_id long, ts, event_id; those of one moment are taken in the order of event_id, those without user or time are left out.

    A user's attempts stream through one task in order, batch by batch, with three numbers kept; they are never held together.
    """
    rows = attempts.where("user_id is not null and ts is not null").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.coalesce(failed, F.lit(False)).alias("failed"))
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "ts", "failed")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, State()
        for batch in batches:
            users = batch.column("user_id").to_numpy()
            ts = batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
            bad = batch.column("failed").to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(users[1:] != users[:-1]) + 1, len(users)] if len(users) else np.zeros(1, int)
            out: list[tuple[int, int]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                state = state if users[a] == user else State()
                user = users[a]
                found, state = locks(ts[a:b], bad[a:b], state, most, minutes * MINUTE)
                out += [(int(user), t) for t in found]
            begun = pa.array([t for _, t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), begun.cast(pa.timestamp("us")), pa.array([t + minutes * MINUTE for _, t in out], pa.int64()).cast(pa.timestamp("us"))], names=["user_id", "locked_at", "locked_until"])

    return dealt.mapInArrow(run, "user_id long, locked_at timestamp_ntz, locked_until timestamp_ntz")
