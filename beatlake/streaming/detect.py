"""Streaming forms of the causal operators: sessions of high values, refractory alarms, beat-window features.

Windows and sessions close by watermark, and rows later than that are dropped.
The stateful operators hold a key's last time (and beats): rows of a batch
are taken in order of time, and those not later than what the key has seen are
dropped. Where `ts` names a timestamp column, the state of a key goes once the
watermark (`late` behind) is `idle` milliseconds beyond its last row; without
it a key's state stays. So batch and stream give the same events where no row
is late and no key comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000


def stateful(rows: DataFrame, key: str, step, out: str, state: str, ts: str | None, late: str) -> DataFrame:
    shape = f"`{key}` {rows.schema[key].dataType.simpleString()}, {out}"
    timed = rows.withWatermark(ts, late) if ts else rows
    return timed.groupBy(key).applyInPandasWithState(step, shape, state, "append", GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout)


def expire(state: GroupState, ts: str | None, idle: int) -> None:
    if ts:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle)


def arrived(frames: Iterator[pd.DataFrame], t: str, seen: float) -> pd.DataFrame:
    """The rows of a batch that are later than what was seen, in order of time."""
    rows = pd.concat(list(frames))
    return rows[rows[t] > seen].sort_values(t, kind="stable")


def session_events(rows: DataFrame, key: str, ts: str, value: str, threshold: float, gap: str, late: str) -> DataFrame:
    """Events of values above a threshold, closed by a gap: start, end, peak and count. `ts` is a timestamp."""
    over = rows.where(F.col(value) > threshold).withWatermark(ts, late)
    g = over.groupBy(key, F.session_window(ts, gap).alias("_w"))
    out = g.agg(F.min(ts).alias("t_start"), F.max(ts).alias("t_end"), F.max(value).alias("peak_value"), F.count("*").alias("n_points"))
    return out.drop("_w", "session_window")


def refractory_alarms(rows: DataFrame, key: str, t: str, value: str, threshold: float, hold: float, ts: str | None = None, late: str = "1 hour", idle: int = DAY_MS) -> DataFrame:
    """Alarms at least `hold` apart; the state of a key is its last alarm and last time."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (float("-inf"), float("-inf"))
        kept, new = [], arrived(frames, t, seen)
        for x, v in zip(new[t], new[value]):
            if v > threshold and x - last >= hold:
                kept.append((k[0], x, v))
                last = x
        state.update((last, max(seen, new[t].max()) if len(new) else seen))
        expire(state, ts, idle)
        yield pd.DataFrame(kept, columns=[key, "t", "value"])

    return stateful(rows, key, step, "t double, value double", "last double, seen double", ts, late)


def beat_features(rows: DataFrame, key: str, t: str, n: int, ts: str | None = None, late: str = "1 hour", idle: int = DAY_MS) -> DataFrame:
    """SD1 and SD2 of the last n intervals at each beat; the state of a key is its last n + 1 beat times."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = list(state.get[0]) if state.exists else []
        new = arrived(frames, t, before[-1] if before else float("-inf"))[t].to_numpy(float)
        beats = np.concatenate([before, new])
        out = []
        if len(beats) > n:
            rr = np.diff(beats) * 1000
            spans = np.lib.stride_tricks.sliding_window_view(rr, n)[len(beats) - n - min(len(new), len(beats) - n) :]
            sd = lambda x: x.std(axis=1, ddof=1) / 2**0.5
            d, s = spans[:, 1:] - spans[:, :-1], spans[:, 1:] + spans[:, :-1]
            out = [(k[0], *row) for row in zip(beats[len(beats) - len(spans) :].tolist(), [n] * len(spans), sd(d).tolist(), sd(s).tolist())]
        state.update((beats[-(n + 1) :].tolist(),))
        expire(state, ts, idle)
        yield pd.DataFrame(out, columns=[key, "t", "n", "sd1", "sd2"])

    return stateful(rows, key, step, "t double, n bigint, sd1 double, sd2 double", "beats array<double>", ts, late)


def tumbling_quality(rows: DataFrame, key: str, ts: str, value: str, length: str, late: str) -> DataFrame:
    """Window statistics of a stream: count, deviation, range."""
    g = rows.withWatermark(ts, late).groupBy(key, F.window(ts, length).alias("_w"))
    out = g.agg(F.count("*").alias("n"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("range"))
    return out.select(key, F.col("_w.start").alias("w_start"), "n", "std", "range")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is now and returns its rows, for tests and backfills of small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
