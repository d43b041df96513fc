"""Streaming twins of batch operators, for data that arrive while they are analysed.

The batch operators have no late data; here a watermark bounds the state that is kept for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "ep long, ts timestamp, change double, kind string"


def counts(issues: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Issues by rule and tumbling window: columns ts and rule."""
    return issues.withWatermark("ts", late).groupBy(F.window("ts", width), "rule").agg(F.count("*").alias("n"))


def segments(moving: DataFrame, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of motion of each episode, closed by a gap: columns ep and ts, one row for each moving frame."""
    out = moving.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "ep").agg(F.count("*").alias("n"))
    return out.select("ep", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ended(state: GroupState, at: int, quiet: int) -> None:
    """Ask to be called when nothing has come for ``quiet`` milliseconds of event time after ``at``."""
    state.setTimeoutTimestamp(max(at + quiet, state.getCurrentWatermarkMs() + 1))


def signal_events(frames: DataFrame, still: float, least: float, late: str = "10 minutes", quiet: int = 3_600_000) -> DataFrame:
    """Runs of one sign of each episode's signal whose change reaches ``least``: columns ep, ts, v.

    The state of an episode is its last value and the run that is under way. Rows of a batch are put in order of time. Once the
    watermark is ``quiet`` milliseconds past an episode's last row, its run is given as it is and its state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sign, change, at = state.get if state.exists else (None, 0, 0.0, 0)
        out = []
        named = lambda ts: (key[0], ts, change, "open" if sign > 0 else "close")
        if state.hasTimedOut:
            if sign and abs(change) >= least:
                out.append(named(pd.Timestamp(at, unit="ms")))
            state.remove()
        else:
            for row in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
                d = 0.0 if last is None else row.v - last
                now = 0 if abs(d) <= still else 1 if d > 0 else -1
                if now != sign:
                    if sign and abs(change) >= least:
                        out.append(named(row.ts))
                    sign, change = now, 0.0
                change += d
                last, at = float(row.v), max(at, int(row.ts.timestamp() * 1000))
            state.update((last, sign, change, at))
            ended(state, at, quiet)
        yield pd.DataFrame(out, columns=["ep", "ts", "change", "kind"])

    return frames.withWatermark("ts", late).groupBy("ep").applyInPandasWithState(step, EVENT, "last double, sign int, change double, at long", "append", GroupStateTimeout.EventTimeTimeout)


def memory(frames: DataFrame, n: int, stride: int, late: str = "10 minutes", quiet: int = 3_600_000) -> DataFrame:
    """Each frame of an episode with the values of the n frames before and at it, ``stride`` apart, oldest first: columns ep, ts, v.

    Before the first frame its value stands. The state holds as many values as the window reaches back.
    """
    reach = (n - 1) * stride

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            held, at = state.get if state.exists else ([], 0)
            held = list(held)
            for row in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
                held = [*held, float(row.v)][-reach - 1 :]
                out.append((key[0], row.ts, [held[max(0, len(held) - 1 - k * stride)] for k in range(n - 1, -1, -1)]))
                at = max(at, int(row.ts.timestamp() * 1000))
            state.update((held, at))
            ended(state, at, quiet)
        yield pd.DataFrame(out, columns=["ep", "ts", "window"])

    return frames.withWatermark("ts", late).groupBy("ep").applyInPandasWithState(step, "ep long, ts timestamp, window array<double>", "held array<double>, at long", "append", GroupStateTimeout.EventTimeTimeout)
