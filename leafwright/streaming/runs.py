"""Streaming twins of the series operators: still runs and as-of differences with bounded state per video.

Event time is the frame's own time. Sources are ordered; what arrives behind the last frame of its video is
not used but comes out as a row of kind late. A row without motion ends its video, as the last frame of a
file does in a batch: the open run is closed with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import EPS, StillRules

RUNS = "video_id long, kind string, i0 long, i1 long, start double, end double, duration double, short boolean, at_start boolean, at_end boolean"
_STATE = "n long, t double, dt double, i0 long, i1 long, start double, end double"
DIFFS = "video_id long, event_id long, t double, ref_t double, ref_id long, ref_motion double"
_RECENT = "ts array<double>, ids array<long>, motions array<double>"


@dataclass
class _Run:
    """What is known of a video so far: frames, last time and interval, and the open run (i0 < 0: none)."""

    n: int = 0
    t: float = float("-inf")
    dt: float = 0.0
    i0: int = -1
    i1: int = -1
    start: float = 0.0
    end: float = 0.0

    def close(self, rules: StillRules, last: bool = False) -> Iterator[tuple]:
        if self.i0 >= 0:
            at_end = last and self.i1 == self.n - 1
            duration = self.end - self.start + (self.dt if at_end else 0.0)
            if duration >= rules.short:
                yield ("run", self.i0, self.i1, self.start, self.end, duration, duration < rules.min_still, self.i0 == 0, at_end)
        self.i0 = -1

    def take(self, t: float, motion: float | None, threshold: float, rules: StillRules) -> Iterator[tuple]:
        if motion is None or pd.isna(motion):
            yield from self.close(rules, last=True)
            return
        if t < self.t:
            yield ("late", None, None, t, t, 0.0, None, None, None)
            return
        i, self.n = self.n, self.n + 1
        self.dt, self.t = (t - self.t if i else 0.0), t
        apart = self.i0 >= 0 and i > self.i1 + 1 and t - self.end > rules.merge_gap
        if apart:
            yield from self.close(rules)
        if motion < threshold:
            if self.i0 < 0:
                self.i0, self.start = i, t
            self.i1, self.end = i, t


def stream_still_runs(frames: DataFrame, threshold: float, rules: StillRules = StillRules()) -> DataFrame:
    """frames (video_id, event_id, t, motion), streaming -> runs as they close (see operators.series.still_runs), and late rows."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = _Run(*state.get) if state.exists else _Run()
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"], kind="stable")
        out = [(key[0], *x) for t, m in zip(rows["t"], rows["motion"]) for x in run.take(t, m, threshold, rules)]
        state.update((run.n, run.t, run.dt, run.i0, run.i1, run.start, run.end))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])

    return frames.groupBy("video_id").applyInPandasWithState(step, RUNS, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_asof(frames: DataFrame, rules: StillRules = StillRules()) -> DataFrame:
    """frames, streaming -> each frame with its reference (see operators.series.asof_reference). The state is the frames
    since the reference of the last one; frames of one time are known together only within a batch of input."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(zip(*state.get)) if state.exists else []
        out = []
        for r in pd.concat(list(parts)).sort_values(["t", "event_id"], kind="stable").itertuples():
            if recent and r.t < recent[-1][0]:
                continue
            recent.append((r.t, r.event_id, r.motion))
            while len(recent) > 1 and recent[1][0] <= r.t - rules.lag + EPS:
                recent.pop(0)
            out.append((key[0], r.event_id, r.t, *recent[0]))
        state.update(tuple(map(list, zip(*recent))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DIFFS.split(", ")])

    return frames.groupBy("video_id").applyInPandasWithState(step, DIFFS, _RECENT, "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, key: list[str], files: int | None = None):
    """A query that appends each micro-batch to Parquet under its own number: a batch that is run again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
