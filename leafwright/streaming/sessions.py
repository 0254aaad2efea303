"""Streaming sessions: shots by gap and likeness with state, and pure gaps by session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHOTS = "video_id long, i0 long, i1 long, start double, end double, n_frames int, best_score double"
_OPEN = "i0 long, i1 long, start double, end double, n int, score double, sig double"


def stream_shots(frames: DataFrame, gap: float, similar: float) -> DataFrame:
    """frames (video_id, i, t, ok, score, sig), streaming -> shots as they close. The state is the open shot's ends, its
    size and its best frame. A row with ok null ends its video."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [-1, -1, 0.0, 0.0, 0, 0.0, 0.0]
        out = []
        for r in pd.concat(list(parts)).sort_values(["t", "i"], kind="stable").itertuples():
            done = pd.isna(r.ok)
            if now[0] >= 0 and (done or r.t - now[3] > gap or (r.ok and abs(r.sig - now[6]) > similar)):
                out.append((key[0], *now[:6]))
                now[0] = -1
            if not done and r.ok:
                if now[0] < 0:
                    now = [r.i, r.i, r.t, r.t, 0, float("-inf"), 0.0]
                now[1], now[3], now[4] = r.i, r.t, now[4] + 1
                if r.score > now[5]:
                    now[5], now[6] = r.score, r.sig
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOTS.split(", ")])

    return frames.groupBy("video_id").applyInPandasWithState(step, SHOTS, _OPEN, "append", GroupStateTimeout.NoTimeout)


def gap_sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions by gap alone, for batches and streams: (key, start, end, n). Rows later than `late` are dropped by the watermark."""
    w = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
