"""Ordered series: as-of references, adaptive thresholds, gaps and islands.

A series is a DataFrame with the columns video_id, t (seconds, double), motion (double) and an id column
that makes the order total. All windows are partitioned by video_id; a video is the unit of order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


@dataclass(frozen=True)
class StillRules:
    """The reference values; other data need other units of motion and time."""

    lag: float = 0.2  # an as-of reference is this much older
    gap_warn: float = 1.0
    merge_gap: float = 0.12
    short: float = 0.25  # shorter runs are dropped
    min_still: float = 0.5
    dead_motion: float = 0.5
    dead_seconds: float = 60.0
    keep_least: int = 30  # samples that must remain for dead runs to be left out
    gain: float = 3.0
    offset: float = 0.6
    low: float = 1.0
    high: float = 5.0
    empty: float = 1.5


def by_time(*more: str, id_col: str = "event_id"):
    return Window.partitionBy("video_id").orderBy("t", id_col, *more)


def number_frames(series: DataFrame, id_col: str = "event_id") -> DataFrame:
    """frame_idx from 0 in time order."""
    return series.withColumn("frame_idx", F.row_number().over(by_time(id_col=id_col)) - 1)


def asof_reference(series: DataFrame, rules: StillRules = StillRules(), id_col: str = "event_id") -> DataFrame:
    """Adds ref_t and ref_motion: the latest frame that is at least `lag` older, else the first of the video."""
    past = f"over (partition by video_id order by t range between unbounded preceding and {rules.lag - EPS!r}d preceding)"
    first = Window.partitionBy("video_id").orderBy("t", id_col)
    frame = F.struct("t", F.col(id_col).alias("i"), F.col("motion").alias("m"))
    s = series.withColumns({"__ref": F.expr(f"max(struct(t, `{id_col}` as i, motion as m)) {past}"), "__first": F.first(frame).over(first)})
    ref = F.coalesce("__ref", "__first")
    return s.withColumns({"ref_t": ref["t"], "ref_id": ref["i"], "ref_motion": ref["m"]}).drop("__ref", "__first")


def forward_motion(series: DataFrame, rules: StillRules = StillRules(), id_col: str = "event_id") -> DataFrame:
    """Adds forward: the motion of the first frame at least `lag` later, 0 where there is none."""
    # from the end backwards: a running minimum, where a frame up to the end would be gone through again for each row
    ahead = f"over (partition by video_id order by t desc range between unbounded preceding and {rules.lag - EPS!r}d preceding)"
    nxt = F.expr(f"min(struct(t, `{id_col}` as i, motion as m)) {ahead}")
    return series.withColumn("forward", F.coalesce(nxt["m"], F.lit(0.0)))


def series_gaps(series: DataFrame, rules: StillRules = StillRules(), id_col: str = "event_id") -> DataFrame:
    """(video_id, start, end) of consecutive frames more than gap_warn apart."""
    s = series.select("video_id", F.lag("t").over(by_time(id_col=id_col)).alias("start"), F.col("t").alias("end"))
    return s.where(F.col("end") - F.col("start") > rules.gap_warn)


def _islands(rows: DataFrame, new: Column, id_col: str) -> DataFrame:
    return rows.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(by_time(id_col=id_col).rowsBetween(Window.unboundedPreceding, 0)))


def dead_runs(frames: DataFrame, rules: StillRules = StillRules(), id_col: str = "event_id") -> DataFrame:
    """(video_id, i0, i1, start, end): contiguous frames below dead_motion for dead_seconds or more."""
    low = frames.where(F.col("motion") < rules.dead_motion)
    low = low.withColumn("__prev", F.lag("frame_idx").over(by_time(id_col=id_col)))
    runs = _islands(low, F.col("__prev").isNull() | (F.col("frame_idx") > F.col("__prev") + 1), id_col)
    runs = runs.groupBy("video_id", "island").agg(F.min("frame_idx").alias("i0"), F.max("frame_idx").alias("i1"), F.min("t").alias("start"), F.max("t").alias("end"))
    return runs.where(F.col("end") - F.col("start") >= rules.dead_seconds).drop("island")


def auto_threshold(frames: DataFrame, rules: StillRules = StillRules(), id_col: str = "event_id") -> DataFrame:
    """(video_id, n, n_dead, noise, threshold). noise is the exact 30th percentile of motion, without long dead
    runs if at least keep_least frames remain; threshold = clip(gain * noise + offset, low, high)."""
    dead = dead_runs(frames, rules, id_col).select(F.col("video_id").alias("v"), "i0", "i1")
    marked = frames.join(dead, (F.col("video_id") == F.col("v")) & F.col("frame_idx").between(F.col("i0"), F.col("i1")), "left")
    marked = marked.withColumn("alive", F.col("v").isNull())
    stats = marked.groupBy("video_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("alive")).alias("n_dead"),
        F.percentile("motion", 0.3).alias("p_all"), F.percentile(F.when(F.col("alive"), F.col("motion")), 0.3).alias("p_alive"))
    noise = F.when(F.col("n") - F.col("n_dead") >= rules.keep_least, F.col("p_alive")).otherwise(F.col("p_all"))
    level = F.coalesce(F.least(F.greatest(F.lit(rules.gain) * F.col("noise") + rules.offset, F.lit(rules.low)), F.lit(rules.high)), F.lit(rules.empty))
    return stats.withColumn("noise", noise).select("video_id", "n", "n_dead", "noise", level.alias("threshold"))


def still_islands(frames: DataFrame, thresholds: DataFrame, rules: StillRules = StillRules(), id_col: str = "event_id") -> DataFrame:
    """The still frames (motion below the threshold) with the number of their run in `island`.

    A run goes on while frames are contiguous, however far apart, or while the break between two still
    frames is at most merge_gap."""
    still = frames.join(thresholds.select("video_id", "threshold"), "video_id").where("motion < threshold")
    w = by_time(id_col=id_col)
    still = still.withColumns({"__i": F.lag("frame_idx").over(w), "__t": F.lag("t").over(w)})
    new = F.col("__i").isNull() | ((F.col("frame_idx") > F.col("__i") + 1) & (F.col("t") - F.col("__t") > rules.merge_gap))
    return _islands(still, new, id_col).drop("__i", "__t")


def still_runs(frames: DataFrame, thresholds: DataFrame, rules: StillRules = StillRules(), id_col: str = "event_id") -> DataFrame:
    """(video_id, i0, i1, start, end, duration, short, at_start, at_end).

    A run that ends on the last frame is longer by the last frame interval; runs shorter than `short` are
    dropped, runs shorter than min_still marked short. at_start and at_end tell whether a run touches an
    edge of the video: short runs are adopted only there."""
    w = by_time(id_col=id_col)
    last = frames.withColumn("dt", F.col("t") - F.lag("t").over(w)).groupBy("video_id").agg(
        F.max("frame_idx").alias("last_idx"), F.max_by(F.coalesce("dt", F.lit(0.0)), "frame_idx").alias("last_dt"))
    runs = still_islands(frames, thresholds, rules, id_col).groupBy("video_id", "island").agg(
        F.min("frame_idx").alias("i0"), F.max("frame_idx").alias("i1"), F.min("t").alias("start"), F.max("t").alias("end"))
    runs = runs.join(last, "video_id")
    at_end = F.col("i1") == F.col("last_idx")
    runs = runs.withColumn("duration", F.col("end") - F.col("start") + F.when(at_end, F.col("last_dt")).otherwise(0.0))
    runs = runs.where(F.col("duration") >= rules.short)
    return runs.select("video_id", "i0", "i1", "start", "end", "duration", (F.col("duration") < rules.min_still).alias("short"),
                       (F.col("i0") == 0).alias("at_start"), at_end.alias("at_end"))


def run_frames(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """The frames of each run, with its i0 as run."""
    r = runs.select(F.col("video_id").alias("v"), "i0", "i1")
    return frames.join(r, (F.col("video_id") == F.col("v")) & F.col("frame_idx").between(F.col("i0"), F.col("i1"))).withColumn("run", F.col("i0")).drop("v", "i0", "i1")


def both_ways_still(frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Frames of runs (columns run, forward) that are still backward and forward; where a run has none of
    those, the ones that are still backward."""
    f = frames.join(thresholds.select("video_id", "threshold"), "video_id").where("motion < threshold")
    both = F.col("forward") < F.col("threshold")
    any_both = F.max(both).over(Window.partitionBy("video_id", "run"))
    return f.withColumn("__any", any_both).where(both | ~F.col("__any")).drop("__any", "threshold")


def blur_flags(best: DataFrame, ratio: float = 0.35) -> DataFrame:
    """best (video_id, run, sharp): adds median_sharp over the video's runs, and blur: below ratio of it."""
    w = Window.partitionBy("video_id")
    return best.withColumn("median_sharp", F.median("sharp").over(w)).withColumn("blur", F.col("sharp") < ratio * F.col("median_sharp"))
