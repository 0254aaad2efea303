"""Queries of the series operators over the table events.

Stand-in data: a user's events are a video's frames, value is motion, props.k is sharpness. The table
spans thirty days, so lags and gaps are hours here and thresholds are in units of value; the operators
are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, select, sequence, series
from ..operators.series import StillRules

HOUR = 3600.0
RULES = StillRules(lag=2 * HOUR, gap_warn=24 * HOUR, merge_gap=4 * HOUR, short=HOUR, min_still=6 * HOUR, dead_motion=12.0, dead_seconds=8 * HOUR,
                   gain=1.0, offset=12.0, low=1.0, high=60.0)
SPACING = 3 * HOUR
SQL_BASE = """ev AS (SELECT user_id AS video_id, event_id, epoch_us(ts) / 1e6 AS t, value AS motion, event_type AS side,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS sharp FROM events),
fr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS frame_idx FROM ev)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = e.select(F.col("user_id").alias("video_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("motion"),
                 F.col("event_type").alias("side"), F.get_json_object("props", "$.k").cast("int").alias("sharp"))
    return series.number_frames(s)


def asof_reference(spark, sf_dir):
    """The frame at least `lag` before each frame, else the first of its video."""
    return series.asof_reference(frames(spark, sf_dir), RULES).select("event_id", "video_id", "t", "ref_t", "ref_id", "ref_motion")


ASOF_REFERENCE = f"""WITH {SQL_BASE},
r AS (SELECT event_id, video_id, t, max(struct_pack(t := t, i := event_id, m := motion)) OVER (PARTITION BY video_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 7199.999999 PRECEDING) AS a,
  first_value(struct_pack(t := t, i := event_id, m := motion)) OVER (PARTITION BY video_id ORDER BY t, event_id) AS f FROM fr)
SELECT event_id, video_id, t, coalesce(a, f).t AS ref_t, coalesce(a, f).i AS ref_id, coalesce(a, f).m AS ref_motion FROM r"""


def forward_motion(spark, sf_dir):
    """The motion of the first frame at least `lag` later."""
    return series.forward_motion(frames(spark, sf_dir), RULES).select("event_id", "forward")


FORWARD_SQL = """(SELECT *, coalesce((min(struct_pack(t := t, i := event_id, m := motion)) OVER (PARTITION BY video_id ORDER BY t RANGE BETWEEN 7199.999999 FOLLOWING AND UNBOUNDED FOLLOWING)).m, 0.0) AS forward FROM fr)"""
FORWARD_MOTION = f"WITH {SQL_BASE} SELECT event_id, forward FROM {FORWARD_SQL}"


def series_gaps(spark, sf_dir):
    """Breaks of more than gap_warn between consecutive frames."""
    return series.series_gaps(frames(spark, sf_dir), RULES)


SERIES_GAPS = f"""WITH {SQL_BASE}, g AS (SELECT video_id, lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) AS start, t AS "end" FROM fr)
SELECT video_id, start, "end" FROM g WHERE "end" - start > 86400"""


def auto_threshold(spark, sf_dir):
    """A4 with W3: noise level without dead runs, and the threshold from it (interpolated, so shown to nine places)."""
    t = series.auto_threshold(frames(spark, sf_dir), RULES)
    return t.withColumns({c: F.bround(c, 9) for c in ("noise", "threshold")})


SQL_THR = f"""{SQL_BASE},
d0 AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM fr WHERE motion < 12.0),
d1 AS (SELECT video_id, min(frame_idx) AS i0, max(frame_idx) AS i1, min(t) AS a, max(t) AS b FROM d0 GROUP BY video_id, g),
dead AS (SELECT * FROM d1 WHERE b - a >= 28800),
mk AS (SELECT fr.*, NOT EXISTS (SELECT 1 FROM dead d WHERE d.video_id = fr.video_id AND fr.frame_idx BETWEEN d.i0 AND d.i1) AS alive FROM fr),
st AS (SELECT video_id, count(*) AS n, count(*) FILTER (NOT alive) AS n_dead, quantile_cont(motion, 0.3) AS pa, quantile_cont(motion, 0.3) FILTER (alive) AS pk FROM mk GROUP BY video_id),
nz AS (SELECT *, CASE WHEN n - n_dead >= 30 THEN pk ELSE pa END AS noise FROM st),
th AS (SELECT video_id, n, n_dead, noise, least(greatest(1.0::DOUBLE * noise + 12.0::DOUBLE, 1.0::DOUBLE), 60.0::DOUBLE) AS threshold FROM nz)"""
AUTO_THRESHOLD = f"WITH {SQL_THR} SELECT video_id, n, n_dead, round_even(noise, 9) AS noise, round_even(threshold, 9) AS threshold FROM th"


def dead_still_runs(spark, sf_dir):
    """Long runs of next to no motion."""
    return series.dead_runs(frames(spark, sf_dir), RULES)


DEAD_STILL_RUNS = f"WITH {SQL_THR} SELECT video_id, i0, i1, a AS start, b AS \"end\" FROM dead"


def _runs(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = series.auto_threshold(f, RULES)
    return t, series.still_runs(f, t, RULES)


def still_runs(spark, sf_dir):
    """Still intervals with their flags."""
    return _runs(frames(spark, sf_dir))[1]


SQL_RUNS = f"""{SQL_THR},
s0 AS (SELECT fr.*, th.threshold, lag(frame_idx) OVER w AS pi, lag(t) OVER w AS pt FROM fr JOIN th USING (video_id) WHERE motion < threshold WINDOW w AS (PARTITION BY fr.video_id ORDER BY t, event_id)),
s1 AS (SELECT *, sum(CASE WHEN pi IS NULL OR (frame_idx > pi + 1 AND t - pt > 14400) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM s0),
s2 AS (SELECT video_id, min(frame_idx) AS i0, max(frame_idx) AS i1, min(t) AS start, max(t) AS "end" FROM s1 GROUP BY video_id, isl),
dl AS (SELECT video_id, t - lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) AS dt, frame_idx FROM fr),
ls AS (SELECT video_id, max(frame_idx) AS last_idx, arg_max(coalesce(dt, 0), frame_idx) AS last_dt FROM dl GROUP BY video_id),
rn0 AS (SELECT s2.*, i1 = last_idx AS at_end, "end" - start + CASE WHEN i1 = last_idx THEN last_dt ELSE 0.0::DOUBLE END AS duration FROM s2 JOIN ls USING (video_id)),
rn AS (SELECT video_id, i0, i1, start, "end", duration, duration < 21600 AS short, i0 = 0 AS at_start, at_end FROM rn0 WHERE duration >= 3600)"""
STILL_RUNS = f"WITH {SQL_RUNS} SELECT * FROM rn"


def still_candidates(spark, sf_dir):
    """Of each run the sharpest frames still both ways, spaced, three at most."""
    f = series.forward_motion(frames(spark, sf_dir), RULES)
    t, runs = _runs(f)
    good = series.both_ways_still(series.run_frames(f, runs), t)
    got = select.spaced_topk(good, ["video_id", "run"], [-F.col("sharp"), F.col("motion"), F.col("frame_idx")], "t", "event_id", SPACING, 3)
    return got.select("video_id", "run", F.size("chosen").alias("n"), F.array_join(F.transform("chosen", lambda c: c["id"].cast("string")), ",").alias("candidates"))


SQL_GOOD = f"""{SQL_RUNS}, fw AS {FORWARD_SQL},
rf AS (SELECT fw.*, rn.i0 AS run, th.threshold FROM fw JOIN rn ON fw.video_id = rn.video_id AND fw.frame_idx BETWEEN rn.i0 AND rn.i1 JOIN th ON th.video_id = fw.video_id WHERE motion < threshold),
gd AS (SELECT * FROM (SELECT *, bool_or(forward < threshold) OVER (PARTITION BY video_id, run) AS some_both FROM rf) WHERE forward < threshold OR NOT some_both)"""
STILL_CANDIDATES = f"""WITH RECURSIVE {SQL_GOOD},
od AS (SELECT *, row_number() OVER (PARTITION BY video_id, run ORDER BY -sharp, motion, frame_idx) AS rk FROM gd),
pick AS (
  SELECT video_id, run, rk, [t] AS ts, [event_id] AS ids FROM od WHERE rk = 1
  UNION ALL
  SELECT o.video_id, o.run, o.rk, CASE WHEN ok THEN list_append(ts, o.t) ELSE ts END, CASE WHEN ok THEN list_append(ids, o.event_id) ELSE ids END
  FROM (SELECT o.*, p.ts, p.ids, len(p.ids) < 3 AND len(list_filter(p.ts, lambda x: abs(x - o.t) < 10800)) = 0 AS ok
        FROM pick p JOIN od o ON o.video_id = p.video_id AND o.run = p.run AND o.rk = p.rk + 1) o)
SELECT video_id, run, CAST(len(ids) AS INTEGER) AS n, array_to_string(ids, ',') AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY video_id, run ORDER BY rk DESC) AS z FROM pick) WHERE z = 1"""


def blur_flags(spark, sf_dir):
    """Best sharpness of each run against the median of its video."""
    f = frames(spark, sf_dir)
    t, runs = _runs(f)
    best = series.run_frames(f, runs).join(t.select("video_id", "threshold"), "video_id").where("motion < threshold").groupBy("video_id", "run").agg(F.max("sharp").alias("sharp"))
    return series.blur_flags(best)


BLUR_FLAGS = f"""WITH {SQL_RUNS},
b AS (SELECT fr.video_id, rn.i0 AS run, max(sharp) AS sharp FROM fr JOIN rn ON fr.video_id = rn.video_id AND fr.frame_idx BETWEEN rn.i0 AND rn.i1 JOIN th ON th.video_id = fr.video_id WHERE motion < threshold GROUP BY 1, 2),
m AS (SELECT video_id, median(sharp) AS median_sharp FROM b GROUP BY video_id)
SELECT video_id, run, sharp, median_sharp, sharp < 0.35::DOUBLE * median_sharp AS blur FROM b JOIN m USING (video_id)"""


def nearest_frame(spark, sf_dir):
    """For the middle of each run, the nearest frame of the video; the earlier on ties."""
    f = frames(spark, sf_dir)
    q = _runs(f)[1].select("video_id", F.col("i0").alias("run"), ((F.col("start") + F.col("end")) / 2).alias("at"))
    return evaluate.nearest_asof(q, f.select("video_id", "t", "event_id"), "video_id", "at", "t", "event_id")


NEAREST_FRAME = f"""WITH {SQL_RUNS}, q AS (SELECT video_id, i0 AS run, (start + "end") / 2 AS "at" FROM rn)
SELECT q.video_id, q.run, q."at", arg_min(fr.event_id, struct_pack(d := abs(fr.t - q."at"), t := fr.t, i := fr.event_id)) AS event_id,
  min(struct_pack(d := abs(fr.t - q."at"), t := fr.t, i := fr.event_id)).t AS t
FROM q JOIN fr ON q.video_id = fr.video_id GROUP BY 1, 2, 3"""


def step_frame(spark, sf_dir):
    """From the nearest frame, three frames on, clamped to the ends of the video."""
    f = frames(spark, sf_dir)
    q = _runs(f)[1].select("video_id", F.col("i0").alias("run"), ((F.col("start") + F.col("end")) / 2).alias("at"))
    return evaluate.step_frames(q, f.select("video_id", "t", "event_id", "frame_idx"), 3)


STEP_FRAME = f"""WITH {SQL_RUNS}, q AS (SELECT video_id, i0 AS run, (start + "end") / 2 AS "at" FROM rn),
n AS (SELECT q.video_id, q.run, arg_min(fr.frame_idx, struct_pack(d := abs(fr.t - q."at"), t := fr.t, i := fr.event_id)) AS i FROM q JOIN fr ON q.video_id = fr.video_id GROUP BY 1, 2),
e AS (SELECT video_id, max(frame_idx) AS last_idx FROM fr GROUP BY 1)
SELECT n.video_id, n.run, fr.event_id, fr.t FROM n JOIN e USING (video_id) JOIN fr ON fr.video_id = n.video_id AND fr.frame_idx = least(greatest(n.i + 3, 0), last_idx)"""


def point_in_interval(spark, sf_dir):
    """The first run that each purchase falls in."""
    f = frames(spark, sf_dir)
    runs = _runs(f)[1].select("video_id", F.col("i0").alias("gt"), F.col("start").alias("a"), F.col("end").alias("b"))
    return evaluate.first_interval(f.where("side = 'purchase'").select("video_id", "event_id", "t"), runs, 24 * HOUR)


POINT_IN_INTERVAL = f"""WITH {SQL_RUNS}
SELECT fr.video_id, fr.event_id, fr.t, min(rn.i0) AS gt FROM fr LEFT JOIN rn ON fr.video_id = rn.video_id AND fr.t BETWEEN rn.start AND rn."end" WHERE fr.side = 'purchase' GROUP BY 1, 2, 3"""


def interval_overlap(spark, sf_dir):
    """Pairs of a run and a day (closed intervals) that overlap, per video."""
    f = frames(spark, sf_dir)
    runs = _runs(f)[1].select("video_id", F.col("i0").alias("run"), "start", "end")
    return evaluate.bucket_overlap(runs, 24 * HOUR)


INTERVAL_OVERLAP = f"""WITH {SQL_RUNS}
SELECT video_id, i0 AS run, b AS bucket, least("end", (b + 1) * 86400.0) - greatest(start, b * 86400.0) AS seconds
FROM (SELECT *, unnest(range(CAST(floor(start / 86400) AS BIGINT), CAST(floor("end" / 86400) AS BIGINT) + 1)) AS b FROM rn)"""


def interval_join(spark, sf_dir):
    """The stretches of two or more hours between purchases of a video against its runs: open overlaps."""
    f = frames(spark, sf_dir)
    runs = _runs(f)[1].select("video_id", F.col("i0").alias("run"), "start", "end")
    p = f.where("side = 'purchase'").select("video_id", F.lag("t").over(series.by_time()).alias("start"), F.col("t").alias("end")).where(F.col("end") - F.col("start") >= 2 * HOUR)
    return evaluate.overlapping(runs, p, 24 * HOUR, closed=False).select("video_id", "run", F.col("r_start").alias("since"), (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("seconds"))


INTERVAL_JOIN = f"""WITH {SQL_RUNS},
p AS (SELECT video_id, lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) AS s, t AS e FROM fr WHERE side = 'purchase')
SELECT rn.video_id, rn.i0 AS run, p.s AS since, least(rn."end", p.e) - greatest(rn.start, p.s) AS seconds
FROM rn JOIN p ON rn.video_id = p.video_id AND p.e - p.s >= 7200 AND greatest(rn.start, p.s) < least(rn."end", p.e)"""


def recall_buckets(spark, sf_dir):
    """Which runs have a purchase in them, by length of the run."""
    f = frames(spark, sf_dir)
    runs = _runs(f)[1].select("video_id", F.col("i0").alias("gt"), F.col("start").alias("a"), F.col("end").alias("b"))
    return evaluate.recall_by_length(runs, f.where("side = 'purchase'").select("video_id", "t"), [8 * HOUR, 16 * HOUR, 32 * HOUR], 24 * HOUR)


RECALL_BUCKETS = f"""WITH {SQL_RUNS},
h AS (SELECT rn.video_id, rn.i0, any_value("end" - start) AS len, count(fr.event_id) AS hits FROM rn LEFT JOIN fr ON fr.video_id = rn.video_id AND fr.side = 'purchase' AND fr.t BETWEEN rn.start AND rn."end" GROUP BY 1, 2)
SELECT CAST(CASE WHEN len < 28800 THEN 0 WHEN len < 57600 THEN 1 WHEN len < 115200 THEN 2 ELSE 3 END AS INTEGER) AS bucket, count(*) AS n, count(*) FILTER (hits > 0) AS found, count(*) FILTER (hits > 1) AS duplicates FROM h GROUP BY 1"""


def evaluation_totals(spark, sf_dir):
    """Purchases (adoptions) against runs (truth): recall, false rate, near-boundary, duplicates."""
    f = frames(spark, sf_dir)
    runs = _runs(f)[1].select("video_id", F.col("i0").alias("gt"), F.col("start").alias("a"), F.col("end").alias("b"))
    return evaluate.adoption_totals(runs, f.where("side = 'purchase'").select("video_id", "event_id", "t"), 2 * HOUR, 24 * HOUR)


EVALUATION_TOTALS = f"""WITH {SQL_RUNS},
p AS (SELECT video_id, event_id, t FROM fr WHERE side = 'purchase'),
w AS (SELECT p.video_id, p.event_id, min(i0) FILTER (p.t BETWEEN rn.start AND rn."end") AS gt, min(least(abs(p.t - rn.start), abs(p.t - rn."end"))) AS dist FROM p LEFT JOIN rn ON p.video_id = rn.video_id GROUP BY 1, 2),
k AS (SELECT video_id, gt, count(*) AS c FROM w WHERE gt IS NOT NULL GROUP BY 1, 2)
SELECT (SELECT count(*) FROM rn) AS gt_intervals, (SELECT count(*) FROM k) AS found, (SELECT count(*) FROM k) / (SELECT count(*) FROM rn)::DOUBLE AS recall,
  (SELECT count(*) FROM w) AS included, (SELECT count(*) FROM w WHERE gt IS NULL) AS false_adoptions, (SELECT count(*) FROM w WHERE gt IS NULL AND dist <= 7200) AS near_boundary,
  (SELECT count(*) FROM k WHERE c > 1) AS duplicates"""


def repetition_split(spark, sf_dir):
    """Week number and time within the week."""
    f = frames(spark, sf_dir)
    start = 1_704_067_200.0
    return evaluate.split_repetitions(f.select("event_id", (F.col("t") - start).alias("t")), 7 * 24 * HOUR)


REPETITION_SPLIT = f"""WITH {SQL_BASE} SELECT event_id, CAST(floor((t - 1704067200.0::DOUBLE) / 604800.0::DOUBLE) AS BIGINT) AS rep,
  (t - 1704067200.0::DOUBLE) - floor((t - 1704067200.0::DOUBLE) / 604800.0::DOUBLE) * 604800.0::DOUBLE AS local FROM ev"""


def greedy_band_match(spark, sf_dir):
    """Within each week, the first week's events of a user matched one to one with the nearest unused event
    of the same kind within six hours. Sequential, so no SQL: held against a plain loop in the tests."""
    f = frames(spark, sf_dir)
    rep = evaluate.split_repetitions(f.select("video_id", "event_id", "side", (F.col("t") - 1_704_067_200.0).alias("t")), 7 * 24 * HOUR)
    return evaluate.greedy_band_match(rep.where("rep = 0"), rep, 6 * HOUR)


def band_mapping(spark, sf_dir):
    """For each later event, the last (by id) event of the first week within an hour of it in the week."""
    f = frames(spark, sf_dir)
    rep = evaluate.split_repetitions(f.select("video_id", "event_id", "side", (F.col("t") - 1_704_067_200.0).alias("t")), 7 * 24 * HOUR)
    return evaluate.band_mapping(rep.where("rep = 0"), rep.where("rep > 0"), HOUR)


BAND_MAPPING = f"""WITH {SQL_BASE},
r AS (SELECT video_id, event_id, side, CAST(floor((t - 1704067200.0::DOUBLE) / 604800.0::DOUBLE) AS BIGINT) AS rep, (t - 1704067200.0::DOUBLE) - floor((t - 1704067200.0::DOUBLE) / 604800.0::DOUBLE) * 604800.0::DOUBLE AS local FROM ev)
SELECT x.event_id, max(b.event_id) AS base_id FROM r x JOIN r b ON b.rep = 0 AND x.rep > 0 AND b.video_id = x.video_id AND b.side = x.side AND abs(b.local - x.local) < 3600 GROUP BY 1"""


def dedupe_chain(spark, sf_dir):
    """Consecutive duplicates among runs. Inliers stand in: 200 less 12 for each step of difference in
    best sharpness. Sequential, so no SQL: held against a plain loop in the tests."""
    f = frames(spark, sf_dir)
    _, runs = _runs(f)
    best = series.run_frames(f, runs).groupBy("video_id", "run").agg(F.max("sharp").alias("sharp"), F.count("*").alias("n"))
    r = runs.join(best.withColumnRenamed("video_id", "v"), (F.col("video_id") == F.col("v")) & (F.col("i0") == F.col("run")))
    seg = r.select("video_id", F.col("i0").alias("segment_id"), "start", "duration", (~F.col("short")).alias("include"), F.least("n", F.lit(3)).alias("n_candidates"), (F.col("n") * 40).alias("keypoints"), "sharp")
    return sequence.dedupe_chain(seg, lambda c, i, j: max(0, 200 - 12 * abs(int(c["sharp"][i]) - int(c["sharp"][j]))))


def session_plan(spark, sf_dir):
    """Shots by gap and likeness to the best frame. Sequential, so no SQL."""
    f = frames(spark, sf_dir).select("video_id", F.col("frame_idx").alias("i"), "t", (F.col("side") != "error").alias("ok"), F.col("sharp").cast("double").alias("score"), (F.col("sharp") / 1000).alias("skin"), F.col("motion").alias("sig"))
    return sequence.session_plan(f, 12 * HOUR, 40.0, HOUR, SPACING)


def longest_runs(spark, sf_dir):
    """Of each video the five longest runs that are not short."""
    r = _runs(frames(spark, sf_dir))[1].where("not short")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("duration"), "i0"))
    return r.withColumn("rank", n).where("rank <= 5").select("video_id", "rank", "i0", "duration")


LONGEST_RUNS = f"""WITH {SQL_RUNS} SELECT video_id, CAST(rank AS INTEGER) AS rank, i0, duration FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY duration DESC, i0) AS rank FROM rn WHERE NOT short) WHERE rank <= 5"""


def segment_union(spark, sf_dir):
    """Runs and unreadable gaps as one list of segments, numbered in order of start."""
    from pyspark.sql import Window

    f = frames(spark, sf_dir)
    runs = _runs(f)[1].select("video_id", "start", "end", F.lit("still").alias("kind"))
    both = runs.unionByName(series.series_gaps(f, RULES).withColumn("kind", F.lit("unreadable")))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end", "kind"))
    return both.withColumn("segment", F.format_string("s%04d", n))


SEGMENT_UNION = f"""WITH {SQL_RUNS}, g AS (SELECT video_id, lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) AS start, t AS "end" FROM fr),
u AS (SELECT video_id, start, "end", 'still' AS kind FROM rn UNION ALL SELECT video_id, start, "end", 'unreadable' FROM g WHERE "end" - start > 86400)
SELECT *, 's' || lpad(CAST(row_number() OVER (PARTITION BY video_id ORDER BY start, "end", kind) AS VARCHAR), 4, '0') AS segment FROM u"""


def event_summary(spark, sf_dir):
    """Per kind, last minus first, count and the most at once in an hour."""
    return evaluate.stage_summary(frames(spark, sf_dir).select(F.col("side").alias("stage"), "t"), HOUR)


EVENT_SUMMARY = f"""WITH {SQL_BASE}, h AS (SELECT side, floor(t / 3600.0) AS b, count(*) AS c FROM ev GROUP BY 1, 2)
SELECT e.side AS stage, max(t) - min(t) AS seconds, count(*) AS n, (SELECT max(c) FROM h WHERE h.side = e.side) AS peak FROM ev e GROUP BY 1"""

QUERIES = {f.__name__: f for f in (asof_reference, forward_motion, series_gaps, auto_threshold, dead_still_runs, still_runs, still_candidates, blur_flags, nearest_frame,
                                   step_frame, point_in_interval, interval_overlap, interval_join, recall_buckets, evaluation_totals, repetition_split, greedy_band_match, band_mapping,
                                   dedupe_chain, session_plan, longest_runs, segment_union, event_summary)}
SQL = {"asof_reference": ASOF_REFERENCE, "forward_motion": FORWARD_MOTION, "series_gaps": SERIES_GAPS, "auto_threshold": AUTO_THRESHOLD, "dead_still_runs": DEAD_STILL_RUNS,
       "still_runs": STILL_RUNS, "still_candidates": STILL_CANDIDATES, "blur_flags": BLUR_FLAGS, "nearest_frame": NEAREST_FRAME, "step_frame": STEP_FRAME,
       "point_in_interval": POINT_IN_INTERVAL, "interval_overlap": INTERVAL_OVERLAP, "interval_join": INTERVAL_JOIN, "recall_buckets": RECALL_BUCKETS, "evaluation_totals": EVALUATION_TOTALS,
       "repetition_split": REPETITION_SPLIT, "band_mapping": BAND_MAPPING, "longest_runs": LONGEST_RUNS, "segment_union": SEGMENT_UNION, "event_summary": EVENT_SUMMARY}
