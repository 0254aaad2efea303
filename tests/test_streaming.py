"""Stop and restart give what one run gives, and both give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from leafwright.operators import sequence, series
from leafwright.operators.series import StillRules
from leafwright.streaming import runs, sessions

SCHEMA = "video_id long, event_id long, t double, motion double"


def data():
    rng = random.Random(3)
    rows = []
    for v in range(4):
        t = 0.0
        for i in range(150):
            t = round(t + rng.choice([0.03, 0.05, 0.1, 0.4]), 6)
            rows.append((v, v * 1000 + i, t, 0.2 if rng.random() < 0.8 else 9.0))
    return rows


def play(spark, make, files, tmp, restart):
    """Lands the files one by one, and starts the query anew for each if restart."""
    land, out, check = (f"{tmp}/{n}" for n in ("land", "out", "check"))
    for n, (rows, schema) in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        if restart or n == len(files) - 1:
            s = spark.readStream.schema(files[0][1]).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(land)
            q, key = make(s)
            q = runs.write_once(q, out, check, key)
            q.awaitTermination(120)
            assert q.exception() is None
    return spark.read.parquet(out).drop("batch").collect()


@pytest.mark.parametrize("restart", [False, True])
def test_still_runs(spark, tmp_path, restart):
    rows = data()
    end = [(v, 10**6, 1e9, None) for v in range(4)]
    files = [([r for r in rows if r[1] % 1000 < 60], SCHEMA), ([r for r in rows if 60 <= r[1] % 1000 < 61], SCHEMA), ([r for r in rows if r[1] % 1000 >= 61] , SCHEMA), ([(0, 5, 0.01, 0.2)] + end, SCHEMA)]
    got = play(spark, lambda s: (runs.stream_still_runs(s, 1.0), ["video_id", "kind", "i0", "start"]), files, tmp_path, restart)
    f = series.number_frames(spark.createDataFrame(rows, SCHEMA))
    t = spark.createDataFrame([(v, 1.0) for v in range(4)], "video_id long, threshold double")
    key = lambda r: (r.video_id, r.i0, r.i1, round(r.duration, 6), r.short, r.at_start, r.at_end)
    assert sorted(key(r) for r in got if r.kind == "run") == sorted(key(r) for r in series.still_runs(f, t, StillRules()).collect())
    assert [(r.video_id, r.start) for r in got if r.kind == "late"] == [(0, 0.01)]


def test_asof(spark, tmp_path):
    rows = data()
    files = [([r for r in rows if r[1] % 1000 < 77], SCHEMA), ([r for r in rows if r[1] % 1000 >= 77], SCHEMA)]
    got = play(spark, lambda s: (runs.stream_asof(s), ["event_id"]), files, tmp_path, True)
    want = series.asof_reference(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.event_id: r.ref_id for r in got} == {r.event_id: r.ref_id for r in want}


def test_shots(spark, tmp_path):
    rng = random.Random(5)
    schema = "video_id long, i long, t double, ok boolean, score double, sig double"
    rows = [(v, i, i * 0.2, rng.random() < 0.7, rng.random(), float(rng.randint(0, 2))) for v in range(3) for i in range(120)]
    files = [([r for r in rows if r[1] < 50], schema), ([r for r in rows if r[1] >= 50] + [(v, 999, 1e9, None, 0.0, 0.0) for v in range(3)], schema)]
    got = play(spark, lambda s: (sessions.stream_shots(s, 0.6, 1.0), ["video_id", "i0"]), files, tmp_path, True)
    for v in range(3):
        want = sequence.group_shots([{"i": i, "t": t, "ok": ok, "score": s, "sig": g} for w, i, t, ok, s, g in rows if w == v], 0.6, lambda a, b: abs(a["sig"] - b["sig"]) <= 1.0)
        assert sorted((r.i0, r.i1, r.n_frames) for r in got if r.video_id == v) == sorted((g[0]["i"], g[-1]["i"], len(g)) for g in want)


def test_gap_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:01:00")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in sessions.gap_sessions(df, "t", "k", "10 seconds", "1 minute").collect()) == [1, 2]
