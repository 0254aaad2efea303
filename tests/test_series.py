"""Series operators: the reference's cases as data, and twins in plain loops."""

import random
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafwright.operators import evaluate, select, sequence, series
from leafwright.operators.series import StillRules

ONE = StillRules(min_still=0.5)


def frames(spark, *videos, fps=30.0):
    rows = [(v, v * 1_000_000 + i, i / fps, float(m), float(s)) for v, (motion, sharp) in enumerate(videos) for i, (m, s) in enumerate(zip(motion, sharp))]
    return series.number_frames(spark.createDataFrame(rows, "video_id long, event_id long, t double, motion double, sharp double"))


def flat(motion):
    return motion, [1.0] * len(motion)


def level(spark, n, x=1.0):
    return spark.createDataFrame([(v, x) for v in range(n)], "video_id long, threshold double")


def runs(spark, *videos, fps=30.0):
    f = frames(spark, *map(flat, videos), fps=fps)
    got = {}
    for r in series.still_runs(f, level(spark, len(videos)), ONE).orderBy("video_id", "i0").collect():
        got.setdefault(r.video_id, []).append(r)
    return [got.get(v, []) for v in range(len(videos))]


def test_run_cases(spark):
    two, short, glitch, none = runs(spark, [0.2] * 30 + [10] * 15 + [0.2] * 27, [10] * 10 + [0.2] * 10 + [10] * 10, [0.2] * 20 + [5.0] + [0.2] * 20, [10] * 30)
    assert len(two) == 2 and two[0].start == 0.0 and two[1].i1 == 71 and not any(r.short for r in two)
    assert two[0].at_start and not two[0].at_end and two[1].at_end
    assert len(short) == 1 and short[0].short
    assert len(glitch) == 1 and (glitch[0].i0, glitch[0].i1) == (0, 40)
    assert none == []


@pytest.mark.parametrize("fps", [24.0, 30.0, 60.0])
def test_runs_do_not_depend_on_the_frame_rate(spark, fps):
    n = int(fps)
    assert len(runs(spark, [0.2] * n + [10] * n + [0.2] * n, fps=fps)[0]) == 2


def test_thresholds(spark):
    dead = [2.3] * 1800 + [0.05] * 9000 + [2.3] * 1800
    f = frames(spark, flat([0.05] * 100), flat([10.0] * 100), flat(dead), flat([2.3] * 3600), flat([2.3] * 1800 + [0.05] * 300 + [2.3] * 1800))
    got = {r.video_id: r for r in series.auto_threshold(f).collect()}
    assert 1 <= got[0].threshold <= 5 and got[1].threshold == 5.0
    assert got[2].threshold == got[3].threshold and got[2].n_dead == 9000 and got[4].n_dead == 0
    assert abs(got[4].noise - np.percentile([2.3] * 3600 + [0.05] * 300, 30)) < 1e-12


def test_candidates(spark):
    f = frames(spark, ([0.2] * 30, np.linspace(1, 2, 30)))
    got = select.spaced_topk(f.withColumn("run", F.lit(0)), ["video_id", "run"], [-F.col("sharp"), F.col("motion"), F.col("frame_idx")], "t", "event_id", 0.15, 3).first().chosen
    assert got[0].id == 29 and len(got) == 3
    assert all(abs(a.t - b.t) >= 0.15 for i, a in enumerate(got) for b in got[:i])


def loop_runs(t, still, merge, shortest):
    out = []
    for i in range(len(t)):
        if still[i]:
            if out and (out[-1][1] == i - 1 or t[i] - t[out[-1][1]] <= merge):
                out[-1][1] = i
            else:
                out.append([i, i])
    kept = []
    for a, b in out:
        d = t[b] - t[a] + (t[-1] - t[-2] if b == len(t) - 1 and len(t) > 1 else 0)
        if d >= shortest:
            kept.append((a, b))
    return kept


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from([0.03, 0.05, 0.11, 0.5, 1.5]), st.booleans()), min_size=1, max_size=60), min_size=1, max_size=12))
def test_runs_equal_a_loop(spark, videos):
    rows, want = [], {}
    for v, steps in enumerate(videos):
        t = np.cumsum([s for s, _ in steps]).tolist()
        rows += [(v, i, x, 0.2 if s else 9.0) for i, (x, (_, s)) in enumerate(zip(t, steps))]
        want[v] = loop_runs(t, [s for _, s in steps], 0.12, 0.25)
    f = series.number_frames(spark.createDataFrame(rows, "video_id long, event_id long, t double, motion double"))
    got = {v: [] for v in want}
    for r in series.still_runs(f, level(spark, len(videos)), ONE).orderBy("i0").collect():
        got[r.video_id].append((r.i0, r.i1))
    assert got == want


def test_references_equal_a_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for v in range(5):
        t = np.cumsum([rng.choice([0.033, 0.05, 0.1, 0.2, 0.9]) for _ in range(60)]).round(6).tolist()
        rows += [(v, v * 100 + i, x, float(i)) for i, x in enumerate(t)]
        for i, x in enumerate(t):
            back = [j for j in range(len(t)) if t[j] <= x - 0.2 + 1e-6]
            ahead = [j for j in range(len(t)) if t[j] >= x + 0.2 - 1e-6]
            want[v * 100 + i] = (v * 100 + (back[-1] if back else 0), float(ahead[0]) if ahead else 0.0)
    s = spark.createDataFrame(rows, "video_id long, event_id long, t double, motion double")
    a = {r.event_id: r.ref_id for r in series.asof_reference(s).collect()}
    b = {r.event_id: r.forward for r in series.forward_motion(s).collect()}
    assert {k: (a[k], b[k]) for k in want} == want


def test_dedupe_chain(spark):
    def seg(i, sig, dur, kp=500, cands=3, include=True):
        return (0, i, float(i), float(dur), include, cands, kp, sig)

    rows = [seg(0, 0, 2), seg(1, 1, 3), seg(2, 1, 3), seg(3, 9, 1), seg(4, 9, 1, kp=10), seg(5, 15, 1), seg(6, 15, 9, cands=0)]
    df = spark.createDataFrame(rows, "video_id long, segment_id long, start double, duration double, include boolean, n_candidates long, keypoints long, sig long")
    score = lambda c, i, j: 200 - 20 * abs(c["sig"][i] - c["sig"][j])
    got = {r.segment_id: (r.duplicate_of, r.status, r.include) for r in sequence.dedupe_chain(df, score).collect()}
    assert got[0] == (1, "duplicate", False) and got[1] == (None, "", True) and got[2] == (1, "duplicate", False)
    assert got[4][1] == "suspect" and got[5] == (6, "duplicate", False)
    assert got[6][2] is False  # kept for its length, but it has no candidates
    assert got[3] == (None, "", True) and {r.matched for r in sequence.dedupe_chain(df, score).where("segment_id = 0").collect()} == {None}
    doubt = {r.segment_id: r.status for r in sequence.dedupe_chain(df, score, merge=False).collect()}
    assert doubt[1] == "suspect" and "duplicate" not in doubt.values()


def test_sessions_compare_with_the_best_frame():
    f = lambda t, ok=True, score=1, sig=0: {"t": t, "ok": ok, "score": score, "sig": sig}
    same = lambda a, b: abs(a["sig"] - b["sig"]) <= 1
    got = sequence.group_shots([f(0, score=5), f(0.1, sig=1), f(0.2, sig=2), f(0.3, ok=False), f(0.5, sig=2), f(1.2, ok=False), f(1.3, sig=2)], 0.6, same)
    assert [[x["t"] for x in g] for g in got] == [[0, 0.1], [0.2, 0.5], [1.3]]


def test_votes(spark):
    rows = [(0, 0, 1, 10.0), (0, 1, 1, 4.0), (0, 2, 3, 0.5), (0, 4, 2, 2.0), (1, 0, 1, 2.0), (1, 1, 2, 2.0), (2, 0, 3, 1.0)]
    got = {r.v: (r.k, r.decided) for r in sequence.orientation_vote(spark.createDataFrame(rows, "v long, seq long, k long, conf double"), ["v"]).collect()}
    assert got == {0: (1, True), 1: (0, False), 2: (0, False)}


def test_nearest_and_greedy(spark):
    q = spark.createDataFrame([(0, 1.0, "a"), (0, 2.5, "b"), (0, 99.0, "c"), (1, 0.0, "d")], "k long, at double, name string")
    r = spark.createDataFrame([(0, 0.0, 1), (0, 2.0, 2), (0, 2.0, 3), (0, 3.0, 4)], "k long, t double, id long")
    assert {x.name: x.id for x in evaluate.nearest_asof(q, r, "k", "at", "t", "id").collect()} == {"a": 1, "b": 2, "c": 4, "d": None}
    assert evaluate.greedy_pairs([(1, "L", 0.0), (2, "L", 0.01)], [(7, "L", 0.009), (8, "L", 0.015), (9, "R", 0.0)], 0.02) == [(1, 7), (2, 8)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rate_counts_letters_of_whole_texts(spark):

    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("aé日 　\n😀b") for _ in range(n))
    rows = [(i % 7, say(n), say(n + rng.randint(0, 9))) for i, n in enumerate([0, 1, 5, 30, 80, 400, 700, 3, 9, 350])] + [(1, None, "x"), (8, "", "y")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    want = {}
    for k, a, b in rows:
        a, b = ("".join((x or "").split()) for x in (a, b))
        n, m = want.get(k, (0, 0))
        want[k] = (n + edits(a, b), m + len(a))
    got = {r.k: r for r in evaluate.error_rate(df, "a", "b", ["k"]).collect()}
    assert {k: (r.edits, r.chars) for k, r in got.items()} == want and got[8].cer is None


def test_time_of_forward_motion_is_in_proportion(spark):
    """A hot video: a frame up to the end, gone through for each row, would take minutes here."""

    df = spark.range(200_000).selectExpr("0L AS video_id", "id AS event_id", "id / 10.0D AS t", "(id % 17) * 1.0D AS motion").repartition(4)
    start = time.time()
    n = series.forward_motion(df).agg(F.sum("forward"), F.count("*")).first()
    q = spark.range(100_000).selectExpr("0L AS k", "id / 5.0D + 0.03D AS at", "id AS name")
    near = evaluate.nearest_asof(q, df.selectExpr("video_id AS k", "t", "event_id AS id"), "k", "at", "t", "id").agg(F.count("id")).first()[0]
    assert n[1] == 200_000 and n[0] == sum((i + 2) % 17 for i in range(199_998)) and near == 100_000 and time.time() - start < 60


def test_ratio_matches_counts_the_highest_bit(spark):
    from leafwright.kernels import signatures

    rows = spark.createDataFrame([(0, [1.0] * 64), (1, [-1.0] * 2 + [1.0] * 62), (2, [-1.0] * 40 + [1.0] * 24), (3, [1.0] * 20 + [-1.0] * 44)], "vec_id long, v array<double>")
    e = rows.select("vec_id", signatures.sign_bits(F.col("v")).alias("bits"))
    assert [tuple(r) for r in signatures.ratio_matches(e.where("vec_id = 0"), e, 0.75).collect()] == [(0, 1, 2, 40)]


def test_greedy_pairs_are_those_of_a_loop_and_take_no_square_of_time():
    def loop(expected, got, band):
        used, out = set(), []
        for e in expected:
            near = [(abs(g[2] - e[2]), k) for k, g in enumerate(got) if k not in used and g[1] == e[1] and abs(g[2] - e[2]) < band]
            if near:
                used.add(min(near)[1])
                out.append((e[0], got[min(near)[1]][0]))
        return out

    rng = random.Random(3)
    for _ in range(200):
        a, b = (sorted(((i, rng.choice("LR"), rng.randrange(12) / 4) for i in range(rng.randrange(20))), key=lambda x: x[2]) for _ in range(2))
        assert evaluate.greedy_pairs(a, b, 1.0) == loop(a, b, 1.0)
    start = time.time()
    many = [(i, "L", i / 8) for i in range(30_000)]
    assert len(evaluate.greedy_pairs(many, [(i, "L", t) for i, _, t in many], 1e9)) == 30_000 and time.time() - start < 10


def test_dedupe_chain_of_videos_over_several_batches(spark):
    """Videos end within batches and go on over them; each is told as if it were alone."""
    rng = random.Random(5)
    rows = [(v, v * 100 + i, float(i), float(rng.randrange(5)), True, 3, 500, rng.randrange(6)) for v in range(9) for i in range(rng.randrange(1, 14))]
    df = lambda x: spark.createDataFrame(x, "video_id long, segment_id long, start double, duration double, include boolean, n_candidates long, keypoints long, sig long")
    score = lambda c, i, j: 200 - 40 * abs(int(c["sig"][i]) - int(c["sig"][j]))
    alone = [r for v in range(9) for r in sequence.dedupe_chain(df([r for r in rows if r[0] == v]), score).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sequence.dedupe_chain(df(rows).coalesce(1), score)
        assert sorted(map(str, got.collect())) == sorted(map(str, alone)) and "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
