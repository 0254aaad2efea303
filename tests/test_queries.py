"""Each query against its SQL in DuckDB, on a small scale, and without the training-data operators."""

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from leafwright.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{DATA}/{t}.parquet') else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_greedy_match_equals_a_loop(spark):
    from leafwright.operators import evaluate
    from leafwright.plans import events

    got = registry.queries()["greedy_band_match"](spark, DATA).collect()
    rows = evaluate.split_repetitions(events.frames(spark, DATA).selectExpr("video_id", "event_id", "side", "t - 1704067200.0 as t"), 7 * 24 * 3600.0).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r.video_id, r.rep), []).append((r.local, r.event_id, r.side))
    want = Counter()
    for (v, rep), group in by.items():
        left = sorted(group)
        for local, i, side in sorted(by.get((v, 0), [])):
            near = [(abs(x[0] - local), k) for k, x in enumerate(left) if x[2] == side and abs(x[0] - local) < 6 * 3600.0]
            if near:
                want[(v, rep, i, left.pop(min(near)[1])[1])] += 1
    assert Counter((r.video_id, r.rep, r.expected, r.matched) for r in got if r.status == "matched" and r.video_id in {v for v, k in by if k == 0}) == want


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for item in ("leafwright", "__spark_entry__.py"):
        (tmp_path / item).symlink_to(root / item) if item.endswith(".py") else None
    (tmp_path / "leafwright").mkdir()
    for p in (root / "leafwright").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "leafwright" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def shuffles(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in x]


@pytest.mark.parametrize("name", ["receipt_lines", "placed_words", "word_stats", "page_min_conf"])
def test_texts_are_shuffled_but_not_their_words(spark, name):
    got = shuffles(registry.queries()[name](spark, DATA))
    assert len(got) == 1 and "page_id" in got[0]


def test_terms_meet_their_words_without_a_shuffle_of_words(spark):
    got = shuffles(registry.queries()["confidence_sweep"](spark, DATA))
    assert len([x for x in got if "SinglePartition" not in x]) == 1 and "page_id" in " ".join(got) and "term" not in " ".join(got)
