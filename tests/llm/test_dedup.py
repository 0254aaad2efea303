"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from leafwright.llm import exact_dedup, simhash, suffix_dedup
from leafwright.llm.common import connected_components


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_exact_edges(odd, none):
    got = {(r.doc_id, r.group_size, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(odd, keep="max").collect()}
    assert (1, 3, 4, False) in got and (4, 3, 4, True) in got and (None, 3, 4, False) in got
    assert (2, 2, 3, False) in got and (5, 2, 5, True) in got
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_collisions(spark):
    texts = [(i, random.Random(i % 40).choice(["aa", "ab", "ba", "Bb", "bB", "cc", ""])) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    weak = lambda c: F.length(c)
    want = {}
    for i, t in texts:
        want.setdefault(t.lower(), []).append(i)
    for options in ({}, {"key": weak}, {"key": weak, "check": weak}):
        got = exact_dedup.exact_dedup(df, **options).collect()
        assert len(got) == 200
        for r in got:
            ids = want[dict(texts)[r.doc_id].lower()]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids))
            assert r.text_sha256 == hashlib.sha256(dict(texts)[r.doc_id].lower().encode()).hexdigest()


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x1c")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", words)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    out = 0
    for b in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << b
    return out


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \t", "One", "one two", "ÀB c\x1cd e f", "😀 a b"] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 4) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
        assert simhash.fingerprint(t, block=7) == plain_fingerprint(t)


def brute_components(fps, radius=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def prints(rng, n):
    base = [rng.getrandbits(64) for _ in range(12)]
    return [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for f in rng.choices(base, k=n)]


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    fps = sorted(set(prints(rng, 300)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_components(fps)
    for hot, tile in ((20_000, 4096), (2, 3)):  # the second deals every group into tiles
        roots = {r.node & (1 << 64) - 1: r.root for r in connected_components(simhash.simhash_links(df, 3, hot, tile)).collect()}
        got = [roots.get(f, f if f < 1 << 63 else f - (1 << 64)) for f in fps]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_tiles():
    rng = random.Random(5)
    fps = np.array(sorted(set(prints(rng, 400))), dtype=np.uint64)
    for tile in (7, 64, 1024):
        u, v = simhash.tile_links(fps, 3, tile)
        from leafwright.llm.common import local_components

        got = local_components(len(fps), np.concatenate([u, v]), np.concatenate([v, u]))
        want = brute_components([int(x) for x in fps])
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_simhash_edges(odd, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd).collect()}
    assert (2, "0" * 16, 2) in got and (3, "0" * 16, 2) in got
    assert {c for d, _, c in got if d in (1, 4, None)} == {1}
    assert simhash.simhash_groups(none).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.drop_near_copies(odd).collect()) == ["1", "2", "5", "7"]  # rows that repeat stay once
    assert simhash.drop_near_copies(odd).columns == odd.columns and simhash.drop_near_copies(none).count() == 0
    named = odd.withColumn("a.b", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("__id", F.lit(3))
    assert simhash.drop_near_copies(named).columns == named.columns and simhash.drop_near_copies(named).count() == 4


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def varied(seed, n=80):
    """Texts with changed words, and how alike each is to the one it was made from."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(40, 400))]
        rate = rng.choice([0.0, 0.002, 0.01, 0.02, 0.2, 0.4])
        v = [x if rng.random() > rate else rng.choice(words) for x in w]
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        out.append((" ".join(w), " ".join(v).upper(), len(a & b) / len(a | b)))
    return out


def test_near_copies_are_found_from_a_similarity_on(spark):
    made = varied(4)
    df = spark.createDataFrame([(2 * i, a) for i, (a, _, _) in enumerate(made)] + [(2 * i + 1, b) for i, (_, b, _) in enumerate(made)], "doc_id long, text string").repartition(4)
    for hot, tile in ((20_000, 4096), (2, 3)):
        kept = {r.doc_id for r in simhash.drop_near_copies(df, hot=hot, tile=tile).collect()}
        assert {2 * i for i in range(len(made))} <= kept
        near = [2 * i + 1 in kept for i, (_, _, s) in enumerate(made) if s >= 0.8]
        far = [2 * i + 1 in kept for i, (_, _, s) in enumerate(made) if s < 0.5]
        assert len(near) > 30 and not any(near) and len(far) > 10 and all(far)


def test_sketches():
    s = simhash.Sketch()
    made = varied(6, 60)
    close = [bin(int.from_bytes(s.of(a)[0], "big") ^ int.from_bytes(s.of(b)[0], "big")).count("1") <= s.radius(0.8) and bool(set(s.of(a)[1]) & set(s.of(b)[1])) for a, b, x in made if x >= 0.8]
    assert sum(close) >= 0.98 * len(close) > 20
    long = " ".join(str(i) for i in range(20_000))
    assert s.of(long) == s.of(long, block=100) and s.of(None) == s.of(" \t") and s.of("a b") != s.of("a c")


def brute_repeats(docs, n):
    first = {}
    for i, t in docs:
        for p in range(len(t) - n + 1):
            w = t[p : p + n]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < i:
                gone[p : p + n] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.setdefault(i, []).append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh é"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 140))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 6))]
        docs.append((i, "".join(p[rng.randint(0, 3) :] for p in parts)))
    docs += [(n, "a" * 300), (n + 1, "a" * 200), (3, docs[3][1]), (n + 2, docs[5][1]), (n + 3, docs[5][1])]
    return docs


def test_repeats_match_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        want = brute_repeats([(i, t.encode()) for i, t in docs], 50)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        for hot in (20_000, 1):  # the second deals every shared anchor out by its windows
            got = {}
            for r in suffix_dedup.suffix_report(df, hot=hot).collect():
                got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_suffix_sort():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 99, (40, 76), dtype=np.uint8)
    row, start = np.repeat(np.arange(40), 10), np.tile(np.arange(10), 40)
    segment = np.sort(rng.integers(0, 5, 400))
    s = suffix_dedup.Suffixes(body, row, start, 12)
    order = s.sort(segment)
    keys = [(segment[i], body[row[i], start[i] : start[i] + 12].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(400))
    runs = s.equal_runs(segment)
    same = {}
    for i in range(400):
        same.setdefault((segment[i], body[row[i], start[i] : start[i] + 12].tobytes()), set()).add(runs[i])
    assert all(len(v) == 1 for v in same.values()) and len(set(runs)) == len(same)


def test_repeats_edges(odd, none):
    got = {r.doc_id: r for r in suffix_dedup.suffix_report(odd).collect()}
    assert got[2].n_bytes == 0 and got[5].n_removed == 0 and got[None].n_removed == 0
    assert suffix_dedup.suffix_report(none).count() == 0
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()


def test_buffers_fit_their_places():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in ((1 << 20) - 1, (1 << 20) + 200, 500, 60)]
    last, seen = 0, {i: set() for i in range(len(texts))}
    for buf, segment, rows, places, starts in suffix_dedup._pieces(texts, 50):
        assert len(buf) < 1 << 21
        for row, place, start, size in zip(rows, places, starts, np.bincount(segment)):
            assert buf[start : start + size].tobytes() == texts[row][place : place + size]
            seen[row].add((place, place + size - 49))
        first, ends, at = suffix_dedup.Rule(50, 24, 64, 64, 1000).anchors(buf, segment)[1:4]
        assert ((at >= first) & (at <= ends + 26) & (at >= ends)).all()  # each window holds its anchor
    for row, spans in seen.items():  # every window is in one segment
        assert [b for _, b in sorted(spans)][:-1] == [a for a, _ in sorted(spans)][1:] and max(spans)[1] == len(texts[row]) - 49


def test_hot_windows_take_little_memory():
    rng = np.random.default_rng(6)
    copy = rng.integers(97, 123, 4_000, dtype=np.uint8).tobytes().decode()
    texts = [copy if i % 2 else copy[:2_000] + "".join(map(chr, rng.integers(97, 123, 2_000))) for i in range(200)]
    docs = pa.table({"g": pa.array([0] * 200, pa.int32()), "id": pa.array(range(200), pa.int64()), "text": texts})
    rule = suffix_dedup.Rule(50, 24, 8, 8, 10)
    found = pa.Table.from_batches(list(suffix_dedup._anchor_rows(rule)(docs.select(["g", "text"]).to_batches())))
    own = [suffix_dedup._shared(rule)(found.filter(pc.equal(found["bucket"], b))) for b in found["bucket"].unique()]
    shared = pa.concat_tables(own).append_column("masks", pa.nulls(sum(x.num_rows for x in own), pa.binary()))
    tracemalloc.start()
    try:
        sent = suffix_dedup._context_rows(rule)(docs, shared)
        first = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        c, spans = suffix_dedup._removed(rule, docs, shared)
        second = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent.num_rows == 8 and max(first, second) < 150 << 20  # every window of 800 KB of text stands alone
    want = brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 50)
    kept = [hashlib.sha256(suffix_dedup._keep(t, x)).hexdigest() for t, x in zip(c.texts, spans)]
    assert [[(int((x[:, 1] - x[:, 0]).sum()), len(x), k)] for x, k in zip(spans, kept)] == [[w[1:] for w in want[i]] for i in range(200)]


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 100)
    docs = [(i, t.encode()) for i, t in corpus(2, 20)]
    rule = suffix_dedup.Rule(50, 24, 8, 8, 10)
    seen = []
    for buf, segment, row, place, start in suffix_dedup._pieces([t for _, t in docs], 50):
        _, first, last, _, _ = rule.anchors(buf, segment)
        for a, b in zip(first, last):
            s = segment[a]
            seen += [(int(row[s]), int(p - start[s] + place[s])) for p in range(a, b + 1)]
    assert sorted(seen) == [(i, p) for i, (_, t) in enumerate(docs) for p in range(len(t) - 49)]
