"""Archives, mixing, URL filters, the corpus pipeline and the registered queries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.llm import mixing, queries, tokens, toxicity, url_filter, warc
from leafwright.llm.common import fresh_path

PAGES = [(1, "https://WWW.Example.com:80/a?b=1#c", "x" * 200), (2, "http://example.com/é ü", "x" * 200), (3, None, None), (4, "not a url", ""), (5, "http://a.b/\r\nc", "é" * 60),
         (6, "http://a.b/", "short"), (7, "http://a.b/", "short"), (8, "http://u@a.b/p q", "é" * 60), (2, "http://example.com/é ü", "x" * 200), (None, "http://n.n/", "x" * 200), (9, "http://a.b/", "z\r\n\r\n" * 50)]


def test_archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = warc.archive_round_trip(pages, block=3, file_mb=0).collect()
    assert len(got) == len(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        body = html[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        first = min((i for i, h in html.items() if h == body and i is not None)) if len(body) >= 100 else r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_lookup(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.org/{i % 50}", f"<p>{i}</p>" * 30) for i in range(300)], "page_id long, url string, html string")
    uri = fresh_path(spark, "warc")
    directory = warc.write_archive(pages, uri, block=16)
    look = warc.Lookup(directory, uri)
    keys = dict(pages.select("url", warc.url_key(F.col("url"))).distinct().collect())
    assert keys["http://h3.example.org/3"] == "org,example,h3)/3"
    for url, key in keys.items():
        want = {i for i in range(300) if f"http://h{i % 7}.example.org/{i % 50}" == url}
        assert {int(r["id"]) for r in look.captures(key)} == want
    assert look.captures("org,example,h3)/nothing") == []


def brute_mix(rows, weights, share, limit):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, x, _ in rows if x == s) for s in sources}
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), share * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > limit * total[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = limit * total[s]
            left -= target[s]
        open_ -= full
    copies = []
    for s in sources:
        run = 0
        for p in range(limit):
            for i in sorted((i for i, x, _ in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
                run += size[i]
                if size[i] and target[s]:
                    copies.append((run / target[s], hashlib.md5(str(i).encode()).hexdigest(), i, p))
    run, taken, budget = 0, Counter(), min(share, limit) * sum(total.values())
    for _, _, i, _ in sorted(copies):
        run += size[i]
        if run > budget:
            break
        taken[i] += size[i]
    return size, total, target, taken


@pytest.mark.parametrize("share", [1.5, 0.3, 5.0])
def test_mixing(spark, share):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "Z", "é", None]), " ".join("w" for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(500, "only", "x\x0bx x"), (501, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    size, total, target, taken = brute_mix(rows, [3, 1, 2], share, 2)
    for few in (1000, 0):
        got = mixing.mix_sources(df, share=share, buckets=5, broadcast_rows=few).collect()
        assert len(got) == len(rows)
        source = {i: s for i, s, _ in rows}
        for r in got:
            s = source[r.doc_id]
            assert (r.size, r.source_size, r.taken) == (size[r.doc_id], total[s], taken[r.doc_id]) and abs(r.target - target[s]) < 1e-6


def test_mixing_edges(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix_sources(none).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_sources(odd.where("doc_id in (2, 3)")).collect())


def test_documents_are_mixed_by_row(spark):
    """Rows that repeat an id, in part with other texts, and columns of any name: as many as the mix takes, and not more."""
    rng = random.Random(16)
    rows = [(i % 90, rng.choice(["a", "a", "b", None]), " ".join(rng.choice("wxyz") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(None, "a", "one two three")] * 40 + [(7, "a", "same same")] * 25
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("__id", "a.b", "c0", "key", "size", "ends", "times", "copy", "h", "x", "pass")})
    for few in (1000, 0):
        m = mixing.mix_sources(df, buckets=3, broadcast_rows=few)
        want = Counter()
        for r in m.where("taken > 0").collect():
            want[r.doc_id, r.size] += r.taken // r.size
        out = mixing.mix_documents(df, buckets=3, broadcast_rows=few)
        assert out.columns == df.columns and Counter((r.doc_id, len(r.text.split())) for r in out.collect()) == want
        assert max(Counter((r.doc_id, r.text, r.source) for r in out.collect()).items(), key=lambda x: x[1])[1] <= 2 * max(Counter((i, t, s) for i, s, t in rows).values())
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_urls_come_back_as_they_were(spark):
    urls = ["http://x/a%20b%2Fc", "http://x/a b/c", "http://x/é%", "", " http://x/ ", "http://x/\r\nWARC-Type: evil", "http://x/\x00", "%", "http://x/\u2028"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    uri = fresh_path(spark, "warc")
    directory = warc.write_archive(pages, uri, block=2)
    for got in (warc.read_archive(directory, uri), warc.find_captures(pages.select(warc.url_key(F.col("url")).alias("key")), directory, uri)):
        assert {int(r.id): r.url for r in got.collect()} == dict(enumerate(urls))


def test_find_captures(spark):
    rng = random.Random(21)
    # a third of all captures are of one URL, over many blocks
    rows = [(i, "http://hot.example.org/" if i % 3 == 0 else f"http://h{rng.randrange(40)}.example.org/{rng.randrange(9)}", f"<p>{i}</p>" * 20) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    uri = fresh_path(spark, "warc")
    directory = warc.write_archive(pages, uri, block=8, file_mb=0)
    key = dict(pages.select("url", warc.url_key(F.col("url"))).distinct().collect())
    asked = [u for n, u in enumerate(sorted(key)) if n % 5 == 0 or "hot" in u]
    keys = spark.createDataFrame([(key[u],) for u in asked * 2] + [("org,example,h1)/none",), ("zzz",), ("",), (None,)], "key string")
    for most in (500_000, 7):  # the second takes the directory in pieces
        got = warc.find_captures(keys, directory, uri, most=most).collect()
        assert sorted(int(r.id) for r in got) == sorted(i for i, u, _ in rows if u in asked)
        assert all(key[r.url] == r.key and r.payload == rows[int(r.id)][2].encode() for r in got)
    assert warc.find_captures(keys, directory.limit(0), uri).count() == 0 and warc.find_captures(keys.limit(0), directory, uri).count() == 0
    salted = warc.write_archive(pages.withColumn("html", F.lit("<p>the same page</p>" * 10)), fresh_path(spark, "warc"), most_copies=0)
    assert salted.agg(F.sum("n")).first()[0] == 600


def test_archive_edges(odd, none):
    pages = odd.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit("http://a.b/"))
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == odd.count() and sum(r.record_type == "revisit" for r in got) == 0  # rows that repeat an id refer to none but themselves
    assert warc.archive_round_trip(none.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit("x"))).count() == 0


def test_url_filter_edges(spark, odd, none):
    entries = spark.createDataFrame([("l", "block", "a.b", "", "add", 1)], "list string, verdict string, host string, path string, action string, at long")
    clash = {c: F.lit("x") for c in ("path", "copies", "decision", "list", "since", "until", "rule_host", "parent", "under")}
    caps = odd.withColumns(clash).withColumns({"page_id": F.col("doc_id"), "url": F.when(F.col("doc_id") != 2, F.lit("http://a.b/")), "fetched": F.lit(5)})
    got = url_filter.filter_urls(caps, entries).collect()
    assert len(got) == odd.count() and sum(r.decision == "block" for r in got) == odd.where("doc_id <> 2").count()
    assert url_filter.filter_urls(caps.limit(0), entries).count() == 0


def test_url_filter(spark):
    entries = [("l1", "block", "bad.com", "", "add", 10), ("l1", "block", "bad.com", "", "remove", 20), ("l1", "block", "bad.com", "", "add", 20), ("l1", "block", "bad.com", "", "remove", 30),
               ("l2", "allow", "ok.bad.com", None, "add", 0), ("l3", "block", "ok.bad.com", "/x", "add", 5), ("l1", "block", "bad.com", "", "add", 12), (None, "block", None, "", "add", 1)]
    e = spark.createDataFrame(entries, "list string, verdict string, host string, path string, action string, at long")
    assert sorted(tuple(r) for r in url_filter.intervals(e).where("list = 'l1'").collect()) == [("l1", "block", "bad.com", "", 10, 20), ("l1", "block", "bad.com", "", 20, 30)]
    caps = [(1, "http://bad.com/", 9), (2, "http://bad.com/", 10), (3, "http://www.BAD.com/a", 20), (4, "https://bad.com", 30), (5, "http://ok.bad.com/y", 15), (6, "http://u:p@ok.bad.com:8/xyz?q", 15),
            (7, "http://notbad.com/", 15), (8, None, 15), (9, "http://bad.com/", None), (10, "junk", 15), (2, "http://bad.com/", 10)]
    c = spark.createDataFrame(caps, "page_id long, url string, fetched long").withColumn("host", F.lit("clash"))
    for few in (10_000, 0):
        got = Counter((r.page_id, r.n_active, r.lists, r.decision) for r in url_filter.filter_urls(c, e, broadcast_rows=few).collect())
        assert got == Counter({(1, 0, "", "allow"): 1, (2, 1, "l1", "block"): 2, (3, 1, "l1", "block"): 1, (4, 0, "", "allow"): 1, (5, 2, "l1,l2", "allow"): 1, (6, 3, "l1,l2,l3", "block"): 1,
                               (7, 0, "", "allow"): 1, (8, 0, "", "allow"): 1, (9, 0, "", "allow"): 1, (10, 0, "", "allow"): 1})
    assert url_filter.filter_urls(c.limit(0), e).count() == 0 and url_filter.filter_urls(c, e.limit(0)).where("decision = 'block'").count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: toxic documents, copies, leaks and clean ones over two sources."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(20))) for k in range(5)]
    docs, labels = [], []
    for i in range(400):
        w = say(rng.randint(30, 120))
        bad = i % 8 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), "gruk" + rng.choice(vocabulary))
        docs.append((i, " ".join(w), "en", f"s{i % 3 and 1}", 0))
        labels.append((i, 1, int(bad)))
    docs += [(400 + k, docs[10 + k][1], "en", "s0", 0) for k in range(20)]
    docs += [(500 + k, " ".join(say(250)) + " " + items[k][1], "en", "s1", 0) for k in range(1, 5)]  # a fourteenth is a test item
    docs += [(600 + k, " ".join([*say(300), items[k][1], *say(300)]), "en", "s0", 0) for k in range(1, 4)]  # less than a twentieth
    docs += [(700 + k, near(docs[130 + k][1], say(1)[0]), "en", "s1", 0) for k in range(1, 9)]
    docs += [(800, None, "en", "s0", None), (801, "", "en", None, 0), (3, docs[3][1], "en", "s0", 0), (None, " ".join(say(40)), "en", "s0", 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, labels, items


def near(text, word):
    """The text with its last word changed: at 30 words or more a similarity of at least 0.9."""
    return " ".join([*text.split()[:-1], word])


def cut_leaks(text, items, n=13):
    """(words, hit words, text without the hit words and what stands between those of a run), word by word."""
    from test_text import WORD, lower

    spots = list(WORD.finditer(lower(text)))
    w, hit = [m.group() for m in spots], set()
    for _, t in items:
        iw = WORD.findall(lower(t))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
    out, at = [], 0
    for i, m in enumerate(spots):
        if i in hit and i - 1 not in hit:
            out.append(text[at : m.start()])
        if i in hit:
            at = m.end()
    return len(w), len(hit), "".join([*out, (text or "")[at:]])


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_dedup import shingles

    sf_dir, docs, labels, items = small
    table = queries.table(spark, sf_dir, "documents")
    tox = toxicity.train_toxicity(table, queries.table(spark, sf_dir, "labels"))
    bad = {(r.doc_id, r.score) for r in toxicity.score_toxicity(table, tox).where("predicted = 1").collect()}
    left = [d for d in docs if d[0] not in {i for i, _ in bad}]
    assert {i for i, _ in bad} <= {i for i, _, y in labels if y} | set(range(400, 420)) | set(range(700, 710)) and len(bad) > 40
    rank = lambda d: (d[0] is None, d[0] or 0)
    kept, group, sets = [], {}, {n: shingles(d[1] or "") for n, d in enumerate(left)}
    for n in sorted(sets, key=lambda n: rank(left[n])):  # groups by single links
        linked = {group[m] for m in group if len(sets[n] & sets[m]) >= 0.8 * len(sets[n] | sets[m])}
        if not linked:
            kept.append(left[n])
        group[n] = min(linked, default=n, key=lambda g: rank(left[g]))
    assert len(kept) < len(left) - 20  # copies, near copies, the repeated row, one of two empty texts
    counted = [(d, cut_leaks(d[1], items)) for d in kept]
    clean = [(*d[:1], d[1] if not hit else cut, *d[2:]) for d, (n, hit, cut) in counted if not (hit and 20 * hit >= n)]
    assert len(clean) == len(kept) - 4 and sum(a != b[0][1] for (_, a, *_), b in zip(clean, [c for c in counted if not (c[1][1] and 20 * c[1][1] >= c[1][0])])) == 3
    size, _, _, taken = brute_mix([("" if d[0] is None else d[0], d[3], d[1]) for d in clean], [3, 1, 2], 1.5, 2)
    want = Counter({i: n // size[i] for i, n in taken.items()})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter("" if r.doc_id is None else r.doc_id for r in got) == want
    lib = tokens.CachedTokenizer(queries.tokenizer_path()).library
    text = {"" if d[0] is None else d[0]: d[1] for d in clean}
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.array([*lib.encode(text["" if r.doc_id is None else r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += r.n_tokens


def test_stages_with_odd_rows(spark, small, odd, none):
    """Nulls, empty and long texts, repeated rows, empty tables, and columns of any name: each stage keeps the columns."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = small[0]
    rows = odd.withColumns({c: F.lit(1) for c in ("__id", "__row", "__times", "__copy", "a.b", "c0", "x", "label", "runs", "items")})
    want = {"toxicity": 8, "simhash_near_dedup": 4, "decontamination": 8}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns and out.count() == want.get(name, out.count())
        if name == "mixing":
            assert 0 < out.count() <= 2 * rows.count() and out.where("text is null or text = ''").count() == 0
        assert stage(spark, rows.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, rows, sf_dir).count() == 8 and last(spark, rows.limit(0), sf_dir).count() == 0


def test_queries_run_whole(spark, small):
    sf_dir, docs, *_ = small
    q = queries.queries()
    assert [n.split("_")[0] for n in q] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(q)
    for name in ("op2_pii", "op5_exact_dedup", "op7_mixing", "op8_suffix_dedup", "op10_decontaminate"):
        assert q[name](spark, sf_dir).count() == len(docs)
