"""Decontamination, personal data, toxicity and tokens against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafwright.llm import decontaminate, pii, tokens, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_leaks(text, items, n):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for name, t in items:
        iw = WORD.findall(lower(t))
        m = min(n, len(iw))
        windows = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if iw else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("most_words", [100_000, 12])
def test_leaks(spark, most_words):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("a b c d É_x f".split()) for _ in range(n))
    items = [(str(i), say(rng.randint(0, 14))) for i in range(25)] + [("x", None), ("y", ""), ("1", "dup id here")]
    docs = [(i, say(rng.randint(0, 80)) + rng.choice(["", "! " + (items[rng.randrange(25)][1] or "")])) for i in range(60)] + [(99, None), (98, ""), (97, "...")]
    b, d = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leak_report(d, b, window=5, most_words=most_words).collect()}
    for i, t in docs:
        n, hit, k, sha = brute_leaks(t, items, 5)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, k, sha)
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_decontaminate(spark, odd, none):
    b = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    clean = "alpha " * 400
    docs = spark.createDataFrame([(1, "One, two three four five six!"), (2, f"{clean}x One two three four five six. End"), (3, clean), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, b, window=5).collect()}
    assert got == {2: f"{clean}x . End", 3: clean, 4: None}
    out = decontaminate.decontaminate(odd, b)
    assert out.columns == odd.columns and out.count() == odd.count() and decontaminate.decontaminate(none, b).count() == 0
    assert decontaminate.leak_report(odd, b.limit(0)).where("contaminated").count() == 0


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(4)
    bits = ["a.b+c@x-y.co.uk", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "4111-1111 1111-1112", "+1 (017) 555-7713", "+12", "+1.2.3", "é😀", "x_y@z.de_q@r.s", "00012.1.1.01", "5", " ", ".", "-", "+", "49927398716", "mail me (at) home (dot) org", "call (212) 555-0199 now"]
    docs = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "x", "\n"]) for _ in range(rng.randint(0, 14)))) for i in range(300)] + [(900, None), (901, ""), (902, "7" * 20_000), (903, "a" * 20_000 + "@"), (904, "1." * 9_000), (905, "+" + "1-" * 9_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, t in docs:
        want = brute_spans(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (i, t, line, got[i].spans)
        for k in PATTERNS:
            assert got[i][f"n_{k}"] == sum(x[0] == k for x in want)
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(line.split(",") if line else []) <= set(spans) and len(spans) == len(want) + got[i].n_added
        order = [(list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_addresses_in_square_brackets(spark):
    docs = [(1, "mail me [at] home [dot] org"), (2, "mail me (at) home (dot) org"), (3, "mail me at home dot org"), (4, "write to a.b[AT]c-d[dot]co(dot)uk now")]
    got = {r.id: [(x.k, x.s, x.v) for x in r.spans] for r in pii.candidates(spark.createDataFrame(docs, "doc_id long, text string")).select("id", F.expr("transform(spans, x -> named_struct('k', x.k, 's', x.s, 'v', x.e - x.s))").alias("spans")).collect()}
    assert got == {1: [(0, 5, 22)], 2: [(0, 5, 22)], 3: [], 4: [(0, 9, 24)]}


def test_pii_edges(odd, none):
    assert pii.find_pii(odd).where("n_email + n_ip + n_card + n_phone + n_added = 0").count() == odd.count()
    assert pii.find_pii(none).count() == 0


def test_votes_find_the_reliable_labelers():
    rng = random.Random(7)
    seen = {}
    for _ in range(4000):
        truth = rng.random() < 0.6
        v = [int((rng.random() < 0.95) == truth), int((rng.random() < 0.9) == truth), 2 if rng.random() < 0.5 else int((rng.random() < 0.8) == truth), int(rng.random() < 0.5)]
        code = 0
        for x in v:
            code = code * 3 + x
        seen[code] = seen.get(code, 0) + 1
    share, yes, no = pii.weigh_votes([(0, v, n) for v, n in seen.items()])[0]
    assert abs(share - 0.6) < 0.05 and yes[0] > 0.9 and no[0] < 0.1 and abs(yes[3] - no[3]) < 0.1
    shapes = int(np.prod(pii._SIZES))
    w = pii.train_classifier([(0, v * shapes + rng.randrange(shapes), n) for v, n in seen.items()])[0]
    p = lambda v: sum(a * b for a, b in zip(w, pii._features(v * shapes)))
    assert p(81 - 1 - 1 - 3) > 0 > p(0)


def test_features_go_along_with_what_reliable_labelers_say():
    """Spans on which the labelers are silent are told apart by their length, which went along with the votes elsewhere."""
    shapes = int(np.prod(pii._SIZES))
    long, short = 3 * shapes // 4, 0
    yes, no, silent = 80 - 27 - 9 - 3 - 1, 0, 80
    seen = [(0, yes * shapes + long, 900), (0, no * shapes + short, 900), (0, silent * shapes + long, 5), (0, silent * shapes + short, 5)]
    w = pii.train_classifier(seen)[0]
    p = [sum(a * b for a, b in zip(w, pii._features(silent * shapes + x))) for x in (long, short)]
    assert p[0] > 0.3 and p[1] < -0.3


def test_the_classifier_decides_what_is_added(spark):
    """The same forms are added or left, by what stands around them and by what the labelers turn out to be worth."""
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    docs = [(i, f'token = "{key()}" and call 415-555-{rng.randint(1000, 9999)} now') for i in range(300)]
    docs += [(i, f"commit {key()}x and order {key()} of invoice 015-555-{rng.randint(1000, 9999)}") for i in range(300, 600)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(r.n_card > 0 for r in got.values()) < 10  # digits of a key, which no span may overlap then
    assert all(got[i].n_secret == 1 and got[i].n_added == 1 and f"phone:{docs[i][1].index('call ') + 5}:{docs[i][1].index('call ') + 17}" in got[i].spans for i in range(300) if not got[i].n_card)
    assert all(got[i].n_added == 0 for i in range(300, 600)) and all(got[i].n_secret == 1 for i in range(300, 600) if not got[i].n_card)
    assert got[0].secrets == "9:49" and got[0].n_found == 2


def test_many_matches_in_one_text(spark):
    """A text is matched a fixed number of times: ten thousand addresses and as many numbers are found in seconds."""
    line = "write to ab.c@d-e.org or é (212) 555-0199, "
    df = spark.createDataFrame([(1, line * 10_000)], "doc_id long, text string")
    start = time.time()
    got = pii.candidates(df).selectExpr("size(spans) AS n", "sum(0) OVER () AS z", "transform(spans, x -> x.s) AS s").first()
    assert time.time() - start < 60 and got.n == 20_000
    assert got.s == sorted([i * len(line) + 9 for i in range(10_000)] + [i * len(line) + 27 for i in range(10_000)])


def test_what_overlaps_a_base_span_is_left_out(spark):
    docs = [(1, "+1 (212) 555-0199"), (2, "a.b [at] c@d.org"), (3, "x@415-555-0100.org 415-555-0100")]
    got = {r.id: [(x.k, x.s, x.base) for x in r.spans] for r in pii.candidates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [(3, 0, True)], 2: [(0, 9, True)], 3: [(0, 0, True), (3, 19, False)]}


def plain_kneser_ney(counts, order, d=0.75):
    """From dictionaries of strings: counts {word: (a, b)} -> function (context, letter) -> [P_0, P_1]. A start mark is <, an end
    mark >; contexts have at most order - 1 letters, and the start mark among them where the word is short enough."""
    def places(word):
        w = f"<{word}>"
        return [(w[max(0, i - order + 1) : i], w[:i], w[i]) for i in range(1, len(w))]

    seen, before = [{}, {}], {}
    for word, n in counts.items():
        for ctx, all_, letter in places(word):
            for k in (0, 1):
                if n[k]:
                    seen[k].setdefault(ctx, {}).setdefault(letter, 0)
                    seen[k][ctx][letter] += n[k]
            for m in range(order - 1):  # lower contexts have m letters and no start mark
                if m < len(all_):
                    before.setdefault(all_[len(all_) - m :], {}).setdefault(letter, set()).add(all_[len(all_) - m - 1])
    letters = len(before[""])

    def lower(ctx, letter):
        p = lower(ctx[1:], letter) if ctx else 1 / letters
        after = before.get(ctx)
        if not after:
            return p
        return (max(len(after.get(letter, ())) - d, 0) + d * len(after) * p) / sum(map(len, after.values()))

    def prob(ctx, letter):
        out = []
        for k in (0, 1):
            p, after = lower(ctx[1:], letter), seen[k].get(ctx)
            out.append((max(after.get(letter, 0) - d, 0) + d * len(after) * p) / sum(after.values()) if after else p)
        return out

    def ratio(word):
        known = [(c, x) for c, _, x in places(word) if any(x in seen[k].get(c, {}) for k in (0, 1))]
        return sum(np.log(p[1] / p[0]) for p in (prob(c, x) for c, x in known))

    return prob, ratio, sorted({x for v in before.values() for x in v})


def some_counts(n=300):
    rng = random.Random(12)
    out = {}
    while len(out) < n:
        out["".join(rng.choice("abcdeé😀_1") for _ in range(rng.choice([1, 2, 3, 5, 8, 30])))] = (rng.randint(0, 5), rng.randint(0, 5))
    return {w: c for w, c in out.items() if any(c)}


@pytest.mark.parametrize("order", [3, 6])
def test_ratios_equal_plain_kneser_ney(spark, order):
    counts = some_counts()
    prob, ratio, letters = plain_kneser_ney(counts, order)
    for ctx in ("<", "<a", "ab"[: order - 1], "<zz"[: order - 1], "dd"):
        assert np.allclose(np.sum([prob(ctx, x) for x in letters], axis=0), 1)  # a distribution, backoff included
    df = spark.createDataFrame([(w, *c) for w, c in counts.items()], "w string, a long, b long").repartition(5)
    t = toxicity.letter_ratios(df, order).toPandas()
    r = toxicity.Ratios(t["gram"].to_numpy().view(np.uint64), t["ratio"].to_numpy(), order)
    words = [*counts, "zz", "abcab", "", "a" * 50]
    assert np.allclose(r.words(words), [ratio(w) for w in words], atol=1e-4)
    for most in (8, 50):  # long words are gone through in pieces
        assert np.allclose(r.words(words, most), r.words(words), atol=1e-4)
    parts = list(toxicity._grams(order, 40)([pa.RecordBatch.from_pydict({"w": ["ab" * 100], "a": [3], "b": [1]})]))
    top = [x for p in parts for x in p.to_pylist() if x["n"] < 0]
    assert sum(x["a"] for x in top) == 3 * 201 and sum(x["b"] for x in top) == 201


def ratios_of(spark, counts, order=6):
    t = toxicity.letter_ratios(spark.createDataFrame([(w, *c) for w, c in counts.items()], "w string, a long, b long"), order).toPandas()
    return toxicity.Ratios(t["gram"].to_numpy().view(np.uint64), t["ratio"].to_numpy(), order)


def test_unseen_words_speak_for_neither(spark):
    m = ratios_of(spark, {"alpha": (9, 9), "beta": (9, 9), "vile": (0, 7), "vilest": (0, 3)})
    r = dict(zip(["alpha", "vile", "viles", "qqqq"], m.words(["alpha", "vile", "viles", "qqqq"])))
    assert r["vile"] > 2 and r["viles"] > 2 and abs(r["qqqq"]) < 0.5 and r["alpha"] < 1


def test_long_runs_are_scored_to_their_end(spark):
    m = ratios_of(spark, {"aaaaaaalpha": (9, 0), "bbbbbbvilest": (0, 9)})
    whole = m.words(["0" * 80 + "bbbbbbvilest", "0" * 80 + "aaaaaaalpha", "bbbbbbvilest" * 30, "0" * 92])
    assert whole[3] == 0 and whole[0] > 2 > 0 > whole[1] and whole[2] > 20 * whole[0]


def test_one_splitter_for_training_and_scoring(spark):
    odd_words = "ne\u0301e हिन्दी a_b É İx don't"
    got = {r.w: (r.a, r.b) for r in toxicity._word_counts(spark.createDataFrame([(1, odd_words), (0, odd_words + " É"), (0, "")], "y int, text string")).collect()}
    assert set(got) == set(toxicity.words_of(odd_words)) and got["é"] == (2, 1)


def test_likelihoods_are_compared_by_length(spark):
    """The difference is the mean over the words of what the toxic model gains, in itself and padded."""
    tox = toxicity.Toxicity(None, None, 6, 0.01, 50)
    tox.ratios = type("Handle", (), {"value": ratios_of(spark, {"alpha": (9, 2), "beta": (5, 2), "vile": (0, 7)})})()
    one, many = tox.differences(["vile " + "alpha " * 99, "vile alpha beta"], {})
    gain = {w: np.log(0.99 + 0.01 * np.exp(x)) for w, x in zip(("alpha", "beta", "vile"), tox.ratios.value.words(["alpha", "beta", "vile"]))}
    assert np.isclose(one, (gain["vile"] + 99 * gain["alpha"]) / 150) and np.isclose(many, sum(gain.values()) / 53)
    assert tox.differences([None, "", "..."], {}).tolist() == [0.0] * 3


def test_a_table_too_large_to_broadcast_is_joined(spark, odd):
    docs, labels, _ = toxic_corpus(spark, 200)
    a = toxicity.train_toxicity(docs, labels)
    b = toxicity.train_toxicity(docs, labels, most_grams=0, most_labels=0)
    assert b.ratios is None and np.allclose(a.weights, b.weights)
    for d in (docs, odd):
        x, y = (sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in toxicity.score_toxicity(d, t).collect()) for t in (a, b))
        assert x == y
    assert toxicity.drop_toxic(odd, b).count() == odd.count() and toxicity.drop_toxic(odd, b).columns == odd.columns


def test_counts_take_all_labelled_rows(spark):
    docs, labels, truth = toxic_corpus(spark, 300)
    free = [i for i in truth if zlib.crc32(str(i).encode()) % 3 != 1]
    marks = {i: f"qz{i:04d}z" for i in truth}  # a word of its own in each text
    mark = F.concat(F.lit(" qz"), F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit("z"))
    tox = toxicity.train_toxicity(docs.withColumn("text", F.concat("text", mark)), labels, per_class=10)
    grams = {i: np.isin(toxicity._full_grams(toxicity.Words([marks[i]]), tox.order)[1:], tox.ratios.value.keys).all() for i in truth}
    left_out = [i for i in free if not grams[i]]
    assert 0 < len(left_out) <= 20  # the calibration sample, and nothing else
    assert sum(grams[i] for i in truth if i not in free) < len(truth) - len(free)


def toxic_corpus(spark, n=900):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.15
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), "gruk" + rng.choice(words))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity(spark, odd, none):
    docs, labels, truth = toxic_corpus(spark)
    tox = toxicity.train_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, tox).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    edge = toxicity.score_toxicity(odd, tox).collect()
    assert len(edge) == odd.count() and not any(r.predicted for r in edge) and any(r.held_out is False and r.doc_id is None for r in edge)
    assert toxicity.score_toxicity(none, tox).count() == 0
    kept = toxicity.drop_toxic(docs, tox)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    # labels of held-out rows are never learned from
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)
    empty = toxicity.train_toxicity(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs, empty).where("predicted = 1").count() == 0


def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


TEXTS = ["", "Don't STOP me'll now, it's 123 apples!!", "naïve É́ é İstanbul İ! ŉ ǅ Σας ΣΑΣ", "a\x1cb\x1d c\x85d\xa0e f", "<|endoftext|>x <|startoftext|>", "日本語 テキスト 𝔘𝔫𝔦", "tabs\tand\nlines\r\nmany   spaces ", "ﬁ Å Ω ß ẞ ʼn", "x" * 5000, "'S 'RE 've 'Ll ''s '", "don’t №5 ½ ٣ a_b-c/d\\e", "ÿŸ ĳĲ ŀĿ ŉ ſS kK"]


def test_cached_tokens_equal_the_library():
    t = tokens.CachedTokenizer(path(), most=50)
    rng = random.Random(11)
    texts = TEXTS + ["".join(rng.choice("aZé0'!. \n\x1ćİ<|s😀ſΣ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for x in texts:
        assert t.encode(x) == t.library.encode(x, add_special_tokens=False).ids, repr(x)


def test_other_vocabularies_go_through_the_library():
    public = pytest.importorskip("public_tokenizers")
    t = tokens.CachedTokenizer(public.path("byte_bpe_50k.json"))
    assert not t.known and tokens.CachedTokenizer(path()).known
    for x in TEXTS:
        assert t.encode(x) == t.library.encode(x, add_special_tokens=False).ids


def test_layout_of_token_files(spark, tmp_path):
    """Encodings, bounded row groups and pages, page indexes, and readers that read no more than they need."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, " ".join(f"{i * k * 7919 % 999983:x}" for k in range(400))) for i in range(3000)], "doc_id long, text string").repartition(2)
    tokens.write_tokens(docs, f"file://{tmp_path}/t", path(), row_group_mb=1, page_kb=64)
    parts = [pq.ParquetFile(p).metadata for p in sorted((tmp_path / "t").glob("*.parquet"))]
    columns = [g.column(k) for m in parts for g in map(m.row_group, range(m.num_row_groups)) for k in range(g.num_columns)]
    by = {}
    for c in columns:
        by.setdefault(c.path_in_schema.split(".")[0], []).append(c)
    assert all(any("DICTIONARY" in e for e in c.encodings) for c in by["tokens"]) and all("DELTA_BINARY_PACKED" in c.encodings for c in by["id"] + by["offset"])
    assert all(c.has_offset_index and c.has_column_index for c in by["id"]) and sum(m.num_row_groups for m in parts) > len(parts)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "tokens:array" not in plan(tokens.read_index(spark, f"file://{tmp_path}/t"))
    assert "PushedFilters: [In(id" in plan(tokens.read_tokens(spark, f"file://{tmp_path}/t", [3, 5]))


def test_token_files(spark, odd, none, tmp_path):
    lib = tokens.CachedTokenizer(path()).library
    docs = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(TEXTS * 3 + [None])], "doc_id long, text string").repartition(5)
    out = f"file://{tmp_path}/tokens"
    tokens.write_tokens(docs, out, path())
    start, want = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_digests(spark, out).collect()} == want
    assert {r.id: r.start for r in tokens.read_index(spark, out).collect()} == {k: v[0] for k, v in want.items()}
    some = tokens.read_tokens(spark, out, [7, 14])
    assert {r.id: len(r.tokens) for r in some.collect()} == {k: want[k][1] for k in (7, 14)}
    got = tokens.tokens_of(odd, path()).collect()
    assert len(got) == odd.count() and sorted(r.start for r in got)[0] == 0
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert tokens.tokens_of(none, path()).count() == 0
