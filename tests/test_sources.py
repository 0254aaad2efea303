"""Readers, writers and kernels on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright import schemas
from leafwright.kernels import images
from leafwright.operators import pages, words
from leafwright.sources import files, frames, sinks

TSV = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n1\t1\t0\t0\t0\t0\t0\t0\t1000\t1400\t-1\t\n"


def word(n, line, left, conf, text):
    return f"5\t1\t1\t1\t{line}\t{n}\t{left}\t{100 * line}\t50\t20\t{conf}\t{text}\n"


def test_word_tables(spark, tmp_path):
    good = "".join(word(i, 1, 100 * i, 90, w) for i, w in enumerate(["反則", "の", "違反"])) + "".join(word(i, 2, 100 * i, 90, w) for i, w in enumerate(["VAR", 'ch"eck', "判定"]))
    bad = "".join(word(i, i, 0, c, w) for i, (c, w) in enumerate([(81, "ささ"), (5, "いき"), (0, "男"), (21, "区"), (12, "ルン")])) + word(9, 9, 0, "", " ")
    (tmp_path / "a.tsv").write_text(TSV + good, encoding="utf-8")
    (tmp_path / "b.tsv").write_text(TSV + bad, encoding="utf-8")
    t = files.word_table(spark, str(tmp_path))
    assert {r.page_id: (r.width, r.height) for r in files.page_sizes(t).collect()} == {"a": (1000, 1400), "b": (1000, 1400)}
    w = words.read_words(t).withColumn("word", F.col("left"))
    assert [r.token for r in words.spaced(w).where("page_id = 'a'").orderBy("line", "left").collect()] == ["反則", "の", "違反", "VAR ", 'ch"eck', "判定"]
    low = {r.page_id: r.min_conf for r in words.page_min_conf(w).collect()}
    assert low == {"a": 0.0, "b": 60.0}
    kept = words.line_texts(w.join(words.page_min_conf(w), "page_id").where("conf >= min_conf")).where("page_id = 'b'").collect()
    assert [r.text for r in kept] == ["ささ"]


def test_small_files(spark, tmp_path):
    (tmp_path / "terms.json").write_text(json.dumps({"_note": ["x"], "p1": ["a", "b"], "p2": []}))
    assert sorted(tuple(r) for r in files.terms(spark, f"{tmp_path}/terms.json").collect()) == [("p1", "a"), ("p1", "b")]
    (tmp_path / "v.txt").write_text("2\n1-10\n12-20\n")
    assert [(r.gt, r.a, r.b) for r in files.truth_intervals(spark, f"{tmp_path}/v.txt").orderBy("gt").collect()] == [(0, 1, 10), (1, 12, 20)]
    (tmp_path / "w.txt").write_text("3\n1-10\n")
    with pytest.raises(Exception, match="count"):
        files.truth_intervals(spark, f"{tmp_path}/w.txt").collect()
    (tmp_path / "c.xml").write_text('<gt><frame index="1" rejected="false"><point name="tl" x="1.5" y="2"/></frame><frame index="2" rejected="true"/></gt>')
    got = {r.frame: r.corners for r in files.corner_truth(spark, f"{tmp_path}/c.xml").collect()}
    assert got[1]["tl"].x == 1.5 and got[2] is None
    (tmp_path / "log.jsonl").write_text('{"t": 1.5, "pid": 3, "event": "stage", "name": "ocr"}\n{"t": 2')
    assert [(r.t, r.event) for r in files.event_log(spark, f"{tmp_path}/log.jsonl").collect()] == [(1.5, "stage")]
    photos = tmp_path / "photos"
    photos.mkdir()
    (photos / "b.png").write_bytes(b"\x89PNG....")
    (photos / "a.jpg").write_bytes(b"\xff\xd8\xff")
    (photos / "empty.jpg").write_bytes(b"")
    (photos / "c.txt").write_bytes(b"hello")
    assert [r.name for r in files.list_photos(spark, str(photos)).collect()] == ["a.jpg", "b.png"]
    assert {r.path.split("/")[-1]: (r.kind, r.error) for r in files.probe(spark, str(photos)).collect()} == {"a.jpg": ("jpeg", None), "b.png": ("png", None), "c.txt": (None, "not a known kind")}


def test_project(spark, tmp_path):
    doc = {"schema_version": 1, "videos": [{"id": "v0001"}], "segments": [], "frames": {"f0001": {"id": "f0001", "pts": 5}}, "pages": {}, "order": ["p1"]}
    (tmp_path / "project.json").write_text(json.dumps(doc, indent=1))
    got = files.project(spark, f"{tmp_path}/project.json")
    assert got["videos"].first().id == "v0001" and got["frames"].first().pts == 5 and got["segments"].count() == 0 and got["order"].first().id == "p1"
    (tmp_path / "project.json").write_text(json.dumps(doc | {"schema_version": 2}))
    with pytest.raises(ValueError):
        files.project(spark, f"{tmp_path}/project.json")
    assert "receipt struct<" in schemas.PAGES


def test_list_round_trip(spark, tmp_path):
    cols = "id string, pos int, date string, payee string, total long, base10 long, base8 long, tax long, registration_no string, note string, state string, labels array<string>"
    df = spark.createDataFrame([("p2", 1, None, 'a "b", c', 5, None, None, None, None, "x\ny", "自動", ["紙"]), ("p1", 0, "2024-01-02", "み/ど", 700, 1, 2, 3, "T1", None, "手修正", None)], cols)
    sinks.write_list(sinks.list_rows(df), f"{tmp_path}/list")
    part = next((tmp_path / "list").glob("part-*"))
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfNo,ID,") and raw.count(b"\r\n") == 3
    back = files.receipt_list(spark, str(part)).orderBy("No").collect()
    assert [r.ID for r in back] == ["p1", "p2"] and back[1]["取引先"] == 'a "b", c' and back[0]["画像"] == "001_20240102_み_ど_700.jpg"
    with pytest.raises(ValueError):
        (tmp_path / "x.csv").write_text("a,b\n1,2\n")
        files.receipt_list(spark, f"{tmp_path}/x.csv")


def test_verify_and_tables(spark):
    p = spark.createDataFrame([("p1", "Hello World"), ("p2", "")], "page_id string, text string")
    t = spark.createDataFrame([("p1", "WORLD"), ("p1", "moon"), ("p3", "x")], "page_id string, term string")
    r = sinks.verify(p, t, 2).first()
    assert (r.page_count_ok, r.empty_pages, r.terms, r.found, r.missing) == (True, 1, 3, 1, ["p1:moon", "p3:x"])
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(x) for x in sinks.upsert(a, b, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [x.v for x in sinks.most_recent(a, "v", "k", 1).collect()] == ["b"]
    e = sinks.export_record(spark.createDataFrame([("x", 1, "r1", "text"), ("y", 0, "r0", "image_only")], "id string, pos int, revision string, how string"), "/o.pdf", False, "now").first()
    assert e.order == ["y", "x"] and e.image_only_pages == ["y"] and e.revisions == {"x": "r1", "y": "r0"}


def page(h=700, w=500, pitch=25, dark=60.0, paper=220.0):
    a = np.full((h, w), paper)
    for y in range(40, h - 40, pitch):
        for x in range(40, w - 40, 14):
            a[y : y + 9, x : x + 9] = dark
    return a


def test_kernels():
    a = page()
    assert images.line_pitch(a) == 25 and abs(images.skew(a)) <= 0.25
    assert images.page_checks(a, None) == [] and images.page_checks(np.full((300, 300), 20.0), None) == ["exposure_dark", "blank_page"] and "exposure_bright" in images.page_checks(np.full((300, 300), 255.0), None)
    desk = np.full((800, 1300), 40.0)
    desk[50:750, 100:1200] = 220
    desk[50:750, 100:600], desk[50:750, 700:1200] = page(), page()
    desk[50:750, 560:740] -= 60 * np.exp(-(((np.arange(560, 740) - 650) / 40) ** 2))
    box, warnings = images.page_region(desk)
    assert warnings == [] and all(abs(x - y) <= 20 for x, y in zip(box, (100, 50, 1200, 750)))
    x, sure, warnings = images.gutter(desk, box)
    assert abs(x - 650) <= 12 and sure >= 0.5 and not warnings
    assert [p["side"] for p in images.split_spread(desk, direction="rtl")] == ["R", "L"] and [p["side"] for p in images.split_spread(desk, layout="single")] == ["S"]
    light = images.even_light(page() * np.linspace(0.6, 1, 500)[None])
    assert light[5:30, 5:30].min() > 200 and light[5:30, -30:-5].min() > 200
    labels, n = images.components(np.array([[1, 0, 1, 1], [1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 1, 1]], bool))
    assert n == 3 and labels[0, 0] == labels[1, 1] and labels[0, 2] == labels[3, 2] and labels[2, 0] == 0
    assert images.otsu(np.r_[np.full(50, 10), np.full(60, 200)]) in range(10, 200)
    xs = [np.linspace(0, 900, 60)] * 12
    ys = [100 + 80 * i + 12 * ((x - 450) / 450) ** 2 for i, x in enumerate(xs)]
    c = images.displacement(xs, ys, 900, 1200)
    flat = [y - images.shift_at(c, x, np.full(60, np.median(y)), 900, 1200) for x, y in zip(xs, ys)]
    assert max(np.ptp(y) for y in flat) < 2 and images.displacement(xs[:3], ys[:3], 900, 1200) is None


def test_frame_source(spark, tmp_path):
    rng = np.random.default_rng(0)
    still, moved = rng.uniform(0, 255, (40, 60)), rng.uniform(0, 255, (40, 60))
    t = np.arange(90) / 30
    shots = np.stack([still if i < 45 else moved for i in range(90)])
    np.savez(tmp_path / "v.npz", t=t, pts=np.arange(90) * 3, frames=shots)
    (tmp_path / "w.npz").write_bytes(b"not an archive")
    one = frames.frame_metrics(frames.ranges(spark, [("v", f"{tmp_path}/v.npz", 3.0)], 99.0)).orderBy("t").collect()
    many = frames.frame_metrics(frames.ranges(spark, [("v", f"{tmp_path}/v.npz", 3.0), ("w", f"{tmp_path}/w.npz", 1.0)], 1.0)).where("video_id = 'v'").orderBy("t").collect()
    assert len(one) == 90 and [(r.pts, r.motion) for r in one] == [(r.pts, r.motion) for r in many]
    assert one[44].motion == 0 and one[45].motion > 5 and one[89].motion == 0 and len(one[0].sig) == images.signature(still).size
    bad = frames.frame_metrics(frames.ranges(spark, [("w", f"{tmp_path}/w.npz", 1.0)], 9.0)).collect()
    assert len(bad) == 1 and bad[0].error and bad[0].t is None
    keys = spark.createDataFrame([("v", 1.0, 90), ("v", 2.0, 180), ("v", 2.0, 181)], "video_id string, t double, pts long")
    got = {r.pts: r.found for r in frames.grab(keys, spark.createDataFrame([("v", f"{tmp_path}/v.npz")], "video_id string, path string")).collect()}
    assert got == {90: True, 180: True, 181: False}


def test_split_pages(spark):
    a = page().astype(np.uint8)
    df = spark.createDataFrame([(1, 700, 500, bytearray(a.tobytes())), (2, 9, 9, bytearray(b"xx"))], "segment_id long, height int, width int, grey binary")
    got = pages.split_pages(df, layout="single").orderBy("segment_id").collect()
    assert (got[0].side, got[0].line_pitch_px) == ("S", 25.0) and got[1].error


def jpeg(w, h, n=3):
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"x" * 40


def test_pdf(spark):
    import re
    import zlib

    from leafwright.sources import pdf

    assert pdf.jpeg_size(jpeg(30, 20)) == (30, 20, 3)
    w = spark.createDataFrame([("p1", 0, 1, 0, 0, 0, 10, 50, 20, "VAR"), ("p1", 0, 1, 0, 1, 60, 10, 50, 20, "check"), ("p1", 0, 1, 1, 2, 0, 40, 50, 20, "判定")], "page_id string, block int, par int, line int, word int, left int, top int, width int, height int, text string")
    layer = pdf.text_layer(words.placed(w, 100, 100, 72.0, 72.0)).first().content
    assert [bytes.fromhex(x).decode("utf-16-be") for x in re.findall("<([0-9A-F]+)>", layer)] == ["VAR ", "check", "判定"]
    df = spark.createDataFrame([("d", 1, bytearray(jpeg(40, 20)), 72, None), ("d", 0, bytearray(jpeg(30, 20, 1)), 144, layer), ("e", 0, bytearray(b"no"), 72, "")], "document string, pos int, jpeg binary, dpi int, content string")
    got = {r.document: r for r in pdf.documents(df).collect()}
    raw = bytes(got["d"].pdf)
    assert pdf.page_count(raw) == 2 and b"MediaBox[0 0 15.000 10.000]" in raw and jpeg(40, 20) in raw and got["e"].pdf is None and got["e"].error
    at = int(re.search(rb"startxref\n(\d+)", raw)[1])
    assert raw[at:].startswith(b"xref") and all(raw[int(o) :].startswith(b"%d 0 obj" % k) for k, (o, kind) in enumerate(re.findall(rb"(\d{10}) \d{5} ([nf]) \n", raw)) if kind == b"n")
    streams = [zlib.decompress(x) for x in re.findall(rb"FlateDecode>>stream\n(.*?)\nendstream", raw, re.DOTALL)]
    assert layer.encode() in streams[0]
