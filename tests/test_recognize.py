"""Recognition with a made-up engine, pages made anew, edits of frames and geometry, logs and lists."""

import pytest
from pyspark.sql import functions as F

from leafwright.operators import edits, evaluate, pages, recognize
from leafwright.sources import files


def Fake():  # noqa: N802  made here, so that workers need not import the tests
    class Engine:
        """Reads b"word word|conf" at full size; b"hard" only in one other way; b"bad" never."""

        def recognise(self, image, scale, psm):
            if image == b"bad" or (image == b"hard" and (scale, psm) == (1.0, 3)):
                raise RuntimeError("engine stopped")
            if image == b"hard":
                return [("sure", 90.0), ("thing", 80.0)] if (scale, psm) == (0.6, 3) else [("sure", 75.0), ("x", 10.0), ("", -1.0)]
            words, conf = image.decode().split("|")
            return [(w, float(conf)) for w in words.split()]

        def osd(self, image):
            return None

    return Engine()


def test_best_reading():
    good = recognize.best_reading(Fake(), b"ab cde|88.25", 1.0, 3)
    assert (good["chars"], good["mean_conf"], good["sure_chars"], good["tried"], good["text"]) == (5, 88.2, 5, 1, "ab cde")
    hard = recognize.best_reading(Fake(), b"hard", 1.0, 6)
    assert (hard["used_scale"], hard["used_psm"], hard["sure_chars"], hard["tried"]) == (0.6, 3, 9, 4)
    poor = recognize.best_reading(Fake(), b"ab|20", 1.0, 3)
    assert (poor["used_scale"], poor["used_psm"], poor["tried"]) == (1.0, 3, 4)  # ties stay with the first
    empty = recognize.best_reading(Fake(), b"|50", 1.0, 3)
    assert (empty["chars"], empty["mean_conf"]) == (0, 0.0)
    with pytest.raises(RuntimeError):
        recognize.best_reading(Fake(), b"bad", 1.0, 3)


def test_run_ocr(spark):
    todo = [("p1", "k1", b"ab|90", 1.0, 3), ("p2", "k2", b"bad", 1.0, 3), ("p3", "k3", b"hard", 1.0, 6), ("p4", "k4", b"bad", 1.0, 3), ("p5", "k5", b"ab|90", 1.0, 3), ("p6", "k6", b"ab|90", 1.0, 3)]
    p = spark.createDataFrame([(*t, 0) for t in todo], "page_id string, ocr_key string, image binary, scale double, psm int, attempts int")
    result = lambda i, k, n=0, error=None, exists=True: (i, k, n, 7, 99.0, 7, 1.0, 3, 1, "found", error, 0.0, exists)
    found = spark.createDataFrame([result("p1", "k1"), result("p2", "k2", 1, "stopped", False), result("p4", "k4", 2, "stopped", False), result("p5", "old"), result("p6", "k6", exists=False)], recognize.RESULTS + ", exists boolean")
    got = {r.page_id: r for r in recognize.run_ocr(p, found, Fake()).collect()}
    assert len(got) == 6 and got["p1"].text == "found" and got["p5"].text == "ab" == got["p6"].text  # a result for other content, or without its file, does not hold
    assert got["p2"].attempts == 2 and got["p2"].error == "RuntimeError: engine stopped" and got["p4"].error == "stopped"  # tried often enough
    assert got["p3"].used_scale == 0.6 and got["p3"].attempts == 0 and got["p3"].error is None
    again = recognize.adopt(p, spark.createDataFrame([(*[got[i][c] for c in got[i].__fields__], True) for i in got], found.schema))
    assert again[0].count() == 6 and again[1].count() == 0
    assert recognize.run_ocr(p.limit(0), found.limit(0), Fake()).count() == 0


def test_osd(spark):
    texts = ["Page number: 0\nRotate: 270\nOrientation confidence: 4.50\n", "Rotate: 90", "", None, "Rotate: 0\nOrientation confidence: 0.1"]
    got = [r.v and tuple(r.v) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(recognize.osd_votes(F.col("t")).alias("v")).collect()]
    assert got == [(3, 4.5), None, None, None, (0, 0.1)]


def test_carry_over(spark):
    schema = "id string, segment_id string, revision string, include boolean, printed_number string, acknowledged array<string>, image_only_ok boolean, ocr_key string, active boolean"
    old = spark.createDataFrame([("a-L", "a", "r1", False, "7", ["x"], True, "k", True), ("a-R", "a", "r1", True, None, ["y"], True, "k", True), ("b-S", "b", "r1", True, None, [], False, "k", True), ("c-S", "c", "r1", True, None, [], False, "k", True)], schema)
    made = spark.createDataFrame([("a-L", "a", "r2"), ("d-S", "d", "r1"), ("a-X", "a", "r2")], "id string, segment_id string, revision string")
    t = spark.createDataFrame([("a",), ("b",), ("d",)], "segment_id string")
    got = {r.id: r for r in pages.carry_over(old, made, t).collect()}
    a = got["a-L"]
    assert (a.include, a.printed_number, a.acknowledged, a.image_only_ok, a.ocr_key, a.active) == (False, "7", [], False, None, True)
    assert not got["a-R"].active and got["a-R"].acknowledged == ["y"] and got["b-S"].active and not got["c-S"].active
    assert got["d-S"].include and got["d-S"].active and set(got) == {"a-L", "a-R", "a-X", "b-S", "c-S", "d-S"}
    same = pages.carry_over(old, made.selectExpr("id", "segment_id", "'r1' AS revision"), t).where("id = 'a-L'").first()
    assert (same.acknowledged, same.image_only_ok, same.ocr_key) == (["x"], True, "k")


def test_frames_and_geometry(spark):
    seg = spark.createDataFrame([("s1", "v", 0.0, 1.0, ["f1"], "f1", False, False), ("s2", "v", 2.0, 3.0, None, None, False, None)], "id string, video_id string, start double, end double, candidates array<string>, chosen string, include boolean, manual boolean")
    new = spark.createDataFrame([(1, "f8", "v", 0.5, "s1"), (2, "f9", "v", 0.6, "s1"), (3, "f7", "v", 9.0, None), (4, "f6", "v", 1.0, "gone")], "seq int, frame_id string, video_id string, t double, segment_id string")
    got = {r.id: r for r in edits.add_frames(seg, new).collect()}
    assert got["s1"].candidates == ["f1", "f8", "f9"] and got["s1"].chosen == "f9" and got["s1"].include and got["s1"].manual
    assert got["s2"].candidates is None and not got["s2"].manual and len(got) == 3
    assert (got["m-f7"].start, got["m-f7"].end, got["m-f7"].chosen) == (9.0, 9.0, "f7")
    g = "struct<frame_id:string,bbox:array<int>,gutter_x:int>"
    s = spark.createDataFrame([("a", "f1", 100, 50, None, ("f1", [5, 5, 90, 45], 48)), ("b", "f2", 100, 50, ("f1", [1, 1, 2, 2], 1), None), ("c", None, 100, 50, None, None), ("d", "f1", 100, 50, ("f1", [0, 0, 50, 50], 20), None), ("e", "f1", 9, 9, None, None)],
                              f"id string, chosen string, width int, height int, geometry {g}, auto {g}")
    c = spark.createDataFrame([("a", False, None, 0.3), ("b", False, [10, 0, 60, 50], None), ("c", False, None, 0.5), ("d", True, None, None)], "id string, clear boolean, bbox array<int>, gutter_ratio double")
    out = {r.id: (r.geometry and tuple(r.geometry), r.error) for r in edits.set_geometry(s, c).collect()}
    assert out == {"a": (("f1", [5, 5, 90, 45], 30), None), "b": (("f2", [10, 0, 60, 50], None), None), "c": (None, "no chosen frame"), "d": (None, None), "e": (None, None)}
    wide = edits.set_geometry(s, c.selectExpr("id", "false AS clear", "bbox", "0.99D AS gutter_ratio").where("id = 'a'")).where("id = 'a'").first()
    assert wide.error == "the fold is outside the page" and wide.geometry is None
    assert edits.set_geometry(s, c, spread=False).where("id = 'a'").first().geometry.gutter_x is None


def test_overlaps_and_worst(spark):
    a = spark.createDataFrame([(0, 0.0, 10.0, 1), (0, 10.0, 10.0, 2), (1, 0.0, 500.0, 3)], "video_id long, start double, end double, n int")
    b = spark.createDataFrame([(0, 10.0, 12.0, 7), (0, 2.0, 3.0, 8), (1, 499.0, 900.0, 9), (2, 0.0, 1.0, 10)], "video_id long, start double, end double, m int")
    for width in (1.0, 7.0, 1000.0):
        pairs = lambda closed: sorted((r.n, r.r_m) for r in evaluate.overlapping(a, b, width, closed).collect())  # noqa: E731, B023
        assert pairs(True) == [(1, 7), (1, 8), (2, 7), (3, 9)] and pairs(False) == [(1, 8), (3, 9)]
    rows = spark.createDataFrame([(i, i % 2, (i * 7) % 5 / 1.0) for i in range(20)], "id long, k long, v double")
    assert [r.id for r in evaluate.worst(rows, "v", "id", 3).collect()] == [0, 5, 10]
    assert sorted((r.k, r.id) for r in evaluate.worst(rows, "v", "id", 2, "k").collect()) == [(0, 0), (0, 10), (1, 5), (1, 15)]


def test_event_tail(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    files.append_event(path, "start", n=1)
    tail = files.EventTail(spark, path)
    with open(path, "ab") as f:
        f.write('{"t": 2.0, "pid": 1, "event": "é"'.encode())
    assert [r.event for r in tail.read().collect()] == ["start"] and tail.read().count() == 0
    with open(path, "ab") as f:
        f.write(b"}\n\nno json\n")
    files.append_event(path, "end")
    assert [r.event for r in tail.read().collect()] == ["é", "end"]
    assert [r.event for r in files.event_log(spark, path).orderBy("t").collect()] == ["é", "start", "end"]


def test_list_encodings(spark, tmp_path):
    for name, encoding in (("a", "utf-8-sig"), ("b", "cp932")):
        (tmp_path / f"{name}.csv").write_bytes("ID,取引先\r\np1,みどり商店\r\n".encode(encoding))
        got = files.receipt_list(spark, str(tmp_path / f"{name}.csv"))
        assert [tuple(r) for r in got.select("ID", "取引先").collect()] == [("p1", "みどり商店")]
    with pytest.raises(ValueError):
        files.receipt_list(spark, str(tmp_path / "a.csv"), most=3)
