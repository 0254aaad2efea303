"""Edits and their rules."""

import pytest
from pyspark.sql import functions as F

from leafwright import codes
from leafwright.operators import edits, merge, ordering, review, revision


def test_segment_edits(spark):
    seg = spark.createDataFrame([("a", ["f1", "f2"], "f1", False, "z", ["blur"]), ("b", [], None, False, None, ["blur", "short_still"]), ("c", None, None, True, None, None)], "id string, candidates array<string>, chosen string, include boolean, duplicate_of string, warnings array<string>")
    e = spark.createDataFrame([(1, "a", "choose", "f9"), (2, "a", "choose", "f2"), (3, "a", "include", "true"), (4, "b", "include", "true"), (5, "b", "ack", "*"), (6, "b", "unack", "blur")], "seq int, id string, field string, value string")
    got = {r.id: (r.chosen, r.include, r.duplicate_of, r.acknowledged, r.error) for r in edits.apply_segment_edits(seg, e).collect()}
    assert got == {"a": ("f2", True, None, ["blur"], ""), "b": (None, False, None, ["short_still"], "no candidates"), "c": (None, True, None, [], "")}


def test_settings():
    assert edits.check_setting("layout", "single") == "single" and edits.check_setting("page_height_mm", "210") == 210.0 and edits.check_setting("motion_threshold", "") is None and edits.check_setting("content_rotation", "450") == 90
    for key, bad in (("layout", "three"), ("min_still_sec", ""), ("page_height_mm", "x")):
        with pytest.raises(ValueError):
            edits.check_setting(key, bad)


def test_review_skips_and_orders(spark):
    c = "id string, pos int, warnings array<string>, acknowledged array<string>"
    v = spark.createDataFrame([("v", 0, ["hdr_hlg", "hdr_pq"], None)], c)
    s = spark.createDataFrame([("s1", 0, ["blur"], None, "x"), ("s2", 1, ["no_paper", "blur"], [], None), ("s3", 2, ["blur", "unknown"], ["blur"], None)], c + ", duplicate_of string")
    p = spark.createDataFrame([("p", 0, ["blur", "duplicate"], None, ["blur", "ocr_failed"])], c + ", extra array<string>")
    got = [(r.kind, r.id, r.codes) for r in review.review_items(v, s, p, 2).orderBy("rank", "pos").collect()]
    assert got == [("video", "v", ["hdr_pq"]), ("segment", "s3", ["unknown"]), ("page", "p", ["blur", "ocr_failed"]), ("project", "page_count", ["page_count_mismatch"])]
    assert review.review_items(v, s, p, 2, acknowledged=True).count() == 3 and codes.table(spark).count() == 39
    gate = review.export_gate(review.review_items(v, s, p), force=True).first()
    assert gate.allowed and gate.forced


def test_revisions_are_canonical_json(spark):
    import hashlib
    import json

    key = {"frame": 'f"1', "layout": "spread", "direction": "ltr", "enhance": "none", "dewarp": "auto", "margins": "content_box", "page_height_mm": 257.0, "geometry": None, "rotation_rev": 0, "split_version": 17}
    want = hashlib.sha1(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]
    lit = F.lit
    got = spark.range(1).select(revision.page_revision(lit('f"1'), lit("spread"), lit("ltr"), lit("none"), lit("auto"), lit("content_box"), lit("257.0"), lit(None).cast("string"), lit(0))).first()[0]
    assert got == want


def test_order_edges(spark):
    nat = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos int")
    assert [r.id for r in ordering.update_order(nat, None).orderBy("pos").collect()] == ["a", "b", "c"]
    assert [r.id for r in ordering.move(nat, F.lit("c"), -9).orderBy("pos").collect()] == ["c", "a", "b"]
    assert ordering.is_permutation(nat.limit(0), nat.limit(0)).first().ok and not ordering.is_permutation(nat.limit(2), nat).first().ok


def test_arbitration(spark):
    df = spark.createDataFrame([(1, 5, 6, "d", None, True), (2, 5, None, "d", "d", True), (3, None, 7, "d", None, False)], "id int, total1 long, total2 long, date1 string, date2 string, reread boolean")
    got = {r.id: (r.total, r.total_disagree, r.date_disagree) for r in merge.arbitrate(df).collect()}
    assert got == {1: (6, [5, 6], ["d", ""]), 2: (5, None, None), 3: (7, None, None)}
