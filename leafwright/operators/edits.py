"""Edits as an append-only table: the state in force, what an edit invalidates, and where added rows go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """edits (seq, keys, field, value) -> per key the last value of each field; a map-side aggregate, no sort."""
    return edits.groupBy(*keys).agg(*[F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.col("seq")))["value"].alias(f) for f in fields])


def apply_segment_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, chosen, include, duplicate_of, acknowledged, error) of segments after edits (seq, id, field, value).

    field is choose, include (true or false), ack or unack (a code or *). The last edit of a kind counts,
    and a code is acknowledged if its last ack is later than its last unack (and either * stands for all).
    A candidate must belong to its segment and a segment to be included must have candidates, else the edit
    is an error and changes nothing. Including by hand acknowledges the segment's warnings and clears
    duplicate_of."""
    none = F.array().cast("array<string>")
    last = latest(edits, ["id"], ["choose", "include"]).withColumnRenamed("include", "set_include")
    acks = edits.where("field in ('ack', 'unack')").groupBy("id", F.col("value").alias("code")).agg(F.max(F.when(F.col("field") == "ack", F.col("seq"))).alias("on"), F.max(F.when(F.col("field") == "unack", F.col("seq"))).alias("off"))
    acks = acks.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("on", "off")))).alias("acks"))
    j = segments.join(last, "id", "left").join(acks, "id", "left")
    bad_choice = F.coalesce(F.col("choose").isNotNull() & ~F.array_contains(F.coalesce("candidates", none), F.col("choose")), F.lit(False))
    wants = F.col("set_include") == "true"
    bad_include = F.coalesce(wants & (F.size(F.coalesce("candidates", none)) == 0), F.lit(False))
    by_hand = F.coalesce(wants & ~bad_include, F.lit(False))

    def held(code):
        one, all_ = F.try_element_at("acks", code), F.try_element_at("acks", F.lit("*"))
        on = F.greatest(F.coalesce(one["on"], F.lit(-1)), F.coalesce(all_["on"], F.lit(-1)))
        off = F.greatest(F.coalesce(one["off"], F.lit(-1)), F.coalesce(all_["off"], F.lit(-1)))
        return on > off

    warned = F.coalesce("warnings", none)
    acked = F.filter(warned, lambda c: by_hand | F.when(F.col("acks").isNull(), F.lit(False)).otherwise(held(c)))
    error = F.concat_ws(",", F.when(bad_choice, "no such candidate"), F.when(bad_include, "no candidates"))
    return j.select("id", F.when(F.col("choose").isNotNull() & ~bad_choice, F.col("choose")).otherwise(F.col("chosen")).alias("chosen"),
                    F.when(F.col("set_include").isNull() | bad_include, F.col("include")).otherwise(wants).alias("include"),
                    F.when(~by_hand, F.col("duplicate_of")).alias("duplicate_of"), F.array_sort(acked).alias("acknowledged"), error.alias("error"))


def rotate(frames: DataFrame, segments: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (video_id, k) of 90 degrees: frames with their sides swapped for odd k, and segments without manual geometry,
    with a new rotation_rev and no doubt about orientation; other videos stay as they are."""
    t = turns.select(F.col("video_id").alias("v"), F.pmod("k", F.lit(4)).alias("k")).where("k <> 0")
    f = frames.join(t, F.col("video_id") == F.col("v"), "left")
    odd = F.coalesce(F.col("k") % 2 == 1, F.lit(False))
    f = f.select(*[c for c in frames.columns if c not in ("width", "height")], F.when(odd, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(odd, F.col("width")).otherwise(F.col("height")).alias("height"))
    s = segments.join(t, F.col("video_id") == F.col("v"), "left")
    hit = F.col("k").isNotNull()
    keep = [c for c in segments.columns if c not in ("rotation_rev", "geometry", "warnings")]
    s = s.select(*keep, (F.coalesce("rotation_rev", F.lit(0)) + hit.cast("int")).alias("rotation_rev"), F.when(~hit, F.col("geometry")).alias("geometry"),
                 F.when(hit, F.array_remove("warnings", "orientation_uncertain")).otherwise(F.col("warnings")).alias("warnings"))
    return f, s


def place_photos(segments: DataFrame, photos: DataFrame) -> DataFrame:
    """photos (seq, after) -> (seq, video_id, start): just after the end of the segment they are to follow; without one
    behind the last video, or, where there is no video, behind the last photo. Photos of one place keep their order."""
    a = segments.select(F.col("id").alias("after"), F.col("video_id").alias("v"), F.col("end").alias("e"))
    ends = segments.agg(F.max("video_id").alias("last_video"), F.max(F.when(F.col("video_id").isNull(), F.col("start"))).alias("last_photo"))
    j = photos.join(a, "after", "left").crossJoin(ends)
    found = F.col("e").isNotNull()
    n = F.row_number().over(Window.partitionBy(F.when(found, F.col("after"))).orderBy("seq"))
    start = F.when(found, F.col("e") + n * 0.001).when(F.col("last_video").isNotNull(), 1e9 + n).otherwise(F.coalesce("last_photo", F.lit(0.0)) + n)
    return j.select("seq", F.when(found, F.col("v")).otherwise(F.col("last_video")).alias("video_id"), start.alias("start"))


def add_frames(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """segments (id, video_id, start, end, candidates, chosen, include, manual) after frames (seq, frame_id, video_id, t,
    segment_id) were added by hand: each is the last candidate of its segment, and the last one of a segment is chosen; one
    without a segment makes a segment of no length at its time. An unknown segment is left out."""
    own = frames.where("segment_id is not null").groupBy(F.col("segment_id").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame_id"))), lambda x: x["frame_id"]).alias("more"))
    j = segments.join(own, F.col("id") == F.col("s"), "left")
    hit = F.col("more").isNotNull()
    kept = j.select("id", "video_id", "start", "end", F.when(hit, F.concat(F.coalesce("candidates", F.array().cast("array<string>")), "more")).otherwise(F.col("candidates")).alias("candidates"),
                    F.when(hit, F.element_at("more", -1)).otherwise(F.col("chosen")).alias("chosen"), (hit | F.col("include")).alias("include"), (hit | F.coalesce("manual", F.lit(False))).alias("manual"))
    new = frames.where("segment_id is null").select(F.concat(F.lit("m-"), "frame_id").alias("id"), "video_id", F.col("t").alias("start"), F.col("t").alias("end"), F.array("frame_id").alias("candidates"),
                                                    F.col("frame_id").alias("chosen"), F.lit(True).alias("include"), F.lit(True).alias("manual"))
    return kept.unionByName(new)


def set_geometry(segments: DataFrame, changes: DataFrame, spread: bool = True) -> DataFrame:
    """segments (id, chosen, width, height, geometry, auto) with geometry set or cleared by hand, and an error.

    geometry and auto: struct(frame_id, bbox array<int>, gutter_x int); they count only for the chosen frame. changes:
    (id, clear, bbox, gutter_ratio), one a segment. What a change leaves out comes from the geometry set before, else the
    automatic one, else the whole frame. A segment without a chosen frame, or a fold outside the page, is an error and
    changes nothing."""
    c = changes.select(F.col("id").alias("c_id"), F.coalesce("clear", F.lit(False)).alias("c_clear"), F.col("bbox").alias("c_bbox"), F.col("gutter_ratio").alias("c_ratio"))
    j = segments.join(c, F.col("id") == F.col("c_id"), "left")
    valid = lambda g: F.when(g["frame_id"] == F.col("chosen"), g)
    base = F.coalesce(valid(F.col("geometry")), valid(F.col("auto")))
    box = F.coalesce("c_bbox", base["bbox"], F.array(F.lit(0), F.lit(0), F.col("width"), F.col("height")))
    fold = F.coalesce(F.bround(F.col("c_ratio") * F.col("width")).cast("int"), base["gutter_x"]) if spread else F.lit(None).cast("int")
    sets = F.col("c_id").isNotNull() & ~F.col("c_clear")
    error = F.when(sets & F.col("chosen").isNull(), "no chosen frame").when(sets & fold.isNotNull() & ~((box[0] < fold) & (fold < box[2])), "the fold is outside the page")
    new = F.struct(F.col("chosen").alias("frame_id"), box.cast("array<int>").alias("bbox"), fold.alias("gutter_x"))
    out = F.when(sets & error.isNull(), new).when(~F.coalesce(F.col("c_clear"), F.lit(False)), F.col("geometry"))
    return j.select(*[F.col(x) for x in segments.columns if x != "geometry"], out.alias("geometry"), error.alias("error"))


# Settings with their kinds or allowed values.
SETTINGS = {"layout": ["spread", "single"], "direction": ["ltr", "rtl"], "document": ["book", "receipt"], "page_height_mm": float, "min_still_sec": float, "motion_threshold": float, "receipt_width_mm": float}
MAY_BE_BLANK = ("motion_threshold", "expected_pages")


def check_setting(key: str, value: str | None):
    """A setting from the edit surface as its type; ValueError for what it cannot be."""
    if value is None or value == "":
        if key in MAY_BE_BLANK:
            return None
        raise ValueError(f"{key} must not be blank")
    kind = SETTINGS.get(key)
    if kind is float:
        return float(value)
    if key == "content_rotation":
        return "auto" if value == "auto" else int(value) % 360
    if isinstance(kind, list) and value not in kind:
        raise ValueError(f"{key} is one of {', '.join(kind)}")
    return value
