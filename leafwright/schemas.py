"""Explicit schemas of the entities, as DDL, and the gate on their version."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMA_VERSION = 1

VIDEOS = (
    "id string, original_name string, path string, copied boolean, sha256 string, size bigint, container string, codec string, width int, height int, "
    "pix_fmt string, time_base string, avg_rate string, duration_sec double, rotation int, color_trc string, color_primaries string, colorspace string, "
    "hdr boolean, hdr_kind string, high_bit_depth boolean, warnings array<string>, acknowledged array<string>, "
    "content_rotation struct<k:int,mode:string,decided:boolean,votes:array<struct<k:int,conf:double>>>, "
    "analysis struct<analyzed:string,frames:int,threshold:double,motion_p30:double,still_runs:int,error:string,elapsed_sec:double>")

SEGMENTS = (
    "id string, video_id string, start_sec double, end_sec double, duration_sec double, candidates array<string>, chosen string, include boolean, manual boolean, "
    "duplicate_of string, warnings array<string>, flags array<string>, source string, acknowledged array<string>, "
    "match_prev struct<segment:string,inliers:int,keypoints:int>, manual_geometry struct<frame_id:string,bbox:array<int>,gutter_x:int>, "
    "page_options map<string,string>, rotation_rev int")

FRAMES = (
    "id string, video_id string, pts bigint, time_sec double, path string, thumb string, width int, height int, rotation_applied int, content_rotation_k int, "
    "scores struct<sharpness:double,motion:double,brightness:double,signature_diff:double>, warnings array<string>, source string, original_name string")

PAGES = (
    "id string, segment_id string, side string, frame_id string, image string, thumb string, width int, height int, dpi int, skew_deg double, line_pitch_px double, "
    "revision string, include boolean, active boolean, warnings array<string>, acknowledged array<string>, image_only_ok boolean, printed_number string, updated string, "
    "ocr struct<key:string,revision:string,attempts:int,lang:string,psm:int,scale:double,pdf:string,txt:string,tsv:string,chars:int,mean_conf:double,sure_chars:int,"
    "used_scale:double,used_psm:int,tried:int,text_min_conf:double,error:string,elapsed_sec:double>, "
    "receipt struct<auto:struct<fields:map<string,string>,evidence:map<string,string>,candidates:array<string>,checks:array<string>,reread:map<string,string>,"
    "total_disagree:array<bigint>,date_reread:string,date_disagree:array<string>,ocr_key:string,time:string>,manual:map<string,string>,manual_source:string,manual_time:string>")

WORDS = ("level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf string, text string")

EXPORTS = (
    "time string, path string, pages int, forced boolean, image_only_pages array<string>, unresolved int, revisions map<string,string>, order array<string>, "
    "sha256 string, verify string, receipt_files map<string,string>")


def check_version(meta: DataFrame) -> None:
    """meta holds one row (schema_version); any other version than ours is refused."""
    found = [r[0] for r in meta.select("schema_version").limit(2).collect()]
    if found != [SCHEMA_VERSION]:
        raise ValueError(f"schema_version {found} is not {SCHEMA_VERSION}")
