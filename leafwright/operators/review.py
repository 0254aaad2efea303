"""The rule set that lists what must be looked at before an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes


def ocr_warnings(error: Column, artefact: Column, warnings: Column, chars: Column, mean_conf: Column) -> Column:
    """The code, if any, that a page's recognition earns."""
    failed = (error.isNotNull() & (error != "")) | ~F.coalesce(artefact, F.lit(False))
    code = (F.when(failed, "ocr_failed").when(F.array_contains(warnings, "blank_page"), F.lit(None)).when(chars < 5, "ocr_no_text").when(mean_conf < 60, "ocr_low_conf"))
    return F.array_compact(F.array(code))


def review_items(videos: DataFrame, segments: DataFrame, pages: DataFrame, expected_pages: int | None = None, acknowledged: bool = False) -> DataFrame:
    """(kind, id, codes, labels, rank, pos): what blocks, in order.

    videos: id, warnings, acknowledged, pos. segments: also duplicate_of; merged duplicates and scenes
    without paper are passed over. pages, in output order pos: also extra (codes of recognition and
    receipt). A page count other than the expected is an item of its own."""
    none = F.array().cast("array<string>")
    v = videos.select(F.lit("video").alias("kind"), "id", codes.open_blocking(F.col("warnings"), F.col("acknowledged")).alias("codes"), F.lit(0).alias("rank"), F.col("pos").cast("long"))
    s = segments.where("duplicate_of is null").where(~F.array_contains(F.coalesce("warnings", none), "no_paper"))
    s = s.select(F.lit("segment").alias("kind"), "id", codes.open_blocking(F.col("warnings"), F.col("acknowledged")).alias("codes"), F.lit(1).alias("rank"), F.col("pos").cast("long"))
    both = F.concat(F.coalesce("warnings", none), F.coalesce("extra", none))
    p = pages.select(F.lit("page").alias("kind"), "id", codes.open_blocking(both, F.col("acknowledged")).alias("codes"), F.lit(2).alias("rank"), F.col("pos").cast("long"))
    out = v.unionByName(s).unionByName(p).where(F.size("codes") > 0)
    if expected_pages and not acknowledged:
        n = pages.agg(F.count("*").alias("n")).where(F.col("n") != expected_pages)
        out = out.unionByName(n.select(F.lit("project").alias("kind"), F.lit("page_count").alias("id"), F.array(F.lit("page_count_mismatch")).alias("codes"), F.lit(3).alias("rank"), F.lit(0).cast("long").alias("pos")))
    return out.withColumn("labels", codes.labels(F.col("codes")))


def export_gate(items: DataFrame, force: bool = False) -> DataFrame:
    """One row (unresolved, allowed, forced): an export is refused while items are open, unless forced."""
    n = items.agg(F.count("*").alias("unresolved"))
    return n.select("unresolved", ((F.col("unresolved") == 0) | F.lit(force)).alias("allowed"), (F.lit(force) & (F.col("unresolved") > 0)).alias("forced"))


def image_only(error: Column, allowed: Column, acknowledged: Column, force: bool = False) -> Column:
    """How a page goes out: text, image_only where recognition failed but that is allowed, or refused."""
    failed = error.isNotNull() & (error != "")
    return F.when(~failed, "text").when(F.coalesce(allowed, F.lit(False)) | F.array_contains(F.coalesce(acknowledged, F.array().cast("array<string>")), "ocr_failed") | F.lit(force), "image_only").otherwise("refused")


def acknowledge(current: Column, more: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(current, F.array().cast("array<string>")), more))
