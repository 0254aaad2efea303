"""Identity by content: revisions and keys, and which rows are stale under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_VERSION, OCR_VERSION, MAX_ATTEMPTS = 17, 7, 2  # fixed values


def canonical(**fields: Column) -> Column:
    """Sorted-key JSON with ", " and ": " between parts and null for null. Values are JSON texts (see q)."""
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def q(text: Column) -> Column:
    """A string as JSON text; null stays null."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'([\\"])', r"\\$1"), F.lit('"'))


def key16(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def page_revision(frame: Column, layout: Column, direction: Column, enhance: Column, dewarp: Column, margins: Column, height: Column,
                  geometry: Column, rotation_rev: Column, receipt_width: Column | None = None) -> Column:
    """First 16 hex digits of the SHA-1 of what a page is made from. geometry is JSON text or null."""
    fields = {"frame": q(frame), "layout": q(layout), "direction": q(direction), "enhance": q(enhance), "dewarp": q(dewarp), "margins": q(margins),
              "page_height_mm": height.cast("string"), "geometry": geometry, "rotation_rev": rotation_rev.cast("string"), "split_version": F.lit(str(SPLIT_VERSION))}
    if receipt_width is not None:
        fields["receipt_width_mm"] = receipt_width.cast("string")
    return key16(canonical(**fields))


def ocr_key(revision: Column, lang: Column, psm: Column, scale: Column) -> Column:
    return key16(canonical(revision=q(revision), ocr_version=F.lit(str(OCR_VERSION)), lang=q(lang), psm=psm.cast("string"), scale=scale.cast("string")))


def ocr_current(key: Column, wanted: Column, error: Column, attempts: Column, artefact: Column) -> Column:
    """Done for the current content: the key agrees, and either it failed often enough or the artefact is there."""
    return F.coalesce(key == wanted, F.lit(False)) & F.when(error.isNotNull() & (error != ""), F.coalesce(attempts, F.lit(1)) >= MAX_ATTEMPTS).otherwise(F.coalesce(artefact, F.lit(False)))


def stale_segments(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Included segments with a chosen frame (segment_id, revision) whose active pages are not all current; no page is stale."""
    p = pages.where(F.coalesce("active", F.lit(True))).groupBy(F.col("segment_id").alias("s"), F.col("revision").alias("r")).agg(F.count("*").alias("n"), F.bool_and("exists").alias("there"))
    per = p.groupBy("s").agg(F.count("*").alias("revisions"), F.max("r").alias("r"), F.bool_and("there").alias("there"))
    j = segments.where("include and chosen is not null").join(per, F.col("segment_id") == F.col("s"), "left")
    current = F.coalesce((F.col("revisions") == 1) & (F.col("r") == F.col("revision")) & F.col("there"), F.lit(False))
    return j.where(~current).select("segment_id", "revision")


def pending(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Ids to work on: segments without a page, and included pages whose revision or recognition is stale."""
    s = segments.where("include and chosen is not null").select(F.col("segment_id").alias("s"), "revision")
    p = pages.where(F.coalesce("active", F.lit(True)) & F.col("include")).select("page_id", "segment_id", F.col("revision").alias("r"), "ocr_ok")
    j = s.join(p, F.col("s") == F.col("segment_id"), "left")
    return j.where("page_id is null or r <> revision or not ocr_ok").select(F.coalesce("page_id", "s").alias("id"), F.when(F.col("page_id").isNull(), "segment").otherwise("page").alias("kind"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files by content: one row per sha256, the first by name, none that is known."""
    from pyspark.sql import Window

    w = Window.partitionBy("sha256").orderBy("name")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(known.select("sha256").distinct(), "sha256", "left_anti")
