"""Spreads to pages: a flat map over encoded grey images, with warnings, skew and pitch per side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import images

PAGES = "segment_id long, side string, box array<int>, warnings array<string>, skew_deg double, line_pitch_px double, reading int, error string"


def split_pages(spreads: DataFrame, layout: str = "spread", direction: str = "ltr") -> DataFrame:
    """spreads (segment_id, height, width, grey binary) -> one or two rows each, in reading order; a spread whose bytes
    do not fit its size is an error row. Only boxes and numbers leave the map stage, never pixels."""

    def over(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    img = np.frombuffer(r.grey, np.uint8).reshape(int(r.height), int(r.width)).astype(float)
                    out += [(r.segment_id, p["side"], p["box"], p["warnings"], p["skew"], p["pitch"], n, None) for n, p in enumerate(images.split_spread(img, layout, direction))]
                except (TypeError, ValueError) as e:
                    out.append((r.segment_id, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return spreads.select("segment_id", "height", "width", "grey").mapInPandas(over, PAGES)


KEPT = ("include", "printed_number")  # whatever a page becomes
KEPT_WHILE_SAME = ("acknowledged", "image_only_ok", "ocr_key")  # of what was confirmed or read


def carry_over(old: DataFrame, made: DataFrame, targets: DataFrame) -> DataFrame:
    """The table of pages after some were made anew.

    old: id, segment_id, revision, include, printed_number, acknowledged, image_only_ok, ocr_key, active. made: id,
    segment_id, revision of new pages. targets: segment_id of all segments that are in. A new page takes over what was
    set by hand, and what was confirmed or read only if its revision is the same. Nothing is deleted: pages that their
    segment no longer yields, or whose segment is out, are inactive."""
    past = old.select(F.col("id").alias("o_id"), F.col("revision").alias("o_revision"), *[F.col(c).alias(f"o_{c}") for c in (*KEPT, *KEPT_WHILE_SAME)])
    same = F.col("o_revision") == F.col("revision")
    none = F.array().cast("array<string>")
    new = made.select("id", "segment_id", "revision").join(past, F.col("id") == F.col("o_id"), "left")
    new = new.select("id", "segment_id", "revision", F.coalesce("o_include", F.lit(True)).alias("include"), F.col("o_printed_number").alias("printed_number"),
                     F.coalesce(F.when(same, F.col("o_acknowledged")), none).alias("acknowledged"), F.coalesce(F.when(same, F.col("o_image_only_ok")), F.lit(False)).alias("image_only_ok"),
                     F.when(same, F.col("o_ocr_key")).alias("ocr_key"), F.lit(True).alias("active"))
    redone = made.select(F.col("segment_id").alias("s")).distinct().withColumn("redone", F.lit(True))
    rest = old.join(made.select("id"), "id", "left_anti").join(redone, F.col("segment_id") == F.col("s"), "left")
    rest = rest.withColumn("active", F.coalesce("active", F.lit(True)) & F.col("redone").isNull()).select(*new.columns)
    both = new.unionByName(rest).join(targets.select(F.col("segment_id").alias("t")).distinct(), F.col("segment_id") == F.col("t"), "left")
    return both.withColumn("active", F.col("active") & F.col("t").isNotNull()).drop("t")
