"""Text recognition behind an adapter: one reading, the best of several, a run over all pages, and results found on disk.

An engine is any object with recognise(image, scale, psm) -> list of (text, confidence), which may raise, and
osd(image) -> str or None. None is installed here; the tests bring their own.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .revision import MAX_ATTEMPTS

# A page below this mean confidence is read again, in these ways (scale, layout mode).
GOOD_ENOUGH, SURE = 70, 70
OTHER_WAYS = [(1.0, 6), (1.0, 3), (0.6, 3), (0.6, 6)]

RESULTS = "page_id string, ocr_key string, attempts int, chars int, mean_conf double, sure_chars int, used_scale double, used_psm int, tried int, text string, error string, seconds double"


class Engine(Protocol):
    def recognise(self, image: bytes, scale: float, psm: int) -> list[tuple[str, float]]: ...

    def osd(self, image: bytes) -> str | None: ...


def reading(engine: Engine, image: bytes, scale: float, psm: int) -> dict:
    """One reading with its statistics; words of negative confidence are no words."""
    words = pd.DataFrame(engine.recognise(image, scale, psm), columns=["text", "conf"]).query("conf >= 0")
    n = words["text"].str.len()
    chars = int(n.sum())
    return {"chars": chars, "mean_conf": round(float((words["conf"] * n).sum() / chars), 1) if chars else 0.0, "sure_chars": int(n[words["conf"] >= SURE].sum()),
            "used_scale": scale, "used_psm": psm, "text": " ".join(words["text"])}


def best_reading(engine: Engine, image: bytes, scale: float, psm: int) -> dict:
    """The first reading if it is good enough, else, of it and the other ways, the one with most sure characters; the
    earlier one on ties. A way that fails is passed over, but the first must not fail."""
    found, tried = [reading(engine, image, scale, psm)], 1
    if found[0]["mean_conf"] < GOOD_ENOUGH:
        for way in OTHER_WAYS:
            if way == (scale, psm):
                continue
            tried += 1
            try:
                found.append(reading(engine, image, *way))
            except Exception:  # noqa: BLE001  whatever an engine raises
                continue
    return max(found, key=lambda r: r["sure_chars"]) | {"tried": tried}


def recognise_pages(pages: DataFrame, engine: Engine) -> DataFrame:
    """pages (page_id, ocr_key, image binary, scale, psm, attempts) -> a RESULTS row each. A page that fails is a row with its
    error and one attempt more; the others go on. Pages are independent, so a lost task reads its own again."""
    names = [c.split()[0] for c in RESULTS.split(", ")]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf.itertuples():
                start, row = time.monotonic(), {"page_id": p.page_id, "ocr_key": p.ocr_key, "attempts": 1 + (0 if pd.isna(p.attempts) else int(p.attempts))}
                try:
                    row |= best_reading(engine, p.image, float(p.scale), int(p.psm)) | {"attempts": 0}
                except Exception as e:  # noqa: BLE001  the row tells
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row | {"seconds": time.monotonic() - start})
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in ("attempts", "chars", "sure_chars", "used_psm", "tried")})

    return pages.select("page_id", "ocr_key", "image", "scale", "psm", "attempts").mapInPandas(over, RESULTS)


def adopt(pages: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, ocr_key, ...) and results found from an earlier run (page_id, ocr_key, error, attempts, exists, ...): the
    results that still hold, and the pages that are left to read, with the attempts made for the same content. A result
    holds if it is for the page's key and its file is there, or if it failed as often as is tried."""
    f = found.withColumnRenamed("page_id", "p").withColumnRenamed("ocr_key", "k")
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    holds = F.when(failed, F.coalesce("attempts", F.lit(1)) >= MAX_ATTEMPTS).otherwise(F.coalesce("exists", F.lit(False)))
    j = pages.select("page_id", "ocr_key").join(f, (F.col("page_id") == F.col("p")) & (F.col("ocr_key") == F.col("k"))).drop("p", "k")
    held = j.where(holds)
    tried = j.where(~holds & failed).select("page_id", F.col("attempts").alias("made"))
    left = pages.join(held.select("page_id"), "page_id", "left_anti").drop("attempts").join(tried, "page_id", "left")
    return held, left.withColumn("attempts", F.coalesce("made", F.lit(0))).drop("made")


def run_ocr(pages: DataFrame, found: DataFrame, engine: Engine) -> DataFrame:
    """RESULTS of all pages: what is found from earlier runs and still holds, and new readings of the rest."""
    held, left = adopt(pages, found)
    names = [c.split()[0] for c in RESULTS.split(", ")]
    return held.select(*names).unionByName(recognise_pages(left, engine))


def osd_votes(text: Column) -> Column:
    """struct(k, conf) from what orientation detection prints: quarter turns clockwise and how sure it is; null without."""
    turn = F.regexp_extract(text, r"Rotate:\s*([0-9]+)", 1).try_cast("int")
    sure = F.regexp_extract(text, r"Orientation confidence:\s*([0-9.]+)", 1).try_cast("double")
    return F.when(turn.isNotNull() & sure.isNotNull(), F.struct(F.pmod(F.bround(turn / 90).cast("int"), F.lit(4)).alias("k"), sure.alias("conf")))
