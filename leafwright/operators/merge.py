"""Lists of receipts out to a reviewer and back: overlay, merge by id, acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import receipts

CHECKED_ACKS = ["receipt_regno_suspect", "receipt_amount_mismatch", "receipt_total_disagree", "receipt_date_disagree"]  # fixed values


def effective(records: DataFrame) -> DataFrame:
    """records (id, auto map, manual map) with one column per field: the manual value where there is one."""
    return records.select("id", *[receipts.overlay(F.col("auto"), F.col("manual"), k).alias(k) for k in receipts.FIELDS])


def merge_list(records: DataFrame, cells: DataFrame, as_of_year: int) -> DataFrame:
    """An edited list merged by id: (id, status, manual, manual_source, errors, acks).

    cells: id, state and a string column per field. Only cells that differ from the value in force become
    manual; a cell that cannot be typed is an error and the rest of its row still counts; a blank cell
    takes the override away, so the automatic value comes back. A state that names an AI makes the
    source ai; one that says the row was checked acknowledges the doubts. An id that is not there is an
    error of its own.
    """
    now = effective(records).select(F.col("id"), *[F.col(k).alias(f"now_{k}") for k in receipts.FIELDS])
    typed = cells.select("id", "state", *[receipts.coerce_column(k, F.col(k), as_of_year).alias(k) for k in receipts.FIELDS])
    j = typed.join(records, "id", "left").join(now, "id", "left").withColumn("known", F.col("auto").isNotNull())
    differs = F.filter(F.array(*[F.when(F.col(f"{k}.error").isNull() & ~F.col(f"{k}.value").eqNullSafe(F.col(f"now_{k}")), F.struct(F.lit(k).alias("k"), F.col(f"{k}.value").alias("v"))) for k in receipts.FIELDS]), lambda x: x.isNotNull())
    j = j.withColumn("changes", F.when(F.col("known"), F.map_from_entries(differs)).otherwise(F.create_map().cast("map<string,string>")))
    errors = F.array_compact(F.array(F.when(~F.col("known"), F.lit("unknown id")), *[F.when(F.col("known"), F.col(f"{k}.error")) for k in receipts.FIELDS]))
    manual = F.when(F.size("changes") > 0, receipts.set_fields(F.col("auto"), F.col("manual"), F.col("changes"))).otherwise(F.col("manual"))
    status = F.when(~F.col("known"), "error").when(F.size("changes") > 0, "changed").otherwise("unchanged")
    state = F.coalesce("state", F.lit(""))
    ai = F.contains(state, F.lit("AI"))
    j = j.withColumns({"errors": errors, "new_manual": manual, "status": status})
    source = F.when(F.col("status") == "changed", F.when(F.size("new_manual") > 0, F.when(ai, "ai").otherwise("import")))
    note = F.coalesce(receipts.overlay(F.col("auto"), F.col("new_manual"), "note"), F.lit(""))
    value = {k: receipts.overlay(F.col("auto"), F.col("new_manual"), k) for k in receipts.FIELDS}
    open_ = receipts.missing_codes(value["date"], value["total"].try_cast("bigint"), value["payee"], value["base10"].try_cast("bigint"), value["base8"].try_cast("bigint"), value["registration_no"])
    none = F.array().cast("array<string>")
    acks = F.array_sort(F.array_union(F.when(ai | F.contains(state, F.lit("確認済み")), F.array(*[F.lit(c) for c in CHECKED_ACKS])).otherwise(none), F.when(F.contains(note, F.lit("読めない")), open_).otherwise(none)))
    return j.select("id", "status", F.col("new_manual").alias("manual"), source.alias("manual_source"), "errors", F.when(F.col("known"), acks).otherwise(none).alias("acks"))


def arbitrate(records: DataFrame) -> DataFrame:
    """(id, total, date, total_disagree, date_disagree) of two readings: amounts come from the second wherever the lines were
    read again; totals disagree when both are there and differ; dates when the second differs, missing included."""
    total = F.coalesce("total2", "total1")
    t = F.when(F.col("total1").isNotNull() & F.col("total2").isNotNull() & (F.col("total1") != F.col("total2")), F.array("total1", "total2"))
    d = F.when(F.col("reread") & ~F.col("date1").eqNullSafe(F.col("date2")), F.array(F.coalesce("date1", F.lit("")), F.coalesce("date2", F.lit(""))))
    return records.select("id", total.alias("total"), F.col("date1").alias("date"), t.alias("total_disagree"), d.alias("date_disagree"))


def settings(spark, defaults: dict[str, str], preset: dict[str, str], explicit: dict[str, str | None]) -> DataFrame:
    """(key, value) of defaults, then explicit values that are not null, then a preset that cannot be overridden."""
    rows = [(k, v, 0) for k, v in defaults.items()] + [(k, v, 1) for k, v in explicit.items() if v is not None] + [(k, v, 2) for k, v in preset.items()]
    return spark.createDataFrame(rows, "key string, value string, rank int").groupBy("key").agg(F.max_by("value", "rank").alias("value"))
