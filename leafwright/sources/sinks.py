"""Writers: receipt lists for a reviewer, verification reports, export records, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.receipts import FIELDS, LABELS
from ..functions.scalars import name_part
from ..operators.ordering import numbered

COLUMNS = ["No", "ID", *[LABELS[k] for k in FIELDS], "状態", "画像", "要確認"]
STATES = {"manual": "手修正", "import": "一覧から修正", "ai": "AIが修正"}  # fixed values


def state_label(manual_size: Column, source: Column) -> Column:
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), source), F.lit("手修正"))
    return F.when(F.coalesce(manual_size, F.lit(0)) > 0, named).otherwise("自動")


def list_rows(receipts: DataFrame) -> DataFrame:
    """receipts (id, pos, the fields, state, labels) as the list's rows, numbered from 1 in output order."""
    r = numbered(receipts, [F.floor(F.col("pos") / 10_000)], ["pos", "id"], "No", 1)
    image = F.concat(F.format_string("%03d_", "No"), F.coalesce(F.regexp_replace(F.col("date").cast("string"), "-", ""), F.lit("日付不明")), F.lit("_"), name_part(F.col("payee")), F.lit("_"), F.coalesce(F.col("total").cast("string"), F.lit("")), F.lit(".jpg"))
    return r.select("No", F.col("id").alias("ID"), *[F.col(k).cast("string").alias(LABELS[k]) for k in FIELDS], F.col("state").alias("状態"), image.alias("画像"), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), "、").alias("要確認"))


def write_list(rows: DataFrame, path: str) -> None:
    """A list for spreadsheets: byte-order mark, CRLF, one header, rows in order of No.

    Lines are made in Spark and written as text, so the list itself never passes through the driver."""
    def cell(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)

    line = F.concat_ws(",", *[cell(F.col(f"`{c}`")) for c in rows.columns])
    head = rows.sparkSession.createDataFrame([(0, "﻿" + ",".join(rows.columns))], "n int, line string")
    body = rows.select(F.col("No").alias("n"), line.alias("line"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in by key; what rows has replaces what was there."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def most_recent(rows: DataFrame, key: str, time: str, n: int = 20) -> DataFrame:
    """The n keys used last, each once."""
    return rows.groupBy(key).agg(F.max(time).alias(time)).orderBy(F.desc(time), key).limit(n)


def export_record(pages: DataFrame, path: str, forced: bool, time: str) -> DataFrame:
    """One row for the table of exports: the pages in order, their revisions, and which go out as images."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "revision"))), lambda x: F.struct(x["id"], x["revision"]))
    p = pages.agg(F.count("*").cast("int").alias("pages"), ordered.alias("o"), F.array_sort(F.collect_list(F.when(F.col("how") == "image_only", F.col("id")))).alias("image_only_pages"))
    return p.select(F.lit(time).alias("time"), F.lit(path).alias("path"), "pages", F.lit(forced).alias("forced"), "image_only_pages", F.map_from_entries("o").alias("revisions"), F.transform("o", lambda x: x["id"]).alias("order"))


def verify(pages: DataFrame, terms: DataFrame, expected_pages: int) -> DataFrame:
    """One row (page_count_ok, empty_pages, terms, found, missing) for exported page texts and expected words."""
    p = pages.agg(F.count("*").alias("n"), F.count_if(F.length(F.coalesce("text", F.lit(""))) == 0).alias("empty_pages"))
    j = terms.join(pages.select("page_id", "text"), "page_id", "left")
    hit = F.coalesce(F.contains(F.lower("text"), F.lower("term")), F.lit(False))
    t = j.agg(F.count("*").alias("terms"), F.count_if(hit).alias("found"), F.array_sort(F.collect_list(F.when(~hit, F.concat("page_id", F.lit(":"), "term")))).alias("missing"))
    return p.crossJoin(t).select((F.col("n") == expected_pages).alias("page_count_ok"), "empty_pages", "terms", "found", "missing")
