"""Readers: files by content, word tables, lists, terms, truth files, event logs, entity documents."""

from __future__ import annotations

import csv
import io
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas

MAGIC = [("png", "89504E47"), ("jpeg", "FFD8FF"), ("mp4", "66747970"), ("matroska", "1A45DFA3"), ("pdf", "25504446")]  # fixed values


def probe(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files by content, not suffix: path, length, modified, kind, sha256, error. A file of no known kind is an
    error row; the reader passes over files without bytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring(F.col("content"), 1, 12))
    kind = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        kind = F.when(F.contains(head, F.lit(magic)), name).otherwise(kind)
    f = f.select("path", "length", F.col("modificationTime").alias("modified"), kind.alias("kind"), F.sha2("content", 256).alias("sha256"))
    return f.withColumn("error", F.when(F.col("kind").isNull(), "not a known kind"))


def list_photos(spark: SparkSession, path: str) -> DataFrame:
    """The photos of a folder by name, as they are to be added; content is not read, and files without bytes are passed over."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(path).select("path", "length")
    return f.withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name")


def check_sources(known: DataFrame, found: DataFrame) -> DataFrame:
    """known (path, size) whose file is gone or has another size: (path, problem)."""
    j = known.join(found.select("path", "length"), "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size"), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word tables, one file a page; quotes are ordinary letters. page_id is the file's name."""
    t = spark.read.schema(schemas.WORDS).option("sep", "\t").option("header", "true").option("quote", "").option("escape", "").option("mode", "PERMISSIVE").csv(path)
    return t.withColumn("page_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.tsv)?$", 1))


def page_sizes(table: DataFrame) -> DataFrame:
    return table.where("level = 1").select("page_id", "width", "height")


def receipt_list(spark: SparkSession, path: str, most: int = 20 << 20) -> DataFrame:
    """An edited list with its header, all columns text; a byte-order mark is taken off, and the column ID must be there.

    A list that is not UTF-8 is read in the older Japanese encoding, which Spark does not decode: it passes through the
    driver, as no list may be over `most` bytes."""
    found = spark.read.format("binaryFile").load(path)
    sizes = found.agg(F.count("*"), F.max("length"), F.bool_and(F.is_valid_utf8(F.col("content").cast("string")))).first()
    if not sizes[0] or sizes[1] > most:
        raise ValueError(f"there is no list, or it is over {most >> 20} MB")
    if sizes[2]:
        t = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    else:
        head, *rows = csv.reader(io.StringIO(found.select("content").first()[0].decode("cp932"), newline=""))
        cells = [[x or None for x in (*r, *[""] * len(head))[: len(head)]] for r in rows if r]
        t = spark.createDataFrame(cells, StructType([StructField(c, StringType()) for c in head]))
    t = t.toDF(*[c.lstrip("\ufeff").strip() for c in t.columns])
    if "ID" not in t.columns:
        raise ValueError("the list has no column ID")
    return t


def terms(spark: SparkSession, path: str) -> DataFrame:
    """Expected words: (page_id, term) of a JSON object of arrays; keys that start with _ are comments."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    kept = m.select(F.explode(F.map_filter("m", lambda k, v: ~k.startswith("_"))).alias("page_id", "words"))
    return kept.select("page_id", F.explode("words").alias("term"))


def truth_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Truth files of page turns: a count, then start-end per line. (file, gt, a, b); a wrong count raises."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    t = t.withColumn("n", F.trim(F.element_at("lines", 1)).try_cast("int"))
    t = t.withColumn("lines", F.when(F.col("n").eqNullSafe(F.size("lines") - 1), F.col("lines")).otherwise(F.raise_error(F.concat(F.lit("the count does not fit in "), "file"))))
    rows = t.select("file", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("gt", "line"))
    ends = F.split("line", "-")
    return rows.select("file", "gt", F.trim(ends[0]).cast("int").alias("a"), F.trim(ends[1]).cast("int").alias("b"))


def corner_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth files of page corners: (file, frame, corners map<string,struct<x,y>>); rejected frames have none."""
    schema = "_index int, _rejected string, point array<struct<_name:string,_x:double,_y:double>>"
    x = spark.read.format("xml").option("rowTag", "frame").schema(schema).load(path).withColumn("file", F.col("_metadata.file_name"))
    points = F.map_from_entries(F.transform("point", lambda p: F.struct(p["_name"], F.struct(p["_x"].alias("x"), p["_y"].alias("y")))))
    return x.select("file", F.col("_index").alias("frame"), F.when(F.coalesce(F.col("_rejected"), F.lit("false")) != "true", points).alias("corners"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (t, pid, event, and whatever else as raw text)."""
    return _events(spark.read.text(path))


class EventTail:
    """What was added to a log of JSON lines since the last read, by the place in bytes. A last line without its end is left
    for the next read. One process's own log, read on the driver: for many logs use event_log or a stream."""

    def __init__(self, spark: SparkSession, path: str, at: int = 0):
        self.spark, self.path, self.at = spark, path, at

    def read(self) -> DataFrame:
        """(t, pid, event, raw) of the new lines; lines that are no events are passed over."""
        with open(self.path, "rb") as f:
            f.seek(self.at)
            whole, end, _ = f.read().rpartition(b"\n")
        self.at += len(whole) + len(end)
        lines = [(x.decode("utf-8", "replace"),) for x in whole.split(b"\n") if x.strip()]
        return _events(self.spark.createDataFrame(lines, "value string"))


def _events(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", "t double, pid bigint, event string").alias("e"), "value").where("e.event is not null").select("e.*", F.col("value").alias("raw"))


def append_event(path: str, event: str, **data: object) -> None:
    """One line at the end of a log; a single write, so lines of several writers do not mix."""
    line = json.dumps({"t": time.time(), "pid": os.getpid(), "event": event, **data}, ensure_ascii=False).encode() + b"\n"
    at = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        os.write(at, line)
    finally:
        os.close(at)


def project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An entity document (one JSON object) as a table per entity; another schema version is refused."""
    ddl = f"schema_version int, videos array<struct<{schemas.VIDEOS}>>, segments array<struct<{schemas.SEGMENTS}>>, frames map<string,struct<{schemas.FRAMES}>>, pages map<string,struct<{schemas.PAGES}>>, `order` array<string>"
    doc = spark.read.schema(ddl).option("multiLine", "true").json(path)
    schemas.check_version(doc)
    out = {k: doc.select(F.explode(k).alias("x")).select("x.*") for k in ("videos", "segments")}
    out |= {k: doc.select(F.explode(F.map_values(k)).alias("x")).select("x.*") for k in ("frames", "pages")}
    return out | {"order": doc.select(F.posexplode("order").alias("pos", "id"))}
