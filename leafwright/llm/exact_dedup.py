"""Exact deduplication: 128-bit content hashes find the groups, bytes decide them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text",
                key: Callable[[Column], Column] = _md5, check: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their bytes are, after lower-casing A-Z. Rows are grouped by the 128-bit hash
    `key`; of each group with more than one row the texts themselves are grouped, so two texts of one
    hash come apart. The row with the smallest ("min") or largest ("max") id stays.

    Only hashes and ids are shuffled for texts that occur once. Copies collapse in each task before
    they are exchanged, so a text that fills a third of the table costs one row a task.

    Null text counts as empty, empty texts are equal to each other. Null ids never stay unless the
    whole group has none (keep_id is null then). Rows that repeat both id and text are all marked kept
    when their id is. Other columns are ignored. An empty table gives an empty result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    check = check or (lambda t: F.unhex(F.sha2(t, 256)))
    base = base.withColumns({"k": key(F.col("t")), "c": check(F.col("t"))})
    hashed = durable(base.select("id", "k", "c", F.sha2("t", 256).alias("sha")), "exact-hashes")
    several = durable(hashed.groupBy("k").count().where("count > 1").select("k"), "exact-keys")
    texts = base.join(several, "k", "left_semi").groupBy("k", "c", "t").agg(best("id").alias("keep"), F.count("*").alias("n"))
    # one row per distinct text; texts of one (k, c) are told apart by their bytes in `split`
    groups = durable(texts.groupBy("k", "c").agg(
        F.count("*").alias("texts"), F.first("keep").alias("keep"), F.sum("n").alias("n")), "exact-groups")
    single = groups.where("texts = 1").select("k", "c", "keep", "n")
    plain = hashed.join(single, ["k", "c"], "left").select("id", "sha", "k", "c", "keep", "n")
    collided = groups.where("texts > 1").select("k", "c")
    if collided.isEmpty():
        out = plain
    else:
        own = base.join(collided, ["k", "c"], "left_semi").groupBy("t").agg(best("id").alias("keep"), F.count("*").alias("n"))
        split = base.join(collided, ["k", "c"], "left_semi").join(own, "t")
        split = split.select("id", F.sha2("t", 256).alias("sha"), "k", "c", "keep", "n")
        out = plain.join(collided, ["k", "c"], "left_anti").unionByName(split)
    kept = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_col), kept.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      F.col("id").eqNullSafe(kept).alias("kept"), F.col("sha").alias("text_sha256"))
