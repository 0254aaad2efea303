"""Signatures: differences, bits and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays; NaN where one is missing or the lengths differ."""

    @F.pandas_udf("double")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.nan if x is None or y is None or len(x) != len(y) else np.abs(np.asarray(x, float) - np.asarray(y, float)).mean() for x, y in zip(a, b)])

    return diff(a, b)


def sign_bits(vector: Column) -> Column:
    """The signs of the components as an array of longs, 64 to each: a bit is set where its component is positive."""
    bits = F.transform(vector, lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    starts = F.sequence(F.lit(1), F.greatest(F.size(vector), F.lit(1)), F.lit(64))
    return F.transform(starts, lambda s: F.aggregate(F.slice(bits, s, 64), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b)))


def ratio_matches(queries: DataFrame, rows: DataFrame, ratio: float, most: int = 100_000, block: int = 512) -> DataFrame:
    """(vec_id, match_id, dist, second): of all other rows the nearest by differing bits, where it is nearer than ratio times
    the second.

    queries and rows: (vec_id, bits). The queries go to the rows in chunks of at most `most` (a bound on what is broadcast;
    each chunk is a pass over the rows), and meet them in blocks. A task keeps the two nearest of each query, and those of
    all tasks are merged."""
    spark, found = queries.sparkSession, None
    for chunk in _chunks(queries, most):
        part = _two_nearest(rows, spark.sparkContext.broadcast(chunk), block)
        found = part if found is None else found.unionByName(part)
    near = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "match_id"))), 1, 2).alias("n")).where("size(n) = 2")
    return near.select("vec_id", F.col("n")[0]["match_id"].alias("match_id"), F.col("n")[0]["dist"].alias("dist"), F.col("n")[1]["dist"].alias("second")).where(F.col("dist") < ratio * F.col("second"))


def _chunks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, bits) of at most `most` queries at a time."""
    ids, bits = [], []
    for r in queries.select("vec_id", "bits").toLocalIterator():
        ids.append(r[0])
        bits.append(r[1])
        if len(ids) == most:
            yield np.array(ids, np.int64), np.array(bits, np.int64)
            ids, bits = [], []
    yield np.array(ids, np.int64), np.array(bits, np.int64)


def _two_nearest(rows: DataFrame, chunk: Broadcast, block: int) -> DataFrame:
    def over(batches):
        ids, bits = chunk.value
        far = np.iinfo(np.int64).max
        best = np.full((len(ids), 2), far)  # distance and id in one number: the smaller id first on ties
        name = np.zeros((len(ids), 2), np.int64)
        for batch in batches:
            other = batch.column("vec_id").to_numpy()
            theirs = np.array(batch.column("bits").to_pylist(), np.int64).reshape(len(other), -1)
            order = np.argsort(other, kind="stable")
            other, theirs = other[order], theirs[order]
            for i in range(0, len(ids), block):
                differing = (bits[i : i + block, None, :] ^ theirs[None, :, :]).view(np.uint64)  # of a signed number the bits of its absolute value are counted
                apart = np.bitwise_count(differing).sum(axis=2, dtype=np.int64)
                apart[ids[i : i + block, None] == other[None, :]] = far  # itself
                take = min(2, len(other))
                near = np.argsort(apart, axis=1, kind="stable")[:, :take]  # ids ascend, so ties do too
                d = np.concatenate([best[i : i + block], np.take_along_axis(apart, near, 1)], axis=1)
                n = np.concatenate([name[i : i + block], other[near]], axis=1)
                two = np.lexsort((n, d), axis=1)[:, :2]
                best[i : i + block], name[i : i + block] = np.take_along_axis(d, two, 1), np.take_along_axis(n, two, 1)
        row, k = np.nonzero(best < far)
        yield pa.record_batch([pa.array(ids[row]), pa.array(name[row, k]), pa.array(best[row, k].astype(np.int32))], names=["vec_id", "match_id", "dist"])

    return rows.select("vec_id", "bits").mapInArrow(over, "vec_id long, match_id long, dist int")


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, share: float) -> DataFrame:
    """(keys, q): the smallest value up to which at least `share` of the weight lies."""
    g = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    c = g.withColumns({"__run": F.sum("__w").over(w.orderBy(value)), "__all": F.sum("__w").over(w)})
    return c.where(F.col("__run") >= share * F.col("__all")).groupBy(*keys).agg(F.min(value).alias("q"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x0, y0, x1, y1]."""
    side = [F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0)) for i in (0, 1)]
    area = [(c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)]
    inter = side[0] * side[1]
    return inter / (area[0] + area[1] - inter)


def iou_summary(boxes: DataFrame, key: str) -> DataFrame:
    """(key, n, mean, middle, share90, share80, poor) of box_iou(a, b)."""
    b = boxes.withColumn("iou", box_iou(F.col("a"), F.col("b")))
    return b.groupBy(key).agg(F.count("*").alias("n"), F.bround(F.avg("iou"), 6).alias("mean"), F.bround(F.median("iou"), 6).alias("middle"),
                              F.avg((F.col("iou") >= 0.9).cast("double")).alias("share90"), F.avg((F.col("iou") >= 0.8).cast("double")).alias("share80"), F.count_if(F.col("iou") < 0.5).alias("poor"))
