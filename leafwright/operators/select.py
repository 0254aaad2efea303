"""Greedy choice of the best rows that keep a distance from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spaced_topk(rows: DataFrame, keys: list[str], order: list[Column], t: str, id_col: str, spacing: float, k: int) -> DataFrame:
    """Per group of keys: (keys, chosen array<struct<t, id>>), the best rows in order, each at least `spacing`
    from all before it, at most k.

    order holds columns of which the smallest is best; the id ends ties. One fold over the sorted array
    of a group: a group is a run of frames, not a table."""
    fields = [c.alias(f"o{i}") for i, c in enumerate(order)]
    item = F.struct(*fields, F.col(id_col).alias("id"), F.col(t).alias("t"))
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__all"))
    kind = F.array().cast(rows.select(F.array(F.struct(F.col(t).alias("t"), F.col(id_col).alias("id")))).schema[0].dataType)

    def take(acc: Column, x: Column) -> Column:
        room = (F.size(acc) < k) & ~F.exists(acc, lambda c: F.abs(c["t"] - x["t"]) < spacing)
        return F.when(room, F.array_append(acc, F.struct(x["t"].alias("t"), x["id"].alias("id")))).otherwise(acc)

    return got.select(*keys, F.aggregate("__all", kind, take).alias("chosen"))
