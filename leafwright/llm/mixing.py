"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: list[float], share: float, limit: float) -> DataFrame:
    """sources (source, source_size) with `target`: `share` of all sizes split by the weights, which
    repeat over the sources in code point order (null last). No target is above `limit` times its
    source's size; the excess is shared again by weight among the others.

    Sources fill up in the order of limit * size / weight, so the ones at their limit are a prefix of
    that order: the shortest after which the level of the others is below the next one's limit.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__n"), F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("__full", F.col("source").asc_nulls_last())
    s = sources.withColumn("__n", F.row_number().over(order) - 1).withColumn("__w", w)
    s = s.withColumn("__cap", limit * F.col("source_size").cast("double")).withColumn("__full", F.col("__cap") / F.col("__w"))
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    s = s.withColumns({
        "__capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "__left": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
        "__all": F.sum("source_size").over(everything)})
    level = (F.lit(share) * F.col("__all") - F.lit(limit) * F.col("__capped")) / F.col("__left")
    s = s.withColumn("__level", level).withColumn("__fits", F.col("__level") <= F.col("__full"))
    final = F.min(F.when(F.col("__fits"), F.struct("__full", F.col("source").isNull().alias("z"), "source", "__level"))).over(Window.partitionBy(F.lit(0)))
    s = s.withColumn("__final", final["__level"])
    target = F.when(F.col("__final").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * F.col("__final")))
    return s.select("source", "source_size", target.alias("target"))


def _order(id_: Column, size: Column, text: Column) -> list[Column]:
    """What puts the documents of a source in a row. None of it is null, and rows that agree in all are alike."""
    return [F.md5(F.coalesce(id_.cast("string"), F.lit(""))).alias("h"), id_.isNotNull().alias("named"), size.alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("x")]


_KEY = ("h", "named", "size", "x")


def _queues(docs: DataFrame, weights: list[float], share: float, limit: int, id_col: str, text_col: str, source_col: str, buckets: int | None, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Every row with what its source has sent when it is through (sent), and the copies (rows with their pass) that the mix
    takes."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text.alias("t")).withColumn("size", word_count(F.col("t")))
    base = durable(base.select("id", "source", *_order(F.col("id"), F.col("size"), F.col("t"))), "mix-sizes")
    buckets = buckets or max(16, min(1 << 24, base.count() // 50_000))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    base = base.withColumn("b", bucket)

    parts = base.groupBy("source", "b").agg(F.sum("size").alias("part"))
    targets = durable(source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), list(weights), share, limit), "mix-targets")
    few = targets.limit(broadcast_rows + 1).count() <= broadcast_rows
    named = targets.select(F.col("source").alias("s2"), "source_size", "target")
    named = F.broadcast(named) if few else named
    offsets = parts.select(F.col("source").alias("s1"), F.col("b").alias("b1"), (F.sum("part").over(Window.partitionBy("source").orderBy("b")) - F.col("part")).alias("offset"))

    local = Window.partitionBy("source", "b").orderBy(*_KEY)
    rows = base.withColumn("within", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s1")) & (F.col("b") == F.col("b1"))).join(named, F.col("source").eqNullSafe(F.col("s2")))
    rows = durable(rows.select("id", "source", *_KEY, "source_size", "target", (F.col("offset") + F.col("within")).alias("sent")), "mix-queue")

    copies = rows.where("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))).alias("pass"))
    copies = copies.withColumn("finish", (F.col("sent") + F.col("pass") * F.col("source_size")) / F.col("target"))
    # the merge: sums of slices of virtual time give where it is cut; only that slice is put in order
    grain = 1 << 20  # slices of a unit of virtual time; the cut lies near 1
    copies = copies.withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(1e12)) * grain).cast("long"))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    budget = F.lit(min(share, float(limit)) * total)
    coarse = copies.withColumn("top", F.floor(F.col("slice") / 1024))
    at_top = _cut(coarse.groupBy("top").agg(F.sum("size").alias("size")), "top", budget)
    if at_top is None:
        return rows, copies
    top, before = at_top
    fine = coarse.where(F.col("top") == top).groupBy("slice").agg(F.sum("size").alias("size"))
    slice_, before = _cut(fine, "slice", budget - F.lit(before)) or (None, 0)
    start = at_top[1] + before
    edge = copies.where(F.col("slice") == slice_)
    run = F.sum("size").over(Window.partitionBy("slice").orderBy("finish", *_KEY, "pass").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("in", F.lit(start) + run <= budget).where("in").drop("in")
    return rows, copies.where(F.col("slice") < slice_).unionByName(edge)


def mix_sources(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, limit: int = 2, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", buckets: int | None = None, broadcast_rows: int = 1000) -> DataFrame:
    """One row per input row: (id, size, source_size, target, taken).

    Each source is a queue of its documents in the order of md5(id), gone through up to `limit` times.
    The virtual finish time of a document is what its source has sent by then, in words, divided by
    the source's target. All queues are merged by finish time and cut at the total budget: a
    document is taken while the words sent so far are within it.

    Running sums come from sums of buckets of the order (by default one for about 50,000 rows), so neither a
    source that holds most rows nor the merge itself is sorted in one task; only the table of sources, a row
    each, is. It is broadcast only when it has at most `broadcast_rows` rows. The result depends on ids, sizes
    and texts alone: reruns agree.

    Null text has size 0, and a document without words is taken 0 words. A null source is a source of
    its own, the last. Rows that repeat an id follow each other in the order of their sizes, then by a hash of
    their texts. A source without words has target 0. Other columns are ignored.
    """
    rows, taken = _queues(docs, weights, share, limit, id_col, text_col, source_col, buckets, broadcast_rows)
    # passes of one row agree in (source, sent), which no other row with words has
    times = taken.groupBy(F.col("source").alias("ts"), F.col("sent").alias("tsent")).agg(F.sum("size").alias("taken"))
    out = rows.join(times, F.col("source").eqNullSafe(F.col("ts")) & (F.col("sent") == F.col("tsent")) & (F.col("size") > 0), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, limit: int = 2, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source", buckets: int | None = None, broadcast_rows: int = 1000) -> DataFrame:
    """docs (all columns, whatever their names), each row as often as mix_sources takes it: not at all, or up to `limit` times.

    What a pass takes of a source is the front of its queue, so the last document taken says it all: one row a source and
    pass meets the documents, whose texts are not shuffled. Rows alike in id, size and text count as often as the mix has
    them, whichever of them that is."""
    _, taken = _queues(docs, weights, share, limit, id_col, text_col, source_col, buckets, broadcast_rows)
    key = F.struct(*_KEY)
    last = taken.groupBy("source", "pass").agg(F.max(key).alias("last"))
    ties = taken.join(last.withColumnRenamed("source", "s").withColumnRenamed("pass", "p"), F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (key == F.col("last")))
    ends = durable(ties.groupBy("source", "pass").agg(F.first("last").alias("last"), F.count("*").alias("n")), "mix-ends")
    ends = ends.groupBy("source").agg(F.collect_list(F.struct("pass", "last", "n")).alias("ends"))
    ends = F.broadcast(ends) if ends.limit(broadcast_rows + 1).count() <= broadcast_rows else ends

    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own.values())
    rows = rows.withColumn("size", word_count(F.col(own[text_col])))
    rows = rows.withColumn("key", F.struct(*_order(F.col(own[id_col]), F.col("size"), F.col(own[text_col])))).where("size > 0").join(ends, F.col(own[source_col]).eqNullSafe(F.col("source")))
    rows = rows.withColumn("times", F.size(F.filter("ends", lambda e: F.col("key") < e["last"]))).withColumn("tied", F.filter("ends", lambda e: F.col("key") == e["last"]))
    sure = rows.where(F.size("tied") == 0)
    alike = Window.partitionBy("source", "key").orderBy(F.lit(0))
    open_ = rows.where(F.size("tied") > 0).withColumn("nth", F.row_number().over(alike))
    open_ = open_.withColumn("times", F.col("times") + F.size(F.filter("tied", lambda e: e["n"] >= F.col("nth")))).drop("nth")
    out = sure.unionByName(open_).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*own.values()).toDF(*docs.columns)


def _cut(sums: DataFrame, key: str, budget: Column) -> tuple[int, int] | None:
    """The first key at which the running sum passes the budget, and the sum before it."""
    run = F.sum("size").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    row = sums.withColumn("run", run).where(F.col("run") > budget).orderBy(key).select(key, F.col("run") - F.col("size")).first()
    return None if row is None else (row[0], row[1])
