"""Output order of pages and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(keys: DataFrame, most: int, some: int) -> list:
    """Keys that part the rows into stretches of about `some`, `most` stretches at the most: every so many of a sorted sample."""
    n = keys.count()
    parts = min(most, -(-n // some))
    if parts < 2:
        return []
    sample = [r[0] for r in keys.sample(min(1.0, 100 * parts / n), 7).distinct().orderBy("__key").collect()]
    return [sample[i] for i in sorted({len(sample) * k // parts for k in range(1, parts)})] if sample else []


def _stretch(key: Column, bounds: list[Column], at: int = 0) -> Column:
    """How many of the bounds are not above the key, by halving."""
    if not bounds:
        return F.lit(at)
    m = len(bounds) // 2
    return F.when(key < bounds[m], _stretch(key, bounds[:m], at)).otherwise(_stretch(key, bounds[m + 1 :], at + m + 1))


def _in_stretches(rows: DataFrame, order: list[Column], some: int, most: int) -> DataFrame:
    """rows with __key, the order's columns, and __part, the number of the stretch of the order that they are in."""
    keyed = rows.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    kinds = keyed.schema["__key"].dataType.fields
    bounds = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kinds)]) for b in _bounds(keyed.select("__key"), most, some)]
    return keyed.withColumn("__part", _stretch(F.col("__key"), bounds))


def with_previous(rows: DataFrame, key: str, order: str, value: str, name: str, some: int = 2_000, most: int = 512) -> DataFrame:
    """rows with the value of the row before in the order, of the same key, as name, and whether there is such a row as
    has_<name>. Also where most rows have one key, a task sees a stretch of them only; the last row of each stretch is handed on."""
    keyed = _in_stretches(rows.withColumn("__row", F.struct(F.col(key).alias("k"), F.col(value).alias("v"))), [F.col(key), F.col(order)], some, most)
    last = keyed.groupBy(F.col("__part").alias("__p")).agg(F.max_by("__row", "__key").alias("__l"))
    last = last.select("__p", F.lag("__l").over(Window.orderBy("__p")).alias("__l"))
    own = F.lag("__row").over(Window.partitionBy("__part").orderBy("__key"))
    out = keyed.withColumn("__own", own).join(F.broadcast(last), F.col("__part") == F.col("__p"))
    before = F.coalesce("__own", "__l")
    same = before.isNotNull() & before["k"].eqNullSafe(F.col(key))
    return out.withColumns({name: F.when(same, before["v"]), f"has_{name}": same}).drop("__row", "__key", "__part", "__p", "__l", "__own")


def numbered(rows: DataFrame, lead: list[Column], rest: list, name: str = "pos", start: int = 0, some: int = 100_000, most: int = 256) -> DataFrame:
    """rows with their number in the order of lead, then rest. Rows are only put in order within stretches of the order, whose
    ends come from a sample of the keys; what stands before each comes from running sums over one row a stretch, so no task
    sees all rows, nor all different keys. Whatever the sample, the numbers are exact."""
    parts = [*lead, *(F.col(c) if isinstance(c, str) else c for c in rest)]
    keyed = _in_stretches(rows, parts, some, most)
    sums = keyed.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = sums.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    out = keyed.withColumn("__own", own).join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return out.withColumn(name, (F.col("__before") + F.col("__own") + (start - 1)).cast("int")).drop("__key", "__part", "__p", "__before", "__own")


def natural_order(pages: DataFrame, rtl: bool = False) -> DataFrame:
    """pages (id, video_pos, start, segment, side, include, active) with pos from 0: by video (missing last),
    start, segment, then side in reading direction. Only included, active pages."""
    rank = F.when(F.col("side") == ("R" if rtl else "L"), 0).when(F.col("side") == "S", 0).otherwise(1)
    p = pages.where(F.coalesce("active", F.lit(True)) & F.col("include"))
    return numbered(p, [F.coalesce(F.col("video_pos").cast("double"), F.lit(1e9))], ["start", "segment", rank, "id"])


def update_order(natural: DataFrame, manual: DataFrame | None) -> DataFrame:
    """(id, pos): the manual order where its pages still exist, then new pages in natural order."""
    if manual is None:
        return natural.select("id", "pos")
    m = manual.select(F.col("id").alias("mid"), F.col("pos").alias("mpos"))
    j = natural.join(m, F.col("id") == F.col("mid"), "left")
    some = F.lit(10_000)
    lead = [F.col("mpos").isNull(), F.floor(F.coalesce("mpos", "npos") / some)]
    return numbered(j.withColumnRenamed("pos", "npos"), lead, ["mpos", "npos"]).select("id", "pos")


def receipt_sort(receipts: DataFrame, by: str) -> DataFrame:
    """(id, pos): by date (unknown last), by payee without spaces (blank last) then date, or by shot. Ties keep pos."""
    if by not in ("date", "payee", "payee_date", "shot"):
        raise ValueError(f"unknown order: {by}")
    day = [F.col("date").isNull(), F.coalesce(F.col("date").cast("string"), F.lit(""))]
    payee = F.regexp_replace(F.coalesce("payee", F.lit("")), " ", "")
    keys: list[Column] = {"shot": [], "date": day}.get(by, [payee == "", payee, *day])
    return numbered(receipts.withColumnRenamed("pos", "was"), [F.floor(F.col("was") / 10_000)] if by == "shot" else keys, ["was"]).select("id", "pos")


def is_permutation(order: DataFrame, pages: DataFrame) -> DataFrame:
    """One row (ok): the proposed order names each page once and nothing else."""
    j = order.groupBy("id").agg(F.count("*").alias("n")).join(pages.select("id", F.lit(1).alias("here")), "id", "full")
    return j.agg(F.coalesce(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False)) & F.col("here").isNotNull()), F.lit(True)).alias("ok"))


def move(rows: DataFrame, id_: Column, delta: int) -> DataFrame:
    """(id, pos) with one row moved by delta places, clamped to the ends."""
    at = F.max(F.when(F.col("id") == id_, F.col("pos"))).over(Window.partitionBy(F.lit(0)))
    last = F.max("pos").over(Window.partitionBy(F.lit(0)))
    r = rows.withColumns({"__at": at, "__to": F.least(F.greatest(at + delta, F.lit(0)), last)})
    shift = (F.when(F.col("pos") == F.col("__at"), F.col("__to"))
             .when((F.col("pos") > F.col("__at")) & (F.col("pos") <= F.col("__to")), F.col("pos") - 1)
             .when((F.col("pos") < F.col("__at")) & (F.col("pos") >= F.col("__to")), F.col("pos") + 1).otherwise(F.col("pos")))
    return r.select("id", shift.alias("pos"))
