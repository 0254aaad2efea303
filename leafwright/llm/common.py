"""What several of the operators share: durable tables, text normalisation, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BYTE_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    A local session that names none (tests) gets a temporary one. On a cluster none can be made up: a folder of one
    machine would lose what others write.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="leafwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: its lineage is cut and it
    survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long: Arrow batches of at most this many rows bound what an executor and its Python workers hold at once."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


CACHES: dict[str, object] = {}  # of a Python worker, by the operator that keeps them between tasks


def release(keep: str = "") -> None:
    """Python workers are used again by other operators: what those have cached is let go, and freed memory goes
    back to the system."""
    for name in [n for n in CACHES if n != keep]:
        del CACHES[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(over, keep: str = ""):
    """An Arrow function over batches between two calls of release(): an idle worker then holds little."""

    def run(batches):
        release(keep)
        yield from over(batches)
        release(keep)

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the cheaper built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a[i], b[i])."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the graph with the long columns (u, v) as edges: rows (node, root), root the
    smallest node that can be reached. Nodes without an edge to another node have no row.

    Alternating large-star and small-star steps; each round is written out, so lineage stays short.
    Degrees are reduced by a map-side minimum, and a node with very many neighbours is only met by
    joins that Spark can split.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    e, last = durable(e, "edges"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e"))
        e = durable(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
