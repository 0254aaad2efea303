import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

ODD = [(1, "Some words here"), (2, None), (3, ""), (4, "some WORDS here"), (5, "word " * 30_000), (5, "word " * 30_000), (None, "Some words here"), (7, "émoji 😀 naïve")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "score", "g", "key", "source", "lang", "fp", "size", "h", "b", "t", "k", "part")})
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("source", F.when(F.col("doc_id") != 3, F.lit("s")))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
