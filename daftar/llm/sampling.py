"""Bounded samples that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_sample(rows: DataFrame, key: str, size: int, only: Column) -> DataFrame:
    """At most ``size`` rows, where ``only`` holds, of the least key hashes: the same rows however the table is partitioned, from all
    parts of it.

    Most rows go by a bound on the hash before anything is ordered, so the driver is sent about twice the sample at any size of
    table.  The rows are counted without the condition, which a column store does without reading them."""
    n = rows.count()
    hashed = rows.where(only).withColumn("_h", F.xxhash64(key))
    if n > 4 * size:
        # hashes are spread evenly over the signed 64-bit integers
        hashed = hashed.where(F.col("_h") < int(-(1 << 63) + (1 << 64) * (2 * size / n)))
    return hashed.orderBy("_h", F.col(key)).limit(size).drop("_h")
