"""Exact positions in a sorted table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.session import cut_lineage


def running_counts(rows: DataFrame, group: list[str], order: list[str], n: str | None = None) -> DataFrame:
    """``rows`` with ``before``: how many (or how much of ``n``) of its group come before a row in ``order``.

    The table is range-partitioned and written once; sums per partition give each partition its start, so a group of any size is
    spread over as many tasks as it needs."""
    weight = F.col(n) if n else F.lit(1)
    parts = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part", *group).agg(F.sum(weight).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", *group, start.alias("_start"))
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(starts, ["_part", *group]).withColumn("before", (F.col("_start") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_start")
