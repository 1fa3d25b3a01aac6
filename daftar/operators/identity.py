"""Identity of documents: content hashes, fingerprints, duplicates, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_LENGTH = 12


def content_id(content: Column) -> Column:
    """First twelve hex digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, ID_LENGTH)


def duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(content_hash, copies, first_id): texts stored more than once; only hashes are shuffled, and counted before it."""
    rows = docs.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("content_hash"), key)
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``; a re-delivered row replaces the older one."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def live(meta: DataFrame) -> DataFrame:
    """Rows that are not softly deleted, oldest first."""
    return meta.where(~F.coalesce(F.col("deleted"), F.lit(False))).orderBy("created_at", "doc_id")


def set_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, fingerprint): order-free identity of a set of rows.

    Hashes are sorted and hashed per two-digit prefix, then over the 256 prefixes, so no task holds more than a 256th of them."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = rows.select(F.sha2(joined, 256).alias("h"))
    parts = h.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))
