"""The document library: upserts of uploads, soft deletion, restoring, incremental results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar.operators.identity import content_id


def uploaded(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with their identity: doc_id (twelve hex digits) and the full hash that is checked again on reading."""
    return files.withColumn("sha256", F.sha2(content, 256)).withColumn("doc_id", content_id(F.col(content)))


def merged(library: DataFrame, uploads: DataFrame) -> DataFrame:
    """The library after a batch of uploads: same bytes are the same document, a deleted one comes back, a damaged one (another hash
    under its id) is replaced.  Both sides have doc_id, sha256, title, created_at, deleted, deleted_at."""
    columns = ["doc_id", "sha256", "title", "created_at", "deleted", "deleted_at"]
    new = uploads.select(*columns).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("created_at", "title"))).where("r = 1").drop("r")
    both = library.select("doc_id", F.struct(*columns[1:]).alias("old")).join(new.select("doc_id", F.struct(*columns[1:]).alias("new")), "doc_id", "full")
    kept = F.col("old").isNotNull() & (F.col("new").isNull() | (F.col("old.sha256") == F.col("new.sha256")))
    row = F.when(kept, F.col("old")).otherwise(F.col("new"))
    back = kept & F.col("new").isNotNull()
    return both.select("doc_id", row.alias("x"), back.alias("back")).select(
        "doc_id", "x.sha256", "x.title", "x.created_at",
        F.when(F.col("back"), F.lit(False)).otherwise(F.col("x.deleted")).alias("deleted"),
        F.when(~F.col("back"), F.col("x.deleted_at")).alias("deleted_at"),
    )


def soft_deleted(library: DataFrame, doc_ids: DataFrame, at: str) -> DataFrame:
    """The library with the named documents flagged; a document is never removed."""
    gone = doc_ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    rows = library.join(gone, "doc_id", "left")
    now = F.coalesce("_gone", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    return rows.withColumn("deleted_at", F.when(now, F.lit(at)).otherwise(F.col("deleted_at"))).withColumn("deleted", F.coalesce("deleted", F.lit(False)) | now).drop("_gone")


def upsert_stream(uploads: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda x: x):
    """A query that folds each micro-batch of uploads into the library table at ``path``.

    Every batch writes a new version folder and then the pointer to it, so a batch that is replayed gives the same library and a
    reader never sees half of one."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = read_library(spark, path)
        fresh = make(batch)
        out = merged(current, fresh) if current is not None else merged(fresh.limit(0), fresh)
        out.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        spark.createDataFrame([(batch_id,)], "version bigint").coalesce(1).write.mode("overwrite").json(f"{path}/_current")

    return uploads.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def read_library(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of the library table, or None before the first batch."""
    try:
        version = spark.read.schema("version bigint").json(f"{path}/_current").first()
    except Exception:  # noqa: BLE001 - the folder does not exist yet
        return None
    return spark.read.parquet(f"{path}/v={version[0]}") if version else None
