"""Sinks: tables published whole, single JSON results, embedding caches with the identity they were made for."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(rows: DataFrame, problems: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write ``rows`` only if there are no problems at all; the committer shows the new table whole or not at all."""
    first = problems.limit(1).collect()
    if first:
        raise ValueError(f"not written: {first[0].asDict()}")
    rows.write.mode("overwrite").format(file_format).save(path)


def write_json(value: object, path: str) -> None:
    """One small JSON document, replaced atomically on the driver's file system."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=2, sort_keys=True)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_result(row: DataFrame, path: str, provenance: dict) -> None:
    """A one-row result with where it came from."""
    write_json({"provenance": provenance, "result": json.loads(row.toJSON().first())}, path)


def write_vectors(vectors: DataFrame, path: str, meta: dict[str, str]) -> None:
    """An embedding cache: vectors and, beside them, what they were made from."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str, meta: dict[str, str], check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """The cache if it was made from the same things and ``check`` finds no problem in it, else None."""
    try:
        stored = {r.name: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
        vectors = spark.read.parquet(f"{path}/vectors")
    except Exception:  # noqa: BLE001 - missing or unreadable: rebuilt by the caller
        return None
    if stored != {k: str(v) for k, v in meta.items()}:
        return None
    return vectors if check is None or not check(vectors).limit(1).collect() else None


def write_back(questions: DataFrame, verdicts: DataFrame, path: str, key: str = "id") -> None:
    """Questions with the verified reference status, as a new table."""
    rows = questions.join(verdicts.select(key, F.col("ref_status").alias("_new")), key, "left")
    rows.withColumn("ref_status", F.coalesce("_new", "ref_status")).drop("_new").write.mode("overwrite").parquet(path)
