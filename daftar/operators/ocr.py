"""Scanned pages: raw text from an engine's output, and the digit gate that judges engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions import text as tx

PASS_RECALL = 0.99


def raw_lines(pages: DataFrame, key: str, text: str, entities: bool = True) -> DataFrame:
    """(key, line_no, line, furniture): lines of each page without markup, header lines put in order."""
    body = tx.header_order(tx.strip_markup(F.col(text), entities))
    lines = pages.select(key, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return lines.select(key, "line_no", F.regexp_replace("line", tx.SPACE + "+$", "").alias("line"), tx.is_furniture(F.col("line")).alias("furniture"))


def raw_text(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text, dropped): pages in numeric order, furniture lines out and counted.  A document's pages make one text, so it is as
    long as the document."""
    rows = raw_lines(pages.withColumn("_k", F.struct(F.col(doc).alias("doc"), tx.page_order(F.col(page)).alias("page_no"))), "_k", text).select("_k.doc", "_k.page_no", "line_no", "line", "furniture")
    kept = F.array_sort(F.collect_list(F.when(~F.col("furniture"), F.struct("page_no", "line_no", "line"))))
    return rows.groupBy("doc").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), F.count_if("furniture").alias("dropped"))


def digit_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): multiset of digit tokens, one script."""
    return rows.select(F.col(key).alias("key"), F.explode(tx.digit_tokens(F.col(text))).alias("t")).groupBy("key", tx.ascii_digits(F.col("t")).alias("token")).agg(F.count("*").alias("n"))


def without_furniture(tokens: DataFrame, furniture: DataFrame) -> DataFrame:
    """Token counts less one occurrence for each furniture token: (key, token, n) - (key, token, n)."""
    return tokens.join(furniture.withColumnRenamed("n", "f"), ["key", "token"], "left").withColumn("n", F.col("n") - F.coalesce("f", F.lit(0))).where("n > 0").select("key", "token", "n")


def digit_scores(expected: DataFrame, found: DataFrame, decimals: int = 6) -> DataFrame:
    """(key, expected, found, correct, missing, spurious, recall) per page; both sides (key, token, n) multisets.

    A page that is absent on one side is all missing or all spurious."""
    both = expected.select("key", "token", F.col("n").alias("e")).join(found.select("key", "token", F.col("n").alias("f")), ["key", "token"], "full").na.fill(0, ["e", "f"])
    out = both.groupBy("key").agg(
        F.sum("e").alias("expected"), F.sum("f").alias("found"), F.sum(F.least("e", "f")).alias("correct"),
        F.sum(F.greatest(F.col("e") - F.col("f"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("f") - F.col("e"), F.lit(0))).alias("spurious"),
    )
    return out.withColumn("recall", F.round(F.when(F.col("expected") > 0, F.col("correct") / F.col("expected")).otherwise(0.0), decimals))


def gate_totals(scores: DataFrame, decimals: int = 6) -> DataFrame:
    """One row: totals over all pages, and whether the engine passes (recall of 0.99 and nothing spurious)."""
    t = scores.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("expected", "correct", "missing", "spurious")])
    recall = F.when(F.col("expected") > 0, F.col("correct") / F.col("expected")).otherwise(0.0)
    return t.withColumn("recall", F.round(recall, decimals)).withColumn("passed", (recall >= PASS_RECALL) & (F.col("spurious") == 0))


def budget_removed(tokens: DataFrame, budget: DataFrame) -> DataFrame:
    """(key, pos, token): the first occurrences of each token within its budget dropped, the order of the rest kept."""
    seen = F.row_number().over(Window.partitionBy("key", "token").orderBy("pos"))
    return tokens.withColumn("r", seen).join(budget, ["key", "token"], "left").where(F.col("r") > F.coalesce("budget", F.lit(0))).select("key", "pos", "token")


def critical_failures(critical: DataFrame, found: DataFrame) -> DataFrame:
    """(key, token): critical tokens (key, token) of pages that the engine's tokens (key, token, n) don't have; one of them fails the gate."""
    return critical.select("key", "token").distinct().join(found.select("key", "token"), ["key", "token"], "left_anti")
