"""Queries p1 to p10 over the training-data tables; problem 2 is general and lives in the core."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm import chunk, cutoff, leak, lookalike, overlap, pairs, scans, spam, tokenize
from daftar.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    parts = [lookalike.same_looking_pairs(articles, "article_ref", f) for f in ("text", "search_text")]
    parts.append(lookalike.same_looking_pairs(table(spark, d, "questions"), "id", "question"))
    return reduce(DataFrame.unionByName, parts)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    parts = [lookalike.same_looking_classes(articles, "article_ref", f) for f in ("text", "search_text")]
    parts.append(lookalike.same_looking_classes(table(spark, d, "questions"), "id", "question"))
    return reduce(DataFrame.unionByName, parts).drop("n")


def p1_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_ref", "text", "search_text").dropDuplicates(["article_ref"])
    return lookalike.canonical_columns(rows, ["text", "search_text"]).drop("text", "search_text")


def p1_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "questions").select("id", "question").dropDuplicates(["id"])
    return lookalike.canonical_columns(rows, ["question"]).drop("question")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, d, "questions"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "questions")
    return overlap.overlap_counts(questions, overlap.split_overlaps(questions))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "answer_rows"), table(spark, d, "questions"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "answer_rows").select("answer_no", "model").dropDuplicates(["answer_no"])
    found = p4_found(spark, d)
    return rows.join(found, "answer_no", "left").groupBy("model", "defect").agg(F.count("*").alias("answers"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key in (("articles", "article_ref"), ("chunks", "id")):
        cut = chunk.pieces(table(spark, d, name), key, "text")
        parts.append(cut.select(F.lit(name).alias("item_table"), F.col(key).alias("item_key"), "piece_no", "begin", "overlap", "piece", "forced", "no_space"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = _pieces(spark, d)
    items = pieces.select(F.struct("item_table", "item_key").alias("item"), "piece_no", "no_space")
    return chunk.oversized(items, "item").select("item.item_table", "item.item_key", "cut")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).drop("no_space")


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """For each item whether its pieces keep the limit and the overlap, and the hash of the pieces put together without their overlaps."""
    rows = _pieces(spark, d).select("item_table", "item_key", "piece_no", "overlap", "piece")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("body")))), lambda x: x["body"]), "")
    sizes = (F.max(F.length("piece")) <= chunk.LIMIT) & (F.max("overlap") <= chunk.OVERLAP)
    return rows.groupBy("item_table", "item_key").agg(sizes.alias("kept"), F.md5(body).alias("text_md5"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    clean = table(spark, d, "articles").select("text").unionByName(table(spark, d, "chunks").select("text"))
    return scans.repaired_pages(table(spark, d, "ocr_pages"), clean)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(_scans(spark, d))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("page_key", "repaired")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_values(table(spark, d, "answer_rows"), table(spark, d, "questions"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rates(table(spark, d, "answer_rows"), table(spark, d, "questions"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str, budget: int) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), budget=budget)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 0).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leak.leak_report(_leaks(spark, d, 1), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam.labelled_shares(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p1_articles, p1_questions, p3_found, p3_counts, p4_found, p4_counts, p5_found, p5_pieces, p5_whole, p6_found, p6_text, p7_found, p7_rates, p8_ids, p9_found, p9_report, p10_found, p10_shares)
}

#: Where SQL can say the same over whole tables.
ORACLES: dict[str, str] = {
    "p5_found": """
        WITH items AS (
            SELECT DISTINCT 'articles' AS item_table, article_ref AS item_key, text FROM articles
            UNION SELECT DISTINCT 'chunks', id, text FROM chunks)
        SELECT item_table, item_key,
            CASE WHEN list_max(list_transform(string_split_regex(text, '[\\x{09}-\\x{0d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'), lambda x: length(x))) > 1000
                THEN 'forced' ELSE 'natural' END AS cut
        FROM items WHERE length(text) > 1000""",
    "p5_whole": """
        SELECT item_table, item_key, true AS kept, md5(text) AS text_md5 FROM (
            SELECT DISTINCT 'articles' AS item_table, article_ref AS item_key, text FROM articles WHERE text <> ''
            UNION SELECT DISTINCT 'chunks', id, text FROM chunks WHERE text <> '')""",
}
