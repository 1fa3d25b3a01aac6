"""Guards around questions, corpora and uploads: validation, references, overlap bands, broken words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.functions import text as tx
from daftar.operators.fusion import containment

CATEGORIES = ["direct", "multi_article", "colloquial", "out_of_corpus"]
SPLITS = ["train", "dev", "test"]
#: Least and greatest overlap of a question with its articles, by category.
BANDS = {"direct": (0.15, 0.55), "multi_article": (0.15, 0.60), "colloquial": (0.0, 0.35)}
DEFAULT_BAND = (0.0, 0.55)
LEAST_HEAD, MOST_TAIL = 2, 4
UPLOAD_BYTES = 20 * 1024 * 1024


def question_errors(questions: DataFrame, order: str, key: str = "id") -> DataFrame:
    """``questions`` with ``errors``: every rule a row breaks, in order; an empty list for a good row.

    A repeated key is an error of every row but the first in ``order``."""
    seen = F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1
    expected = F.coalesce(F.size("expected_articles"), F.lit(0)) > 0
    rules: list[tuple[Column, str]] = [
        (F.col(key).isNull(), "missing id"),
        (F.coalesce(F.col("question"), F.lit("")) == "", "missing question"),
        (~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)), "unknown category"),
        (~F.coalesce(F.col("split").isin(SPLITS), F.lit(False)), "unknown split"),
        (seen, "duplicate id"),
        (F.col("answerable") & ~expected, "answerable without expected articles"),
        (~F.col("answerable") & expected, "unanswerable with expected articles"),
    ]
    return questions.withColumn("errors", F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules])))


def missing_references(questions: DataFrame, articles: DataFrame, key: str = "id") -> DataFrame:
    """(id, article_id): expected articles the corpus does not have."""
    wanted = questions.select(F.col(key).alias("id"), F.explode("expected_articles").alias("article_id")).distinct()
    return wanted.join(articles.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_anti").select("id", "article_id")


def missing_keywords(questions: DataFrame, articles: DataFrame, key: str = "id") -> DataFrame:
    """(id, keyword): keywords that stand in none of a question's expected articles."""
    wanted = questions.select(F.col(key).alias("id"), F.explode("expected_articles").alias("article_id"), "expected_keywords").dropDuplicates(["id", "article_id"])
    texts = articles.select(F.col("id").alias("article_id"), "text").where("text is not null")
    pairs = wanted.join(texts, "article_id").select("id", F.explode("expected_keywords").alias("keyword"), F.col("text"))
    found = pairs.groupBy("id", "keyword").agg(F.max(F.contains("text", "keyword")).alias("found"))
    return found.where(~F.col("found")).select("id", "keyword")


def overlap_bands(pairs: DataFrame, bands: DataFrame, query_terms: Column, doc_terms: Column, decimals: int = 4) -> DataFrame:
    """``pairs`` (id, category, ...) with overlap and verdict LOW, OK or HIGH against the category's band.

    ``bands`` (category, lo, hi) has one row a category and is tiny; a category without one takes the default."""
    leaked = tx.bound(F.struct(query_terms.alias("q"), doc_terms.alias("d")), lambda x: F.array_distinct(F.filter(x["q"], lambda t: F.array_contains(x["d"], t))))
    rows = pairs.withColumn("overlap", F.round(containment(query_terms, doc_terms), decimals)).withColumn("leaked", leaked)
    rows = rows.join(bands, "category", "left")
    lo, hi = F.coalesce("lo", F.lit(DEFAULT_BAND[0])), F.coalesce("hi", F.lit(DEFAULT_BAND[1]))
    verdict = F.when(F.col("overlap") > hi, "HIGH").when(F.col("overlap") < lo, "LOW").otherwise("OK")
    return rows.withColumn("verdict", verdict).drop("lo", "hi")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): tokens of the corpus with the punctuation around them off."""
    return docs.select(F.explode(_stripped(text)).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


def _stripped(text: str) -> Column:
    edge = "[،.:؛()\"'“”]+"
    return F.transform(F.filter(F.split(F.col(text), tx.SPACE + "+"), lambda t: t != ""), lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", ""))


def broken_words(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, broken, joined, joined_seen): neighbouring tokens whose joined form is a token of the corpus.

    Neighbours come from the token array of a row, so no window or shuffle is needed to pair them."""
    pairs = docs.select(F.col(key).alias("id"), _stripped(text).alias("ts"))
    pairs = pairs.select("id", F.explode(F.zip_with(F.slice("ts", 1, F.greatest(F.size("ts") - 1, F.lit(0))), F.slice("ts", 2, F.greatest(F.size("ts") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("id", "p.a", "p.b")
    pairs = pairs.where((F.length("a") >= LEAST_HEAD) & (F.length("b") >= 1) & (F.length("b") <= MOST_TAIL))
    pairs = pairs.select("id", F.concat_ws(" ", "a", "b").alias("broken"), F.concat("a", "b").alias("joined"))
    return pairs.join(vocabulary(docs, text).select(F.col("term").alias("joined"), F.col("n").alias("joined_seen")), "joined").select("id", "broken", "joined", "joined_seen")


def binding_problem(articles: DataFrame, law: str, group: str) -> DataFrame:
    """(group, bound): whether some law of each part of the corpus has the target's name in it."""
    return articles.groupBy(group).agg(F.coalesce(F.bool_or(F.contains("law_name", F.lit(law))), F.lit(False)).alias("bound"))


def admission(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """``files`` with ``refusal``: why an upload is not taken, null if it is."""
    size, end = F.length(content), tx.suffix(F.col(path))
    return files.withColumn(
        "refusal",
        F.when(size == 0, "empty file")
        .when(size > UPLOAD_BYTES, "file too large")
        .when(~end.isin(".pdf", ".txt"), "unsupported suffix")
        .when((end == ".pdf") & (F.substring(content, 1, 5) != F.lit("%PDF-").cast("binary")), "not a PDF"),
    )


@F.arrow_udf(T.StringType())
def _windows_1256(v: pa.Array) -> pa.Array:
    return pa.array([None if b is None else b.decode("cp1256") for b in v.to_pylist()], pa.string())


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``text`` (null if it is binary) and the encoding that read it: UTF-8, else Windows-1256."""
    raw = F.col(content)
    body = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.expr(f"substring(`{content}`, 4)")).otherwise(raw)
    has_nul = F.hex(raw).rlike("^(?:..)*?00")
    good = F.is_valid_utf8(body.cast("string"))
    return files.withColumn("encoding", F.when(has_nul, F.lit(None)).when(good, "utf-8").otherwise("windows-1256")).withColumn("text", F.when(has_nul, F.lit(None)).when(good, body.cast("string")).otherwise(_windows_1256(F.when(~good, body))))


def case_problems(cases: DataFrame, articles: DataFrame, cuts: DataFrame) -> DataFrame:
    """(id, problem): why a probe is not fit to be scored, null if it is.

    ``cases`` (id, probe, expected_articles, evidence, variants), ``articles`` (id, text) with one text an id, ``cuts`` (id, cut): the
    characters of an article that the encoder reads, absent if it reads all."""
    wanted = cases.select("id", F.posexplode_outer("expected_articles").alias("pos", "article_id"))
    texts = articles.select(F.col("id").alias("article_id"), "text")
    found = wanted.join(texts, "article_id", "left").join(cuts.select(F.col("id").alias("article_id"), "cut"), "article_id", "left")
    own = found.groupBy("id").agg(
        F.count("article_id").alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("article_id").isNotNull() & F.col("text").isNull(), F.col("article_id")))).alias("missing"),
        F.max(F.when(F.col("pos") == 0, F.col("text"))).alias("text"),
        F.max(F.when(F.col("pos") == 0, F.col("cut"))).alias("cut"),
    )
    rows = cases.join(own, "id", "left")
    place = F.instr("text", F.col("evidence")) - 1
    problem = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "INVALID: no expected articles")
        .when(F.size("missing") > 0, F.concat(F.lit("INVALID: not in corpus: "), F.array_join("missing", ", ")))
        .when((F.col("probe") == "orthographic_variant") & (F.coalesce(F.size("variants"), F.lit(0)) <= 0), "INVALID: no variants")
        .when(F.col("probe") == "orthographic_variant", F.lit(None).cast("string"))
        .when(F.coalesce("evidence", F.lit("")) == "", "INVALID: no evidence")
        .when(place < 0, "INVALID: evidence not found")
        .when((F.col("probe") == "tail_evidence") & F.col("cut").isNull(), "NOT-A-PROBE: not truncated")
        .when((F.col("probe") == "tail_evidence") & (place < F.col("cut")), "NOT-A-PROBE: evidence is read")
    )
    return rows.select("id", problem.alias("problem"))
