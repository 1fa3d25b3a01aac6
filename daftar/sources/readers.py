"""Scans: JSON lines, question files with comments, recognised pages, ground truth, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.operators.quality import admission, decoded

ARTICLE = "id string, book string, number int, text string, search_text string, char_len int, source_file string, law_name string"
CHUNK = "id string, doc_id string, number int, article int, label string, page int, text string"
QUESTION = "id string, category string, question string, expected_articles array<string>, expected_keywords array<string>, answerable boolean, ref_status string, split string, notes string"
SUFFIXES = (".pdf", ".txt")
NOT_SOURCES = ("source.txt",)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped, a fixed schema; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def questions(spark: SparkSession, path: str, default_split: str = "dev") -> DataFrame:
    """Question rows with ``line`` and ``violation``: blank lines and ``//`` comments skipped, a broken line kept with its fault."""
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> '' and not startswith(trim(value), '//')")
    fields = T._parse_datatype_string(QUESTION)
    parsed = raw.withColumn("q", F.from_json("value", fields, {"mode": "PERMISSIVE"})).withColumn("v", F.expr("try_parse_json(value)"))
    names = [f.name for f in fields.fields if f.name not in ("split", "notes", "ref_status")]
    missing = F.array_compact(F.array(*[F.when(F.get_json_object("value", f"$.{n}").isNull(), F.lit(n)) for n in names]))
    violation = F.when(F.col("v").isNull(), "invalid JSON").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return parsed.select("line", "q.*", violation.alias("violation")).withColumn("split", F.coalesce("split", F.lit(default_split)))


def recognised_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, page, text) of an engine's output: an object of page key to text or list of lines; ``p07``, ``07`` and ``7`` are one page."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("page", "body"))
    many = F.from_json("body", "array<string>")
    text = F.when(F.startswith(F.trim("body"), F.lit("[")) & many.isNotNull(), F.array_join(many, "\n")).otherwise(F.col("body"))
    rows = raw.where("not startswith(page, '_')").select(F.coalesce(F.regexp_extract("page", r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("page_no"), "page", text.alias("text"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("page_no").orderBy("page"))).where("r = 1").drop("r")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, tokens, furniture): hand-checked digits of each page; keys that begin with ``_`` are comments."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("page", "body")).where("not startswith(page, '_')")
    body = F.from_json("body", "tokens array<string>, furniture array<string>")
    return raw.select(F.coalesce(F.regexp_extract("page", r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("page_no"), body.alias("b")).select("page_no", "b.tokens", "b.furniture")


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's sources, not its subfolders, without bookkeeping files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.where(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*SUFFIXES) & ~name.isin(*NOT_SOURCES)).select("path", "length", "content").orderBy("path")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with ``refusal`` (null if taken), ``text`` and ``encoding`` of the text files that are."""
    rows = admission(source_files(spark, folder))
    return decoded(rows).withColumn("text", F.when(F.col("refusal").isNull() & F.lower("path").endswith(".txt"), F.col("text")))


def text_pages(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, page, text): form feeds part the pages of a text, counted from 1."""
    return files.where(f"`{text}` is not null").select(key, F.posexplode(F.split(text, "\f")).alias("p", "t")).select(key, (F.col("p") + 1).alias("page"), F.col("t").alias("text"))
