"""Searches leave no more behind than their best documents, whatever the size of the tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from daftar.operators import lexical
from tests.test_search import brute_bm25


@pytest.fixture
def no_tokens_written(monkeypatch):
    def refuse(df):
        raise AssertionError("the terms of all documents were written to the checkpoint folder")

    monkeypatch.setattr(lexical, "cut_lineage", refuse)


def tables(spark, path, docs=300):
    rng = random.Random(5)
    word = lambda: rng.choice(["عقد", "عمل", "أجر", "مدة", "بيع", "ايجار", "محكمة", "شركة"])
    text = lambda n: " ".join(word() for _ in range(n))
    arts = [(f"A{i:04}", f"law-{i % 90}", text(3 + i % 12)) for i in range(docs)]
    rows = spark.createDataFrame(arts, "article_ref string, id string, text string").repartition(5)
    rows.selectExpr("*", "text as search_text", "length(text) as char_len", "'Law' as law_name", "'f' as source_file").write.parquet(f"{path}/articles.parquet")
    asked = [(f"q{i}00", "direct", text(4), [f"law-{i}", f"law-{i + 1}"], True) for i in range(12)]
    rows = spark.createDataFrame(asked, "id string, category string, question string, expected_articles array<string>, answerable boolean")
    rows.selectExpr("*", "array('x') as expected_keywords", "'s' as split", "'t' as source").write.parquet(f"{path}/questions.parquet")
    return str(path)


def against_sql(spark, d, name):
    import duckdb

    con = duckdb.connect()
    for t in ("articles", "questions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str) and want


def test_ablation_table_writes_no_terms(spark, tmp_path, no_tokens_written):
    against_sql(spark, tables(spark, tmp_path), "ablation_table")


def test_orthographic_stability_writes_no_terms(spark, tmp_path, no_tokens_written):
    against_sql(spark, tables(spark, tmp_path), "orthographic_stability")


def test_orthographic_sweep_writes_no_terms(spark, tmp_path, no_tokens_written):
    against_sql(spark, tables(spark, tmp_path), "orthographic_sweep")


@pytest.mark.parametrize("ties", ["asc", "desc"])
def test_blocks_and_partitions_keep_the_best(spark, no_tokens_written, monkeypatch, ties):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh")
    docs = {f"d{i:03}": " ".join(word() for _ in range(i % 6)) for i in range(200)}
    asked = {f"q{i}": " ".join(word() for _ in range(1 + i % 4)) for i in range(11)} | {"again": "a b", "turned": "b a", "none": "z", "empty": ""}
    terms = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    rows = spark.createDataFrame(list(docs.items()), "id string, text string").repartition(7)
    hits = lexical.bm25(spark.createDataFrame(list(asked.items()), "id string, q string"), "id", terms("q"), rows, "id", terms("text"), 5, ties=ties)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q, text in asked.items():
        want = brute_bm25(text, docs)
        want = sorted(sorted(want, reverse=ties == "desc"), key=lambda x: -x[1])[:5]
        assert got.get(q, []) == [(i, pytest.approx(s, abs=1e-6)) for i, s in want]
