import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.operators import dense, evaluate, fusion, lexical

DOCS = {"a": "red blue blue", "b": "red red green", "c": "yellow", "d": "", "e": "blue green red red"}


def brute_bm25(query, docs):
    terms = {k: v.split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, terms.values())) / len(docs)
    out = {}
    for k, ts in terms.items():
        tf, s, hit = Counter(ts), 0.0, False
        for t in query.split():
            if tf[t]:
                df = sum(t in x for x in terms.values())
                idf = max(math.log((n - df + 0.5) / (df + 0.5) + 1), 1e-6)
                s += idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
                hit = True
        if hit:
            out[k] = round(s, 4)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("query", ["red", "blue blue green", "none", "", "yellow red"])
def test_bm25_is_brute_force(spark, query):
    terms = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    docs = spark.createDataFrame(list(DOCS.items()), "id string, text string")
    got = lexical.bm25(spark.createDataFrame([("q", query)], "id string, q string"), "id", terms("q"), docs, "id", terms("text"), 3).orderBy("rank").collect()
    want = brute_bm25(query, DOCS)[:3]
    assert [(r.id, pytest.approx(r.score, abs=2e-4)) for r in got] == [(k, s) for k, s in want]
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_bm25_ties_by_id(spark):
    rows = spark.createDataFrame([("q", "x", 1.0), ("q", "a", 1.0), ("q", "m", 2.0)], "query_id string, id string, score double")
    assert [r.id for r in lexical.ranked(rows, 3).orderBy("rank").collect()] == ["m", "a", "x"]
    assert [r.id for r in lexical.ranked(rows, 3, "desc").orderBy("rank").collect()] == ["m", "x", "a"]


def test_dense_is_brute_force_with_pooling(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 7, [float(x) for x in r]) for i, r in enumerate(v)], "id int, doc int, embedding array<double>")
    queries = rows.where("id in (0, 5)")
    got = dense.cosine_topk(queries, "id", rows, "doc", 3).collect()
    for q in (0, 5):
        best = sorted({d: round(max(float(v[q] @ v[i]) for i in range(60) if i % 7 == d), 4) for d in range(7)}.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(d, pytest.approx(s, abs=1e-4)) for d, s in best]


def test_library_search_merges_documents(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.0]), (1, 3, [0.8, 0.0]), (2, 4, [0.7, 0.0]), (3, 5, [1.0, 0.0])], "doc int, chunk int, embedding array<double>")
    live = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2023-01-01 00:00:00")], "doc int, c string").select("doc", F.to_timestamp("c").alias("created_at"))
    got = dense.library_search(spark.createDataFrame([(9, [1.0, 0.0])], "q int, embedding array<double>"), "q", rows, "doc", "chunk", 2, live)
    assert [(r.doc, r.chunk) for r in got.orderBy("rank").collect()] == [(1, 1), (1, 2)]


def test_index_problems(spark):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<double>")
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    assert dense.index_problems(good, docs, "id", 2).count() == 0
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (3, [1.0])], "id int, embedding array<double>")
    assert {r.problem: r.rows for r in dense.index_problems(bad, docs, "id", 2).collect()} == {"wrong_dimension": 1, "not_finite": 1, "document_without_vector": 1, "vector_without_document": 1}
    assert {r.problem for r in dense.index_problems(good.limit(0), docs, "id", 2).collect()} == {"empty", "document_without_vector"}


def test_unit_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(dense.unit(F.col("v")).alias("u")).collect()
    assert [r.u for r in rows] == [[0.6, 0.8], [0.0, 0.0]]


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, id string, rank int")
    got = fusion.reciprocal_rank_fusion([a, b], 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("y", round(1 / 61 + 1 / 62, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]
    texts = spark.createDataFrame([("x", "a b"), ("y", "c"), ("z", "a b c")], "id string, text string")
    words = lambda c: F.split(c, " ")
    best = fusion.rerank(a.unionByName(b).select("query_id", "id").distinct(), texts, spark.createDataFrame([("q", "a b c")], "query_id string, query string"), fusion.containment(words("query"), words("text")), 2)
    assert [r.id for r in best.orderBy("rank").collect()] == ["z", "x"]


def test_recall_counts_repeated_expectations(spark):
    expected = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b"), ("r", "c")], "query_id string, id string")
    hits = spark.createDataFrame([("q", "a", 2), ("q", "b", 9)], "query_id string, id string, rank int")
    got = {r.query_id: (r.recall, r.rr) for r in evaluate.per_question(expected, hits, 5).collect()}
    assert got == {"q": (round(2 / 3, 6), 0.5), "r": (0.0, 0.0)}


def test_scoreboard_total_and_empty_averages(spark):
    questions = spark.createDataFrame([("q", "direct", True), ("r", "out", False), ("s", None, True)], "query_id string, category string, answerable boolean")
    scores = spark.createDataFrame([("q", 1.0, 0.5)], "query_id string, recall double, rr double")
    got = {r.category: (r.questions, r.scored, r.recall, r.mrr) for r in evaluate.scoreboard(questions, scores).collect()}
    assert got == {"direct": (1, 1, 1.0, 0.5), "out": (1, 0, None, None), "(none)": (1, 0, None, None), "TOTAL": (3, 1, 1.0, 0.5)}


def test_nearest_rank_percentile(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 46)] + [("b", 1.0)], "g string, v double")
    got = {r.g: r.p95 for r in evaluate.latency_summary(rows, "g", "v").collect()}
    assert got == {"a": float(round(0.95 * 45 + 0.5)), "b": 1.0}


def test_bootstrap_interval_spreads(spark):
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(100)], "i int, v double")
    r = evaluate.bootstrap_interval(rows, "v", "i", 300).first()
    assert r.n == 100 and r.mean == 0.5 and 0.36 < r.low < 0.45 < 0.55 < r.high < 0.64


def test_mix_and_reweight(spark):
    mix = evaluate.mix(spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "c string"), "c")
    rates = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "category string, rate double")
    assert evaluate.reweighted(rates, mix).first().rate == 0.75


def test_probe_ranks_and_ablation(spark):
    cases = spark.createDataFrame([("a", "x", ["y", "z"]), ("b", "x", ["y"]), ("c", "x", None)], "query_id string, expected string, distractors array<string>")
    hits = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("a", "z", 3), ("b", "y", 4), ("c", "x", 5)], "query_id string, id string, rank int")
    got = {r.query_id: (r.expected_rank, r.outranked_by, r.passed) for r in evaluate.probe_ranks(cases, hits, 5).collect()}
    assert got == {"a": (2, ["y"], False), "b": (None, ["y"], False), "c": (5, [], True)}
    scores = spark.createDataFrame([("bm25", "a", 0.5, 1.0), ("bm25", "b", 0.0, 0.0), ("dense", "a", 1.0, 1.0), ("dense", "b", 0.5, 0.5)], "config string, query_id string, recall double, rr double")
    table = {r.config: r for r in evaluate.ablation(scores, spark.createDataFrame([("a", "direct"), ("b", None)], "query_id string, category string"), "bm25", ["direct"]).collect()}
    assert (table["dense"].recall, table["dense"].mrr, table["dense"].direct_recall, table["dense"].delta) == (0.75, 0.75, 1.0, 0.5) and table["bm25"].delta == 0.0


def test_hashed_terms_are_unit_counts(spark):
    rows = spark.createDataFrame([(["a", "a", "b"],), ([],)], "ts array<string>").select(dense.hashed_terms(F.col("ts"), 8).alias("v")).collect()
    assert len(rows[0].v) == 8 and math.isclose(sum(x * x for x in rows[0].v), 1) and sorted(x > 0 for x in rows[0].v).count(True) in (1, 2)
    assert list(rows[1].v) == [0.0] * 8
