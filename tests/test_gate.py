from pyspark.sql import functions as F

import __spark_entry__ as entry
from daftar.functions import citations
from daftar.operators import answers as an
from daftar.plans import catalog


def tables(spark, path, answers, articles):
    """A data folder with answers (answer_no, text, retrieved) and articles (article_ref, id, text)."""
    rows = spark.createDataFrame(answers, "answer_no bigint, text string, retrieved array<int>")
    rows.write.parquet(f"{path}/answer_rows.parquet")
    arts = spark.createDataFrame(articles, "article_ref string, id string, text string")
    arts.selectExpr("*", "text as search_text", "length(text) as char_len", "'Law' as law_name", "'f' as source_file").write.parquet(f"{path}/articles.parquet")
    return str(path)


def test_all_sentences_of_an_answer_are_gated(spark, tmp_path):
    text = "النص الأول [مادة 7]. النص الثاني [مادة 7]. النص الثالث [مادة 7]. النص الرابع [مادة 9]. بلا مصدر"
    d = tables(spark, tmp_path, [(1, text, [7])], [("a", "law-7", "نص المادة"), ("b", "law-9", "نص آخر")])
    got = {r.claim_no: r.reason for r in entry.queries()["gate_claims"](spark, d).collect()}
    assert got == {0: "kept", 1: "kept", 2: "kept", 3: "fabricated", 4: "uncited"}
    verdict = entry.queries()["gate_verdicts"](spark, d).first()
    assert (verdict.status, verdict.kept, verdict.dropped) == ("partial", 3, 2)
    assert [(r.reason, r.status) for r in entry.queries()["abstain_reasons"](spark, d).collect()] == [("(none)", "partial")]


LONG = "يلتزم صاحب العمل بأن يؤدي للعامل أجره كاملا في موعد لا يجاوز نهاية الشهر طبقا لحكم المادة 33 من هذا القانون"


def test_every_text_of_an_article_number_counts(spark, tmp_path):
    arts = [("a", "law-7", "نص المادة"), ("b", "law-7", f"تمهيد {LONG} وختام"), ("c", "law-33", "نص")]
    answers = [(1, LONG + " [مادة 7]", [7]), (2, "كما ورد في المادة 33 وفق [مادة 7]", [7]), (3, LONG + " [مادة 33]", [33]), (4, None, None)]
    d = tables(spark, tmp_path, answers, arts)
    got = {r.answer_no: (r.copied, r.cited) for r in entry.queries()["audit_answers"](spark, d).collect()}
    assert got == {1: ("7,33", ""), 2: ("", "7,33"), 3: ("", "33"), 4: ("", "")}
    gated = {r.query_id: (r.reason, r.copied) for r in entry.queries()["gate_claims"](spark, d).collect()}
    assert gated[3] == ("kept", False)
    # the second claim cites 33 by its own place too, which isn't retrieved
    assert gated[1][0] == gated[2][0] == "fabricated"


def test_gate_over_many_texts(spark):
    claims = spark.createDataFrame([(1, 0, LONG + " [مادة 7]", [1]), (1, 1, "كما ورد في المادة 33", [1]), (1, 2, "المادة 34", [1]), (1, 3, LONG, [2]), (2, 0, "x", [])], "query_id bigint, claim_no int, text string, sources array<int>")
    sources = spark.createDataFrame([(1, 1, 7), (1, 2, 33)], "query_id bigint, n int, article int")
    texts = spark.createDataFrame([(7, "نص المادة"), (7, f"تمهيد {LONG} وختام"), (33, "نص")], "article int, text string")
    got = {(r.query_id, r.claim_no): (r.reason, r.copied) for r in an.gate_corpus(claims, sources, texts, compat=False).collect()}
    assert got == {(1, 0): (None, True), (1, 1): (None, False), (1, 2): ("ungrounded", None), (1, 3): (None, False), (2, 0): ("uncited", None)}


def broadcast_runs(df):
    """Joins in the plan as first made, before any runtime figure, that send the runs of texts through the driver."""
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin [" in x and "h#" in x and "g#" in x]


def test_runs_of_texts_never_pass_through_the_driver_in_app_summary(spark, tmp_path, monkeypatch):
    # the planner takes the runs, thirty times the texts and more, for smaller than the texts
    answers = [(1, LONG + " [مادة 7]", [7], True, [7], 1.5), (2, "وفق [مادة 7]", [7], True, [7], 0.5), (3, "لا شيء", [7], False, [7], 1.0)]
    d = tables(spark, tmp_path, [], [("a", "law-7", f"تمهيد {LONG} وختام"), ("b", "law-33", "نص")])
    spark.createDataFrame(answers, "answer_no bigint, text string, retrieved array<int>, answerable boolean, expected array<int>, seconds double").write.mode("overwrite").parquet(f"{d}/answer_rows.parquet")
    plans = watch_checkpoints(monkeypatch)
    got = entry.queries()["app_summary"](spark, d).first()
    assert (got.answerable, got.covered, got.page_grounded, got.fabricated, got.mean_seconds) == (2, 1, 1, 1, 1.0)
    assert plans and not any(broadcast_runs(df) for df in plans)


def watch_checkpoints(monkeypatch):
    plans, write = [], catalog.cut_lineage
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: plans.append(df) or write(df))
    return plans


def test_claims_report_counts_copies_and_leaves_the_runs_to_the_executors(spark, tmp_path, monkeypatch):
    answers = [(1, LONG + " [مادة 7]", [7, 33], True, [33], 1.5), (2, "وفق [مادة 7]", [7], True, [7], 0.5)]
    d = tables(spark, tmp_path, [], [("a", "law-7", f"تمهيد {LONG} وختام"), ("b", "law-33", "نص")])
    spark.createDataFrame(answers, "answer_no bigint, text string, retrieved array<int>, answerable boolean, expected array<int>, seconds double").write.mode("overwrite").parquet(f"{d}/answer_rows.parquet")
    plans = watch_checkpoints(monkeypatch)
    got = entry.queries()["claims_report"](spark, d).first()
    assert (got.kept_claims, got.copied_claims, got.cited_expected, got.fabricated) == (2, 1, 2, 0)
    assert plans and not any(broadcast_runs(df) for df in plans)


def test_gate_claims_joins_runs_by_shuffle_and_resolves_stray_numbers(spark, tmp_path):
    # the second text of law-7 cites 33, so a claim of its own that does so by another writing is grounded; 34 is cited by none
    arts = [("a", "law-7", f"تمهيد {LONG} وختام"), ("b", "law-33", "نص")]
    d = tables(spark, tmp_path, [(1, f"{LONG} [مادة 7]. كما في المادة 3​3 وفق [مادة 7]. كما في المادة 3​4 وفق [مادة 7]", [3, 7, 33])], arts)
    df = entry.queries()["gate_claims"](spark, d)
    assert {r.claim_no: (r.reason, r.copied) for r in df.collect()} == {0: ("kept", True), 1: ("kept", False), 2: ("ungrounded", None)}
    assert not broadcast_runs(df)


def test_runs_of_long_texts_are_all_there(spark):
    """Stretches overlap, so no run is lost where one ends; a full bit map lets all pass, an empty one none."""
    text = "".join(chr(0x628 + (i * i + i // 7) % 19) for i in range(1100))
    texts = spark.createDataFrame([(7, text), (7, text[:59]), (8, text[250:330])], "article int, text string")
    runs = citations.run_hashes(texts, "article", F.col("text"))
    want = {(n, t[i : i + 60]) for n, t in ((7, text), (8, text[250:330])) for i in range(len(t) - 59)}
    hashed = spark.createDataFrame(sorted(want), "article int, run string").select("article", F.xxhash64("run").alias("h"), F.hash("run").alias("g"))
    assert {tuple(r) for r in runs.collect()} == {tuple(r) for r in hashed.collect()}
    some = hashed.where("pmod(g, 10) = 0")
    kept = citations.run_hashes(texts, "article", F.col("text"), citations.hash_marks(some))
    assert {tuple(r) for r in some.collect()} <= {tuple(r) for r in kept.collect()} and kept.count() < len(want) // 5
    assert citations.run_hashes(texts, "article", F.col("text"), citations.hash_marks(hashed.limit(0))).count() == 0


def test_audit_joins_runs_by_shuffle(spark, tmp_path):
    arts = [("a", "law-7", f"تمهيد {LONG} وختام"), ("b", "law-33", "نص"), ("c", "law-8", f"{LONG} وختام")]
    d = tables(spark, tmp_path, [(1, LONG + " [مادة 7]", [7, 7, 33]), (2, LONG, [33]), (3, None, [7]), (4, LONG + " [مادة 8]", None), (5, LONG, [7, 8])], arts)
    df = entry.queries()["audit_answers"](spark, d)
    assert {r.answer_no: (r.copied, r.cited, r.uncited) for r in df.collect()} == {1: ("7,33", "", 1), 2: ("", "33", 0), 3: ("", "", 0), 4: ("", "8,33", 0), 5: ("33", "", 1)}
    assert not broadcast_runs(df)


def test_claims_report_splits_answers_into_sentences_once(spark, tmp_path):
    """The claims that the gate kept are counted; what they rest on is not worked out again."""
    answers = [(1, LONG + " [مادة 7]. قصير [مادة 33]", [7, 33], True, [33], 1.5), (2, "وفق [مادة 8]. وفق [مادة 7]", [7], True, [8], 0.5), (3, None, None, False, None, 1.0)]
    d = tables(spark, tmp_path, [], [("a", "law-7", f"تمهيد {LONG} وختام"), ("b", "law-33", "نص")])
    spark.createDataFrame(answers, "answer_no bigint, text string, retrieved array<int>, answerable boolean, expected array<int>, seconds double").write.mode("overwrite").parquet(f"{d}/answer_rows.parquet")
    df = entry.queries()["claims_report"](spark, d)
    got = df.first()
    assert (got.kept_claims, got.copied_claims, got.short_claims, got.cited_expected, got.fabricated) == (3, 1, 2, 1, 1)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_replace(" not in plan


def test_sources_listed_with_the_claims_need_no_table(spark):
    """The same verdicts for the retrieved list as a column as for a table of its places; no shuffle gathers it again."""
    rows = [(1, 0, LONG + " [مادة 7]", [1], [7, 33, 7]), (1, 1, "المادة 34", [2], [7, 33, 7]), (1, 2, "المادة 33", [3, 2], [7, 33, 7]), (1, 3, "x", [0], [7, 33, 7]), (1, 4, "x", [4], [7, 33, 7]), (2, 0, "x", [1], []), (3, 0, "x", [], [7]), (3, 1, "x", None, [7]), (4, 0, "x", [2], [7, None])]
    claims = spark.createDataFrame(rows, "query_id bigint, claim_no int, text string, sources array<int>, retrieved array<int>")
    sources = spark.createDataFrame([(1, 1, 7), (1, 2, 33), (1, 3, 7), (3, 1, 7), (4, 1, 7), (4, 2, None)], "query_id bigint, n int, article int")
    texts = spark.createDataFrame([(7, f"تمهيد {LONG} وختام"), (33, "نص")], "article int, text string")
    got = {(r.query_id, r.claim_no): (r.reason, r.copied) for r in an.gate_corpus(claims, "retrieved", texts, compat=False).collect()}
    assert got == {(r.query_id, r.claim_no): (r.reason, r.copied) for r in an.gate_corpus(claims, sources, texts, compat=False).collect()}
    assert [got[1, i] for i in range(5)] == [(None, True), ("ungrounded", None), (None, False), ("fabricated", None), ("fabricated", None)]
    assert [got[2, 0], got[3, 0], got[3, 1], got[4, 0]] == [("fabricated", None), ("uncited", None), ("uncited", None), (None, False)]


def test_windows_collapse_their_sentence_once(spark):
    assert str(citations.copied_windows(F.col("s"))).count("regexp_replace") == 1
    text = "  " + "".join(chr(0x628 + (i * i + i // 7) % 19) for i in range(200)) + " \n x"
    got = spark.createDataFrame([(text,), ("short",), (None,)], "s string").select(F.size(citations.copied_windows(F.col("s"))).alias("n"))
    assert [r.n for r in got.collect()][:2] == [5, 0]
