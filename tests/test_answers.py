import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daftar.operators import answers as an
from daftar.operators import identity, models, ocr, quality
from daftar.streaming import library, limits


def replies(spark, *raws):
    return spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")


def claim(text="نص", sources=(1,)):
    return {"text": text, "sources": list(sources)}


CASES = [
    ({"abstain": False, "claims": [claim()]}, None),
    ({"abstain": True, "claims": []}, None),
    ("nonsense", "invalid JSON"),
    ([1], "not an object"),
    ({"abstain": 1, "claims": []}, "abstain is not a boolean"),
    ({"abstain": False}, "claims is not a list"),
    ({"abstain": False, "claims": [claim()] * 4}, "too many claims"),
    ({"abstain": False, "claims": [3]}, "claim is not an object"),
    ({"abstain": False, "claims": [{"sources": [1]}]}, "claim has no text"),
    ({"abstain": False, "claims": [claim("  ")]}, "claim text is empty"),
    ({"abstain": False, "claims": [claim("x" * 301)]}, "claim text is too long"),
    ({"abstain": False, "claims": [claim(sources=[True])]}, "claim sources are not integers"),
    ({"abstain": False, "claims": [{"text": "x", "sources": 1}]}, "claim sources are not integers"),
]


def test_claims_contract(spark):
    raws = [c if isinstance(c, str) else json.dumps(c) for c, _ in CASES]
    got = an.parsed_claims(replies(spark, *raws)).orderBy("i").collect()
    assert [r.violation for r in got] == [v for _, v in CASES]
    assert got[0].claims[0].sources == [1] and got[1].abstain is True and got[2].claims is None
    assert [models.claims_violation(r) for r in raws] == [v for _, v in CASES]


def test_relevance_contract(spark):
    got = an.parsed_relevance(replies(spark, '{"answers": true}', '{"answers": "yes"}', "x", "[]")).orderBy("i").collect()
    assert [(r.relevant, r.violation) for r in got] == [(True, None), (None, "answers is not a boolean"), (None, "invalid JSON"), (None, "not an object")]


def test_gate_rules_in_order(spark):
    claims = spark.createDataFrame(
        [(1, 0, "مادة 7 تنص", [1]), (1, 1, "بلا مصدر", []), (1, 2, "مصدر غائب", [5]), (1, 3, "المادة 9 تنص", [1]), (1, 4, "مادة 1‏2", [1]), (1, 5, "المادة ٣٣ كما ورد", [2]), (2, 0, "x", [1])],
        "query_id int, claim_no int, text string, sources array<int>",
    )
    sources = spark.createDataFrame([(1, 1, 7, "نص المادة"), (1, 2, 8, "انظر المادة 33 من القانون")], "query_id int, n int, article int, text string")
    gated = an.gate(claims, sources)
    assert [r.reason for r in gated.orderBy("query_id", "claim_no").collect()] == [None, "uncited", "fabricated", "ungrounded", "ungrounded", None, "fabricated"]
    heads = spark.createDataFrame([(1, True, False, None), (2, True, False, None), (3, True, True, None), (4, False, None, None), (5, True, False, "no_sources")], "query_id int, parsed boolean, abstain boolean, own_reason string")
    got = {r.query_id: (r.status, r.kept, r.dropped, r.abstain_reason) for r in an.gate_verdicts(heads, gated).collect()}
    assert got == {1: ("partial", 2, 4, None), 2: ("abstained", 0, 1, "all_dropped"), 3: ("abstained", 0, 0, "model_abstained"), 4: ("abstained", 0, 0, "schema_failure"), 5: ("abstained", 0, 0, "no_sources")}


def test_audit(spark):
    law = "استثناء من حكم المادة (14) من هذا القانون يجوز للوزير المختص أن يصدر قرارا بتنظيم العمل في جميع الجهات"
    rows = spark.createDataFrame([(1, "يلتزم صاحب العمل بالسداد خلال شهر [مادة 7]. المدة شهران كاملان من تاريخ الإخطار"), (2, law + "."), (3, "لا أستطيع الإجابة من المواد المتاحة"), (4, "حسب [مادة 99] و[مادة 8]"), (5, None)], "i int, text string")
    out = an.audit(rows, F.array(*map(F.lit, [7, 8, 14])), F.array(F.lit(7)), F.array(F.lit(law))).orderBy("i").collect()
    assert out[0].a_cited == [7] and len(out[0].a_uncited) == 1 and not out[0].a_grounded
    assert out[1].a_cited == [] and out[1].a_copied == [14]
    assert out[2].a_abstained and out[2].a_grounded
    assert out[3].a_fabricated == [99] and out[3].a_ungrounded == [8] and out[3].a_strict == [99, 8]
    assert out[4].a_cited == []


def test_call_tallies(spark):
    rows = spark.createDataFrame([(1, [("a", 10, 2.0, True, False), ("a", 20, 1.0, None, True)]), (2, [(None, 5, 0.0, False, False)]), (3, None)], "k int, stats array<struct<stage:string,output_tokens:int,output_s:double,truncated:boolean,cut:boolean>>")
    got = {r.stage: (r.calls, r.tokens, r.tokens_per_s, r.truncated, r.cut) for r in an.call_statistics(rows).collect()}
    assert got == {"a": (2, 30, 10.0, 1, 1), "(none)": (1, 5, None, 0, 0)}
    assert {r.stage: r.retries for r in an.retries(rows, "k").collect()} == {"a": 1, "(none)": 0}


def test_run_comparison_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, t string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "w")], "id int, t string")
    assert {(r.id, r.side, r.t_same) for r in an.run_comparison(a, b, "id", ["t"]).collect()} == {(1, "both", True), (2, "both", True), (3, "a", None), (4, "b", None)}
    assert {(r.id, r.change) for r in an.set_changes(a, b, "id").collect()} == {(4, "added"), (3, "dropped")}


def test_variance(spark):
    rows = spark.createDataFrame([("r1", "q", "x", 1.0), ("r2", "q", "x", 2.0), ("r3", "q", "y", 1.0), ("r1", "p", "s", 1.0), ("r2", "p", "s", 2.0), ("r3", "p", "s", 1.0)], "run string, q string, t string, m double")
    r = an.variance(rows, "run", "q", "t", "m").first()
    assert (r.runs, r.signatures, r.varying, r.span) == (3, 2, 1, 1.0)


def test_digit_gate(spark):
    pages = lambda *x: spark.createDataFrame(list(x), "key string, text string")
    want, got = pages(("p1", "١٢ و12 و7"), ("p2", "5")), pages(("p1", "12 9 ٧"), ("p3", "1"))
    scores = ocr.digit_scores(ocr.digit_counts(want, "key", "text"), ocr.digit_counts(got, "key", "text"))
    assert {r.key: (r.expected, r.found, r.correct, r.missing, r.spurious) for r in scores.collect()} == {"p1": (3, 3, 2, 1, 1), "p2": (1, 0, 0, 1, 0), "p3": (0, 1, 0, 0, 1)}
    assert ocr.gate_totals(scores).first().passed is False


def test_furniture_budget_removes_one_occurrence(spark):
    tokens = spark.createDataFrame([("p", i, t) for i, t in enumerate(["12", "5", "12", "12"])], "key string, pos int, token string")
    budget = spark.createDataFrame([("p", "12", 1)], "key string, token string, budget int")
    assert [(r.pos, r.token) for r in ocr.budget_removed(tokens, budget).orderBy("pos").collect()] == [(1, "5"), (2, "12"), (3, "12")]


def test_question_rules(spark):
    rows = spark.createDataFrame([("a", "direct", "q", ["x"], True, "dev", 1), ("a", "new", "", [], True, "dev", 2), ("b", "direct", "q", ["x"], False, None, 3)], "id string, category string, question string, expected_articles array<string>, answerable boolean, split string, o int")
    got = [r.errors for r in quality.question_errors(rows, "o").orderBy("o").collect()]
    assert got == [[], ["missing question", "unknown category", "duplicate id", "answerable without expected articles"], ["unknown split", "unanswerable with expected articles"]]


def test_references_bands_and_broken_words(spark):
    questions = spark.createDataFrame([("q", ["law-1", "law-9"], ["kw", "no"])], "id string, expected_articles array<string>, expected_keywords array<string>")
    arts = spark.createDataFrame([("law-1", "has kw inside")], "id string, text string")
    assert [r.article_id for r in quality.missing_references(questions, arts).collect()] == ["law-9"]
    assert [r.keyword for r in quality.missing_keywords(questions, arts).collect()] == ["no"]
    docs = spark.createDataFrame([("d", "القانو ن يسري، القانون")], "id string, text string")
    assert [(r.broken, r.joined, r.joined_seen) for r in quality.broken_words(docs, "id").collect()] == [("القانو ن", "القانون", 1)]
    assert quality.broken_words(docs.limit(0), "id").count() == 0


def test_uploads(spark):
    files = spark.createDataFrame([("a.txt", bytearray()), ("b.exe", bytearray(b"x")), ("c.pdf", bytearray(b"no")), ("d.pdf", bytearray(b"%PDF-1.7")), ("e.txt", bytearray("نص".encode("cp1256"))), ("f.txt", bytearray(b"\xef\xbb\xbfok")), ("g.txt", bytearray(b"a\x00b"))], "path string, content binary")
    got = {r.path: r.refusal for r in quality.admission(files).collect()}
    assert got == {"a.txt": "empty file", "b.exe": "unsupported suffix", "c.pdf": "not a PDF", "d.pdf": None, "e.txt": None, "f.txt": None, "g.txt": None}
    texts = {r.path: (r.text, r.encoding) for r in quality.decoded(files).collect()}
    assert texts["e.txt"] == ("نص", "windows-1256") and texts["f.txt"] == ("ok", "utf-8") and texts["g.txt"] == (None, None)


def brute_limits(events, most, window):
    kept, out = {}, {}
    for key, ts, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        times = kept.setdefault(key, [])
        times[:] = [t for t in times if t > ts - window]
        out[i] = len(times) < most
        if out[i]:
            times.append(ts)
    return out


def test_rate_limit_counts_accepted_events_only(spark):
    base = datetime(2024, 1, 1)
    events = [("k", s, i) for i, s in enumerate([0, 1, 2, 3, 10, 11, 12, 20])] + [("m", 5, 100)]
    rows = spark.createDataFrame([(k, base + timedelta(seconds=s), i) for k, s, i in events], "k string, ts timestamp, i bigint")
    got = {r.event_id: r.accepted for r in limits.limited(rows, "k", "ts", "i", 2, 10.0).collect()}
    assert got == brute_limits(events, 2, 10)
    assert limits.limited(rows.limit(0), "k", "ts", "i", 2, 10.0).count() == 0


def test_rate_limit_stream(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", base + timedelta(seconds=s), s) for s in (0, 1, 2, 11)], "k string, ts timestamp, i bigint")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = limits.limited_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts", "i", 2, 10.0)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 11: True}


def test_library_upsert_restores_and_replaces(spark):
    columns = "doc_id string, sha256 string, title string, created_at string, deleted boolean, deleted_at string"
    old = spark.createDataFrame([("a", "h1", "A", "1", True, "t"), ("b", "bad", "B", "1", False, None), ("c", "h3", "C", "1", False, None)], columns)
    new = spark.createDataFrame([("a", "h1", "A2", "2", False, None), ("b", "h2", "B2", "2", False, None), ("d", "h4", "D", "2", False, None)], columns)
    got = {r.doc_id: (r.sha256, r.title, r.deleted) for r in library.merged(old, new).collect()}
    assert got == {"a": ("h1", "A", False), "b": ("h2", "B2", False), "c": ("h3", "C", False), "d": ("h4", "D", False)}
    gone = library.soft_deleted(old, spark.createDataFrame([("c",)], "doc_id string"), "now")
    assert {r.doc_id: (r.deleted, r.deleted_at) for r in gone.collect()} == {"a": (True, "t"), "b": (False, None), "c": (True, "now")}


def test_library_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h1", "A", "1", False, None)], "doc_id string, sha256 string, title string, created_at string, deleted boolean, deleted_at string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    library.upsert_stream(stream, str(tmp_path / "lib"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.doc_id for r in library.read_library(spark, str(tmp_path / "lib")).collect()] == ["a"]


def test_identity(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "id int, text string")
    assert [(r.copies, r.first_id) for r in identity.duplicates(docs, "id", "text").collect()] == [(2, 1)]
    a = identity.set_fingerprint(docs, ["id", "text"]).first().fingerprint
    assert a == identity.set_fingerprint(docs.orderBy(F.desc("id")), ["id", "text"]).first().fingerprint
    assert a != identity.set_fingerprint(docs.where("id < 4"), ["id", "text"]).first().fingerprint


def test_injected_models(spark):
    def encoder():
        import numpy as np

        return lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts], dtype=float)

    rows = spark.createDataFrame([(1, "aaa"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in models.encoded(rows, ["id"], "text", encoder, prefix="").collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0]}

    def chat():
        def reply(messages):
            if "relevance" in messages[0]["content"]:
                return '{"answers": true}' if "good" in messages[1]["content"] else "no json"
            return '{"abstain": false, "claims": []}'

        return reply

    asked = spark.createDataFrame([(1, "good", ["s"]), (2, "bad", ["s"]), (3, "good", [])], "id int, question string, sources array<string>")
    out = {r.id: (r.own_reason, r.violation) for r in models.staged_claims(asked, "id", "sources", chat, "relevance", "claims").collect()}
    assert out == {1: (None, None), 2: ("relevance_failure", None), 3: ("no_sources", None)}


@pytest.mark.parametrize("many", [1, 3])
def test_formatted_sources(spark, many):
    row = spark.createDataFrame([(["t"] * many,)], "s array<string>").select(models.formatted_sources(F.col("s")).alias("x")).first()
    assert row.x == "\n\n".join(f"[{i}]\nt" for i in range(1, many + 1))


def test_probe_cases(spark):
    schema = "id string, probe string, expected_articles array<string>, evidence string, variants array<string>"
    cases = [
        ("a", "tail_evidence", [], "x", None), ("b", "tail_evidence", ["gone"], "x", None), ("c", "orthographic_variant", ["l"], None, []), ("d", "orthographic_variant", ["l"], None, ["v"]),
        ("e", "tail_evidence", ["l"], None, None), ("f", "tail_evidence", ["l"], "zzz", None), ("g", "tail_evidence", ["m"], "tail", None), ("h", "tail_evidence", ["l"], "head", None), ("i", "tail_evidence", ["l"], "tail", None), ("j", "tail_evidence", None, "x", None),
    ]
    arts = spark.createDataFrame([("l", "head and tail"), ("m", "tail")], "id string, text string")
    got = {r.id: r.problem for r in quality.case_problems(spark.createDataFrame(cases, schema), arts, spark.createDataFrame([("l", 5)], "id string, cut int")).collect()}
    assert got == {
        "a": "INVALID: no expected articles", "b": "INVALID: not in corpus: gone", "c": "INVALID: no variants", "d": None, "e": "INVALID: no evidence",
        "f": "INVALID: evidence not found", "g": "NOT-A-PROBE: not truncated", "h": "NOT-A-PROBE: evidence is read", "i": None, "j": "INVALID: no expected articles",
    }


def test_reports_of_a_claims_run(spark):
    from daftar.operators import answers as an

    told = spark.createDataFrame([(1, True, True, 2.0), (2, True, False, 4.0), (3, False, False, 6.0), (4, False, False, None)], "query_id long, answerable boolean, cites_expected boolean, seconds double")
    verdicts = spark.createDataFrame(
        [(1, 2, 1, 0, 1, 0, 0, "partial", None), (2, 0, 0, 0, 0, 0, 2, "abstained", "model_abstained"), (3, 0, 0, 0, 0, 0, 0, "abstained", "schema_failure"), (4, 1, 0, 0, 0, 0, 0, "answered", None)],
        "query_id long, kept long, dropped long, uncited long, fabricated long, ungrounded long, ignored_on_abstain long, status string, abstain_reason string",
    )
    claims = spark.createDataFrame([(1, "a claim that is long enough to be one", None, True), (1, "short", None, False), (1, "x", "fabricated", None), (2, "ignored", None, False), (4, "another claim of enough letters", None, False)], "query_id long, text string, reason string, copied boolean")
    r = an.claims_report(told, verdicts, claims).first()
    assert (r.answerable, r.unanswerable, r.covered, r.false_abstentions, r.right_abstentions, r.cited_expected) == (2, 2, 1, 1, 1, 1)
    assert (r.schema_failures, r.ignored_on_abstain, r.fabricated, r.kept_claims, r.copied_claims, r.short_claims) == (1, 2, 1, 3, 1, 1)
    assert (r.answered, r.partial, r.abstained, r.abstention_rate, r.adopted) == (1, 1, 2, 0.5, False)
    app = an.app_summary(told.join(verdicts, "query_id").withColumnRenamed("cites_expected", "page_grounded")).first()
    assert (app.covered, app.page_grounded, app.false_abstentions, app.right_abstentions, app.fabricated, app.mean_seconds) == (1, 1, 1, 1, 1, 4.0)
    assert an.claims_report(told.limit(0), verdicts, claims).first().adopted is False


def test_a_corpus_that_lacks_articles_is_refused(spark):
    import pytest

    from daftar.operators import answers as an

    rows = spark.createDataFrame([(1, [7, 9, 9]), (2, None)], "k int, retrieved array<int>")
    numbers = spark.createDataFrame([(7,)], "n int")
    assert [tuple(r) for r in an.missing_articles(rows, "k", "retrieved", numbers, "n").collect()] == [(1, 9)]
    with pytest.raises(ValueError, match="1: 9"):
        an.require_articles(rows, "k", "retrieved", numbers, "n")
    an.require_articles(rows.where("k = 2"), "k", "retrieved", numbers, "n")
