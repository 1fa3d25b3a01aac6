import json

import pytest

from daftar.sources import readers, writers


def test_json_lines_and_missing_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "law-1", "number": 1}\n\n{"id": "law-2"}\n', encoding="utf-8")
    assert [r.id for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.ARTICLE).collect()] == ["law-1", "law-2"]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), readers.ARTICLE).count() == 0


def test_question_scan_keeps_faults(spark, tmp_path):
    good = {"id": "q", "category": "direct", "question": "?", "expected_articles": [], "expected_keywords": [], "answerable": True}
    (tmp_path / "q.jsonl").write_text("// note\n" + json.dumps(good) + "\n\n{broken\n" + json.dumps({"id": "x"}) + "\n", encoding="utf-8")
    rows = readers.questions(spark, str(tmp_path / "q.jsonl")).orderBy("line").collect()
    assert [r.violation is None for r in rows] == [True, False, False]
    assert rows[0].split == "dev" and rows[1].violation == "invalid JSON" and rows[2].violation.startswith("missing category")


def test_recognised_pages(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"p07": ["a", "b"], "8": "c", "_note": "x"}), encoding="utf-8")
    assert {r.page_no: r.text for r in readers.recognised_pages(spark, str(tmp_path / "o.json")).collect()} == {7: "a\nb", 8: "c"}
    (tmp_path / "t.json").write_text(json.dumps({"p1": {"tokens": ["1"], "furniture": []}, "_c": "x"}), encoding="utf-8")
    assert [r.tokens for r in readers.ground_truth(spark, str(tmp_path / "t.json")).collect()] == [["1"]]


def test_folder_scan_and_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo", encoding="utf-8")
    (tmp_path / "source.txt").write_text("x")
    (tmp_path / "b.md").write_text("x")
    rows = readers.uploads(spark, str(tmp_path))
    assert rows.count() == 1
    assert [(r.page, r.text) for r in readers.text_pages(rows, "path").orderBy("page").collect()] == [(1, "one"), (2, "two")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        writers.publish(rows, rows, str(tmp_path / "t"))
    writers.publish(rows, rows.limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    writers.write_result(rows, str(tmp_path / "r.json"), {"run": "a"})
    assert json.loads((tmp_path / "r.json").read_text()) == {"provenance": {"run": "a"}, "result": {"x": 1}}
    vectors = spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>")
    writers.write_vectors(vectors, str(tmp_path / "v"), {"model": "m"})
    assert writers.read_vectors(spark, str(tmp_path / "v"), {"model": "m"}).count() == 1
    assert writers.read_vectors(spark, str(tmp_path / "v"), {"model": "other"}) is None
    assert writers.read_vectors(spark, str(tmp_path / "nothing"), {}) is None


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from daftar import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda name, default=None: default)})()})()

    import pytest

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.cut_lineage(Frame())
