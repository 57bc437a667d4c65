"""Files as users write them."""

from __future__ import annotations

from quillon.sources import files


def test_source_lists(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# list\nsources:\n  - id: 'one'  # first\n    discovery: list\n    topics:\n      - x y\n      - http://b.example\n    url: \"https://a.example/#top\"\n    discovery: rss\n\n  - enabled: false\n    source_id: two\n", encoding="utf-8")
    (tmp_path / "b.yaml").write_text("", encoding="utf-8")
    (tmp_path / "c.yaml").write_text("- id: three\r\n  enabled: true\r\n", encoding="utf-8")
    got = sorted(tuple(r) for r in files.load_source_list(spark, str(tmp_path)).collect())
    assert got == [("one", True, "rss", "https://a.example/#top"), ("three", True, "", ""), ("two", False, "", "")]


def test_question_lists(spark, tmp_path):
    head = "﻿question_id;question;expected_documents\n"
    (tmp_path / "q.csv").write_text(head + '1;"он сказал ""да""; и\nушёл";"a|b | "\n2;;\n', encoding="utf-8")
    got = [(r.question_id, r.question, r.expected_documents, r.needs_expert_validation) for r in files.load_questions(spark, str(tmp_path)).orderBy("question_id").collect()]
    assert got == [("1", 'он сказал "да"; и\nушёл', ["a", "b"], True), ("2", None, [], True)]


def test_missing_files(spark, tmp_path):
    (tmp_path / "raw=a").mkdir()
    (tmp_path / "raw=a" / "x.txt").write_text("1")
    docs = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("", 4)], "f string, id int")
    assert {r.id for r in files.missing_files(docs, "f", [str(tmp_path)], "raw=([^/]+)/[^/]+$").collect()} == {2, 3, 4}
    assert {r.id for r in files.missing_files(docs.limit(0), "f", [str(tmp_path)]).collect()} == set()
