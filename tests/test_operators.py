"""Cases that tables don't hold: Cyrillic, errors, folds, files, streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import inn as N
from quillon.functions import text as T
from quillon.operators import embedding as E
from quillon.operators import grounding as G
from quillon.operators import ingest as D
from quillon.operators import ranking as R
from quillon.operators import registry as S
from quillon.sources import files
from quillon.streaming import incremental


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "wanted"),
    [(None, ""), ("", ""), ("пере-\nнос", "перенос"), ("a  b\t\tc", "a b c"), ("- 12 -\nтекст ( а ) , б", "текст (а), б"), ("a\r\n\r\n\r\n\r\nb", "a\n\nb"), ("й", "й"), ("x​y z", "xy z")],
)
def test_normalize(spark, text, wanted):
    assert one(spark, T.normalize_text(F.col("t"), compose=True), t=text) == wanted


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="AUC(0-t): ещё 90,5 % и «Тест» é") == ["auc", "90,5", "тест"]


def test_unknown_count_column(spark, sf):
    with pytest.raises(ValueError):
        S.counts_by(spark.range(1), "text")


def test_channels_need_one():
    with pytest.raises(ValueError):
        R.channels(None, None, 5)


def test_markdown(spark):
    text = "Первая строка.\nВторая строка.\n\n\n- a\nпродолжение\n- b\n# H\nтекст"
    assert one(spark, T.prose_markdown(F.col("t")), t=text) == "Первая строка. Вторая строка.\n\n- a продолжение\n- b\n# H текст"
    assert one(spark, T.prose_markdown(F.col("t")), t=None) == ""


def test_json_object(spark):
    get = lambda t: one(spark, T.json_object(F.col("t")).cast("string"), t=t)
    assert json.loads(get('```json\n{"a": 1}\n```')) == {"a": 1}
    assert json.loads(get('so: {"a": [1, "x"]} end')) == {"a": [1, "x"]}
    assert get("none") is None and get("") is None and get(None) is None


def test_references(spark):
    r = T.keep_known_references(F.col("t"), F.array(F.lit(1), F.lit(3)))
    assert one(spark, r, t="a [1, 7] b [9] c [3]") == "a [1] b  c [3]"


def test_act_numbers(spark):
    assert one(spark, T.act_numbers(F.col("t")), t="Решение Совета ЕЭК № 85 и рекомендации № 7, пункт № 9") == ["7", "85"]


def test_transliteration(spark):
    """Spellings are read from the left, the longer one first; endings go before."""
    latin = {"ibuprofen": "ибупрофен", "ckhx": "кхкс", "Schya": "щя", "omeprazolum": "омепразол", "aspirin": "аспирин", "torsemide": "торсемид", "warfarin": "варфарин", "ph-th y": "ф-т и"}
    cyrillic = {"ибупрофен": "ibuprofen", "Щётка": "schetka", "циклоспорин": "ciklosporin", "хлорид натрия": "khlorid natriya", "юла": "yula"}
    for pairs, way in ((latin, N.to_cyrillic), (cyrillic, N.to_latin)):
        rows = spark.createDataFrame(list(pairs.items()), "given string, want string").select("want", way(F.col("given")).alias("got")).collect()
        assert all(r.want == r.got for r in rows)


def test_quoted_names(spark):
    titles = {"О выборе с МНН «Эстриол» и «леводопа + карбидопа»": ["карбидопа", "леводопа", "эстриол"], "«о выборе препарата»": [], "": []}
    rows = spark.createDataFrame([(t,) for t in titles], "title string").select("title", N.from_title(F.col("title")).alias("names")).collect()
    assert all(r.names == titles[r.title] for r in rows)


def test_blocks(spark):
    """Lines are packed by where they begin, whatever the text's length and spaces."""
    from quillon.sources.tables import blocks

    text = "\n".join([" ab ", "", "c" * 25, "\x0bd\t", "e"])
    got = spark.createDataFrame([(text,), ("",), (" \n",)], "t string").select(blocks(F.col("t"), 10).alias("b")).collect()
    assert [(b.block, b.text) for b in got[0].b] == [(0, "ab\n" + "c" * 25), (2, "d"), (3, "e")] and got[1].b == got[2].b == []


def test_relevant_short_questions(spark, tmp_path):
    """Questions of any length, also inside words, are found where they stand."""
    from quillon.plans import retrieval as P

    texts = ["xone two three four five sixy", "one two", "a one  two b", "tone", "one two three"]
    asked = ["one two three four five six", "one two", "one", "one  two", "two three", "one two three", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in P.relevant(spark, str(tmp_path)).collect())
    assert got == sorted((i, d) for i, a in enumerate(asked) for d, t in enumerate(texts) if a and a in t)


def test_tier_policy_against_fold(spark):
    rng = random.Random(1)
    data, wanted = [], {}
    for q in range(40):
        tiers = [f"TIER_{rng.choice([1, 2, 3, 3, 4, 4, 4, 5, 5])}" if q % 3 else f"TIER_{rng.choice([3, 4, 5])}" for _ in range(rng.randrange(0, 30))]
        if q % 3 == 0:
            tiers += ["TIER_1"] * (q % 4)
        data += [(q, i + 1, t) for i, t in enumerate(tiers)]
        wanted[q] = R.tier_policy_fold([(t, i + 1) for i, t in enumerate(tiers)], 8)
    rows = spark.createDataFrame(data, "request int, rank int, source_tier string").withColumn("id", F.col("rank"))
    got = {}
    for r in R.tier_policy(rows, 8).orderBy("request", "rank").collect():
        got.setdefault(r.request, []).append(r.id)
    assert got == {q: w for q, w in wanted.items() if w}


def test_files(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("﻿question_id;category;question;expected_documents;expected_topics;expected_answer_notes;needs_expert_validation\n1;c;вопрос;а | б||;;;false\n", encoding="utf-8")
    r = files.load_questions(spark, str(path)).first()
    assert (r.question_id, r.expected_documents, r.expected_topics, r.needs_expert_validation) == ("1", ["а", "б"], [], False)
    assert files.load_vocabulary(spark, str(tmp_path / "none.json")).count() == 0
    files.save_vocabulary(N.vocabulary(spark, ["эстриол"]), str(tmp_path / "v"))
    assert files.load_vocabulary(spark, str(tmp_path / "v")).count() == len(N.ALIASES) + 1
    assert files.load_index(spark, str(tmp_path / "ix"), "a") is None
    files.save_index(str(tmp_path / "ix"), a=spark.range(3))
    assert files.load_index(spark, str(tmp_path / "ix"), "a")["a"].count() == 3
    files.write_report(spark.range(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x.pdf").write_bytes(b"1")
    docs = spark.createDataFrame([("x.pdf",), ("y.pdf",)], "f string")
    assert [r.f for r in files.missing_files(docs, "f", [str(tmp_path / "raw")]).collect()] == ["y.pdf"]
    (tmp_path / "s.yaml").write_text("sources:\n  - id: one\n    discovery: list\n    url: https://a.example\n  - id: two\n    enabled: false\n")
    assert [(r.source_id, r.enabled) for r in files.load_source_list(spark, str(tmp_path / "s.yaml")).collect()] == [("one", True), ("two", False)]
    (tmp_path / "c.json").write_text('[{"id": 1, "name": "a"}]')
    assert files.load_cases(spark, str(tmp_path / "c.json"), "id int, name string").first().name == "a"


def test_embedder(spark):
    assert E.prefixed("multilingual-e5-base", "t", True) == "query: t" and E.prefixed("other", "t", True) == "t"
    with pytest.raises(E.NotConfigured):
        E.provider("absent")
    r = E.embed(spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string"), "id", "t", "hashing", 8).orderBy("id").collect()
    assert len(r[0].embedding) == 8 and sum(x * x for x in r[0].embedding) == pytest.approx(1, abs=1e-6)


def test_long_unit_is_split(spark):
    text = " ".join(f"Предложение номер {i}." for i in range(60))
    parts = one(spark, D.split_long(F.col("t"), 200, 300, 40), t=text)
    assert all(len(p) <= 260 for p in parts) and len(parts) > 5 and parts[1].split(". ")[0] + "." in parts[0]


def test_incremental(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "слово тест"), (2, "другое слово")], "document_id long, text string").write.parquet(src)
    known = spark.createDataFrame([], "document_id long, sha256 string")
    stream = spark.readStream.schema("document_id long, text string").parquet(src)
    incremental.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda: known).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_card_list(spark):
    rows = [(1, 2, "b", "", "https://p"), (1, 1, "a", "https://u", "https://p"), (1, 3, None, None, None), (2, 1, "c", None, "")]
    cards = spark.createDataFrame(rows, "request int, rank int, title string, url string, page_url string")
    got = {r.request: r.markdown for r in G.card_list(cards).collect()}
    assert got == {1: G.CARD_LIST + "- [a](https://u)\n- [b](https://p)\n- ", 2: G.CARD_LIST + "- c"} and G.card_list(cards.limit(0)).count() == 0
