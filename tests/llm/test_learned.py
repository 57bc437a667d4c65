"""Trained operators: held-out accuracy, awkward rows; the queries and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from helpers import corpus, frame, table

import corpus_pipeline
from quillon.llm import language, toxicity
from quillon.llm.queries import ORACLE_SQL, QUERIES


def test_fold():
    assert toxicity.fold("Id10t, ѕtuрid!​ a$$es $$$") == " idiot  stupid  asses     "


def test_matches_and_exceptions():
    model = toxicity.Model({" bad": 2.0, " badger ": 0.5, " evil ": 3.0}, [" bad luck "])
    a = model.automaton()
    assert [(s, w) for s, _, w in toxicity.matches(a, toxicity.fold("badly evil badger"))] == [(0, 2.0), (6, 3.0), (11, 0.5)]
    assert toxicity.matches(a, toxicity.fold("bad luck")) == []


def test_matches_against_force():
    """The automaton's matches are those of a naive search, over random texts."""
    rng = random.Random(12)
    for _ in range(400):
        piece = lambda k: "".join(rng.choice("ab ") for _ in range(k))
        entries = {f" {piece(rng.randrange(1, 5))}".rstrip() + rng.choice(["", " "]): rng.choice([0.5, 1.0, 2.0]) for _ in range(6)}
        entries = {e: w for e, w in entries.items() if e.strip()}
        phrases = [p for p in {f" {piece(4).strip()} {piece(3).strip()} " for _ in range(3)} if p not in entries]
        folded = f" {piece(40)} "
        best = {}
        for start in range(len(folded)):
            for e, w in entries.items():
                if folded.startswith(e, start) and len(e) > best.get(start, (0, 0))[0]:
                    best[start] = (len(e), w)
        spans = [(s, s + len(p) - 1) for p in phrases for s in range(len(folded)) if folded.startswith(p, s)]
        want = [(s, n, w) for s, (n, w) in sorted(best.items()) if not any(a <= s and b >= s + min(n, 2) for a, b in spans)]
        assert sorted(toxicity.matches(toxicity.Model(entries, phrases).automaton(), folded)) == want


def test_decoding_against_force():
    """Loss-weighted decoding chooses the codeword of least weighted loss."""
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 9):
        code = language.codewords(n)
        trust = rng.uniform(0.05, 1, code.shape[1])
        model = language.Model([f"l{k}" for k in range(n)], code, None, trust / trust.sum())
        margins = rng.normal(0, 2, (50, code.shape[1]))
        best, score, close = language.decode(model, margins)
        for m, b, s, c in zip(margins, best, score, close, strict=True):
            loss = [sum(t * np.log1p(np.exp(-x * bit)) for t, x, bit in zip(model.trust, m, word, strict=True)) for word in code]
            low, second = sorted(loss)[:2]
            assert loss[b] == pytest.approx(low) and 0 < s <= 1 and c == ((second - low) / max(loss) < language.CLOSE)


def test_every_language_is_learned(spark):
    """More languages than the sample has rows for: each keeps its least share."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{chr(0x4E00 + i % 30)}{rng.choice('xyz')}" for _ in range(20)), f"l{i % 30:02}", "s", None, None) for i in range(900)]
    model = language.train(frame(spark, rows), rows=60)
    assert len(model.languages) == 30
    got = {r.doc_id: r.lang_pred for r in language.predict(frame(spark, rows), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]] == r[2] for r in held]) > 0.9


def toxic_corpus(n=900):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        y = i % 7 == 0
        if y:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["moron", "mor0n", "idiots", "idіotic", "scum"])
        rows.append((i, " ".join(w), "en", "s", None, None))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None, None, None, None, None), (5001, "", None, None, None, None)]
    y = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), y)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and np.mean([got[i].predicted == t for i, t in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[5000].predicted == 0
    kept = toxicity.filtered(frame(spark, rows), model)
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    none = toxicity.train(frame(spark, rows), y.where("false"))
    assert toxicity.score(frame(spark, rows[:3]), none).agg({"predicted": "max"}).first()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 12])
def test_codewords(n):
    code = language.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
    if n > 3:
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= 3


def test_language(spark):
    rng, rows, letters = random.Random(1), [], {"aa": "abcde ", "bb": "fghij ", "cc": "äöüßk ", "dd": "lmnop "}
    for i in range(600):
        lang = list(letters)[i % 4]
        rows.append((i, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(20, 200))) + "a", lang, "s", None, None))
    rows += [(9000, None, "aa", None, None, None), (9001, "12 !? ²½Ⅷ", "bb", None, None, None), (9002, "fghi jfgh", None, None, None, None)]
    got = {r.doc_id: r for r in language.predict(frame(spark, rows), language.train(frame(spark, rows))).collect()}
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.98 and all(got[r[0]].held_out for r in held)
    assert got[9000].lang_pred == got[9001].lang_pred == "und" and got[9002].lang_pred == "bb"
    assert language.predict(frame(spark, rows[:2]), None).first().lang_pred == "und"
    assert language.train(frame(spark, [])) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(want.columns) == sorted(df.columns)
        order = sorted(df.columns)
        plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
        a = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
        assert a == sorted((tuple(plain(v) for v in r) for r in want[order].itertuples(index=False)), key=repr)


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count()


def test_pipeline_is_stored(spark, sf, monkeypatch):
    """Each stage reads what the one before it has written, and the result is read too."""
    read = []
    stages = [(name, lambda s, docs, d, f=stage: (read.append(docs.inputFiles()), f(s, docs, d))[1]) for name, stage in corpus_pipeline.STAGES[2:]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    out = corpus_pipeline.run(spark, sf)
    names = ["documents", *(name for name, _ in stages)]
    assert all(files and all(f"/{name}" in f and f.endswith(".parquet") for f in files) for name, files in zip(names, [*read, out.inputFiles()], strict=True))
    assert out.count()


def test_pipeline_awkward_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, clashing extra columns."""
    rows = corpus(40)
    extra = frame(spark, rows + rows[:2] + [(None, "no id", None, None, None, None)]).withColumnsRenamed({"extra": "target"}).selectExpr("*", "1 as copies", "'x' as cluster")
    sf = table(spark, tmp_path, labels=spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(30)], "doc_id long, quality int, toxic boolean"))
    docs = extra
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == extra.columns, name
    assert docs.count()


def test_pipeline_empty(spark, tmp_path):
    sf = table(spark, tmp_path, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs = frame(spark, []).drop("extra")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
