"""Tables and indexes that are changed where they are stored."""

from __future__ import annotations

import random

import pytest

from quillon.operators import ranking as R
from quillon.operators.living import LivingIndex
from quillon.sources.stored import StoredRegistry, StoredTable

KIND = "id bigint, name string, tags array<string>"


def rows(table):
    return sorted(((r.id, r.name, tuple(r.tags or ["-"])) for r in table.read().collect()), key=repr)


def batch(spark, data):
    return spark.createDataFrame(data, f"{KIND}, seq int")


def test_upsert_changes_only_what_changes(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), "id", KIND, parts=8)
    assert t.read().count() == 0 and t.delete(spark.createDataFrame([(1,)], "id bigint")) == [] and t.files() == {}
    t.upsert(batch(spark, [(i, f"n{i}", ["a"] if i % 2 else None, 0) for i in range(200)] + [(None, "no key", None, 0)]), "seq")
    before = t.files()
    assert len(before) == 8 and t.read().count() == 200
    change = batch(spark, [(5, "first", None, 1), (5, "last", [], 2), (7, "n7", ["a"], 1), (500, None, ["b", None], 1)])
    touched = t.upsert(change, "seq")
    after = t.files()
    assert {p for p in after if after[p] != before.get(p)} == set(touched) and 1 <= len(touched) <= 2
    assert [(r.id, r.name) for r in t.find(5, 500, 999).orderBy("id").collect()] == [(5, "last"), (500, None)]
    assert t.read().count() == 201
    assert t.upsert(change, "seq") == [] and t.files() == after  # a second run
    moved = t.upsert(batch(spark, [(5, "last", None, 0)]), "seq")  # null is not an empty list
    assert len(moved) == 1 and t.find(5).first().tags is None


def test_deleted_parts_are_gone(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), "id", KIND, parts=4)
    t.upsert(batch(spark, [(i, "x", None, 0) for i in range(40)]), "seq")
    assert len(t.delete(spark.createDataFrame([(i,) for i in range(1, 40)] + [(None,)], "id bigint"))) == 4
    assert rows(t) == [(0, "x", ("-",))] and len(t.files()) == 1
    assert t.delete(spark.createDataFrame([(77,)], "id bigint")) == []


def test_ties_in_a_batch_have_one_winner(spark, tmp_path):
    said = []
    for k, data in enumerate(([(1, "a", None, 1), (1, "b", None, 1)], [(1, "b", None, 1), (1, "a", None, 1)])):
        t = StoredTable(spark, str(tmp_path / f"t{k}"), "id", KIND, parts=2)
        t.upsert(batch(spark, data), "seq")
        said.append(rows(t))
    assert said[0] == said[1] and len(said[0]) == 1


def test_registry_replaces_and_prunes(spark, tmp_path):
    r = StoredRegistry(spark, str(tmp_path / "r"), "document_id bigint, title string", parts=4)
    r.upsert(spark.createDataFrame([(i, f"t{i}", 0) for i in range(30)], "document_id bigint, title string, seq int"), "seq")
    texts = lambda data: spark.createDataFrame(data, "document_id bigint, texts array<string>")
    r.replace_chunks(texts([(i, [f"{i}a", f"{i}b", f"{i}c"]) for i in range(30)] + [(90, ["orphan"])]))
    was = r.chunks.files()
    r.replace_chunks(texts([(3, ["new"]), (4, []), (5, None), (6, ["6a", "6b", "6c"])]))
    got = {}
    for x in r.chunks.read().orderBy("document_id", "ordinal").collect():
        got.setdefault(x.document_id, []).append((x.ordinal, x.text))
    assert got[3] == [(0, "new")] and got[6] == [(0, "6a"), (1, "6b"), (2, "6c")] and 4 not in got and 5 not in got
    assert any(was[p] == files for p, files in r.chunks.files().items())
    keep = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "document_id bigint")
    assert sorted(x.document_id for x in r.prune(keep).collect()) == [*range(1, 30, 2), 90]
    assert {x.document_id for x in r.chunks.read().collect()} == set(range(0, 30, 2)) - {4}
    assert {x.document_id for x in r.documents.read().collect()} == set(range(0, 30, 2))
    assert r.prune(keep).count() == 0


WORDS = ["совет", "решение", "таблетка", "доза", "alpha", "beta", "gamma", "delta", "досье", "45"]


def corpus(rng, ids):
    return [(d, d * 100 + k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))) for d in ids for k in range(rng.randrange(1, 4))]


def same_as_rebuilt(spark, live, state):
    chunks = spark.createDataFrame([c for own in state.values() for c in own], "document_id bigint, key bigint, text string")
    asked = spark.createDataFrame([(1, "решение совета доза"), (2, "alpha beta beta"), (3, "45 досье"), (4, "nothing here"), (5, " ".join(WORDS))], "query int, text string")
    whole = R.bm25_index(chunks.select("key", "text"))
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(live.search(asked, 50)) == plain(R.bm25_search(whole, asked, 50))
    index = live.index()
    for name, cut in (("idf", 9), ("lengths", 9)):
        assert plain(index[name]) == plain(whole[name]), name
    assert plain(index["postings"]) == plain(whole["postings"].select("token", "key", "tf"))
    assert {r.document_id for r in live.documents().collect()} == set(state)


def test_living_index_equals_one_built_anew(spark, tmp_path):
    rng, live, state = random.Random(6), LivingIndex(spark, str(tmp_path / "i"), buckets=4), {}
    frame = lambda data: spark.createDataFrame(data, "document_id bigint, key bigint, text string")
    ids = lambda data: spark.createDataFrame([(i,) for i in data], "document_id bigint")
    steps = [(range(40), []), (range(30, 50), [1, 2, 3, 35, 999]), ([2, 60], [4, 4]), ([], [5, 6])]
    for new, gone in steps:
        data = corpus(rng, new)
        live.refresh(frame(data), ids(gone))
        for d in gone:
            state.pop(d, None)
        for d in new:
            state[d] = [c for c in data if c[0] == d]
        same_as_rebuilt(spark, live, state)
    files = sorted(str(p) for p in (tmp_path / "i").rglob("part-*"))
    assert live.refresh(frame([c for own in state.values() for c in own]), ids([4, 1000])) is None
    assert live.refresh() is None and sorted(str(p) for p in (tmp_path / "i").rglob("part-*")) == files
    other = live.compacted(str(tmp_path / "j"))
    same_as_rebuilt(spark, other, state)
    other.refresh(None, ids([30]))
    state.pop(30)
    same_as_rebuilt(spark, other, state)


def test_a_refresh_that_was_cut_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    frame = lambda data: spark.createDataFrame(data, "document_id bigint, key bigint, text string")
    live, state = LivingIndex(spark, str(tmp_path / "i"), buckets=2), {}
    rng = random.Random(1)
    for new in (range(5), range(3, 8)):
        data = corpus(rng, new)
        state |= {d: [c for c in data if c[0] == d] for d in new}
        with monkeypatch.context() as m:
            write = LivingIndex._write
            m.setattr(LivingIndex, "_write", lambda self, rows, name, *a: write(self, rows.limit(1), name, *a) if name != "changes" else 1 / 0)
            with pytest.raises(ZeroDivisionError):
                live.refresh(frame(data))
        live.refresh(frame(data))
        same_as_rebuilt(spark, live, state)


def test_empty_living_index(spark, tmp_path):
    live = LivingIndex(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "alpha")], "query int, text string")
    assert live.refresh() is None and live.search(asked, 5).count() == 0 and live.documents().count() == 0
    live.refresh(spark.createDataFrame([(None, 1, "alpha"), (1, None, "alpha")], "document_id bigint, key bigint, text string"))
    assert live.documents().count() == 0


def test_unusable_vectors_are_not_ranked(spark):
    kind = "array<double>"
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, None), (6, [0.6, 0.8]), (7, [0.6, 0.8])], f"key bigint, embedding {kind}")
    queries = points.withColumnRenamed("key", "query")
    got = sorted(map(tuple, R.dense_search(points, queries, 2).collect()))
    assert got == [(1, 1, 1.0, 1), (1, 6, 0.6, 2), (6, 6, 1.0, 1), (6, 7, 1.0, 2), (7, 6, 1.0, 1), (7, 7, 1.0, 2)]


def test_a_living_index_stores_no_row_for_a_token_of_a_chunk(spark, tmp_path):
    """Blocks of inverted lists are all it has; what changes is places in them."""
    frame = lambda data: spark.createDataFrame(data, "document_id bigint, key bigint, text string")
    live, many = LivingIndex(spark, str(tmp_path / "i")), " ".join(f"word{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26))
    live.refresh(frame([(d, d, many) for d in range(50)]))
    live.refresh(frame([(d, d, "alpha") for d in range(10)]), spark.createDataFrame([(49,)], "document_id bigint"))
    asked = spark.createDataFrame([(1, "wordab wordac alpha")], "query int, text string")
    assert {r.key for r in live.search(asked, 100).collect()} == set(range(10))
    assert not (tmp_path / "i" / "postings").exists() and not (tmp_path / "i" / "forward").exists()
    assert live._chunks([1, 2]).count() == 60
