"""Archives, codebooks and spelling variants: awkward tables, and brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import archive, codebooks, spelling

# Archives.

PAGES = "page_id long, url string, html string, extra string"
BIG = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60
ROWS = [
    (1, "http://a", BIG, "x"), (9, "http://b c\r\nX: 1", BIG, "x"), (4, None, BIG, "x"), (9, "http://b2", BIG, "x"), (None, "http://n", BIG, "x"),
    (2, "http://s", "short", None), (3, "http://s", "short", None), (5, "u", None, None), (6, "u", "", None), (7, "u", "x" * 1000, None), (8, "u", "x" * 1000, None), (8, "u", "x" * 1000, None), (7, "u", "x" * 999, None),
    (None, "u", "y" * 2000, None), (None, "u", "y" * 2000, None),
]


def test_archive_against_force(spark):
    owner: dict = {}
    for i, _, html, _ in ROWS:
        if i is not None:
            owner[html or ""] = max(owner.get(html or "", i), i)
    want = []
    for i, _, html, _ in ROWS:
        data = (html or "").encode()
        first = owner.get(html or "")
        again = len(data) >= 1000 and first is not None and (i is None or i < first)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    kept = archive.write(spark.createDataFrame(ROWS, PAGES))
    assert kept.payloads.count() == len({h or "" for _, _, h, _ in ROWS})
    got = archive.facts(archive.parsed(archive.records(kept)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_records_byte_for_byte_and_files(spark, tmp_path):
    kept = archive.write(spark.createDataFrame(ROWS, PAGES))
    records = archive.records(kept)
    whole = sorted(r.record for r in records.collect())
    assert len(whole) == len(ROWS) and len({r.record_id for r in archive.parsed(records).collect()}) == len(ROWS)
    for r in archive.parsed(records).where("record_type = 'response'").collect():
        assert hashlib.sha1(r.payload.encode()).hexdigest() == r.sha1 and r.refers_to is None
    assert not any("\r\nX: 1" in w for w in whole) and any("http://b%20c%0D%0AX:%201" in w for w in whole)
    archive.to_files(records, str(tmp_path / "out"), per_file=4)
    assert sorted(r.record for r in archive.from_files(spark, str(tmp_path / "out")).collect()) == whole


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    kept = archive.write(spark.createDataFrame(ROWS, PAGES))
    for broken in (kept.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))), kept.payloads.where("n_bytes < 100")):
        with pytest.raises(Exception, match="payload"):
            archive.records(archive.Archive(kept.headers, broken)).collect()


def test_no_pages(spark):
    kept = archive.write(spark.createDataFrame([], PAGES))
    assert archive.facts(archive.parsed(archive.records(kept))).count() == 0


def test_hot_payloads(spark):
    rows = [(i, "u", "tiny" if i % 2 else "z" * 1200, None) for i in range(4500)]
    got = archive.facts(archive.parsed(archive.records(archive.write(spark.createDataFrame(rows, PAGES)))))
    assert {(r.record_type, r.refers_to, r.n) for r in got.groupBy("record_type", "refers_to").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {("response", None, 2251), ("revisit", 4498, 2249)}


# Codebooks.


def plain_codes(rows, rounds=6):
    """The contract with Python's integers and full search."""
    from fractions import Fraction
    from math import floor

    kept = [(i, label, [floor(Fraction(x) * 4096) for x in v]) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    d = len(kept[0][2])
    cut = [(p * d // 8, (p + 1) * d // 8) for p in range(8)]
    first = [v for _, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:16]]
    books = [[v[a:b] for v in first] for a, b in cut]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    assign = lambda v: [min((far(v[a:b], e), k) for k, e in enumerate(book)) for (a, b), book in zip(cut, books, strict=True)]
    for _ in range(rounds):
        members: dict = {}
        for _, _, v in kept:
            for p, (_, k) in enumerate(assign(v)):
                members.setdefault((p, k), []).append(v[slice(*cut[p])])
        books = [[[sum(c) // len(c) for c in zip(*members[p, k], strict=True)] if (p, k) in members else e for k, e in enumerate(book)] for p, book in enumerate(books)]
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in assign(v)), sum(x for x, _ in assign(v)), label) for i, label, v in kept]
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    most = (1 << 63) - 1
    return [(i, c, min(e, most), min(total[label], most), told) for i, c, e, label in out]


@pytest.mark.parametrize("scale", [1.0, 1e-40, 3e38, 2.0**14, 1e300])
def test_codebooks_against_force(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.3, 16), 2) * scale], int(i) % 3 if i % 4 else None) for i in rng.permutation(90)]
    rows += [(i, rows[0][1], 5) for i in (200, 201)] + [(300, None, 1), (301, [], 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, [float("inf")] * 16, 1), (305, [1.0] * 3, 1)]
    rows += [(None, rows[3][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_codes([r for r in rows if r[0] != 305])
    assert sorted(map(tuple, codebooks.coded(df).collect()), key=repr) == sorted(want, key=repr)


def test_codebooks_small_tables(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert codebooks.coded(spark.createDataFrame([], kind)).count() == 0
    rows = [(k, [float(k), -0.5, 2.0], "a") for k in range(5)]  # fewer vectors than entries, fewer components than parts
    assert sorted(map(tuple, codebooks.coded(spark.createDataFrame(rows, kind)).collect())) == sorted(plain_codes([(i, v, w) for i, v, w in rows]))
    same = [(7, [0.25] * 8, None)] * 40
    assert {r.code for r in codebooks.coded(spark.createDataFrame(same, kind)).collect()} == {"00" * 8}


def test_tree_against_full_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 16, 40):
        for spread in (2, 5, 1000):  # small spreads tie often
            entries = rng.integers(-spread, spread, (n, 4)).tolist()
            parts = rng.integers(-spread, spread, (300, 4))
            far = ((parts[:, None] - np.array(entries)[None]) ** 2).sum(axis=2)
            index, best = codebooks.Tree(entries, codebooks.narrow(4)).nearest(parts)
            assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_limbs():
    for x in (0, 1, -1, 1 << 40, -(1 << 40), 12345678901234567890123, -98765432109876543210, 1 << 1036):
        assert sum(v << (codebooks.LIMB * k) for k, v in enumerate(codebooks.limbs(x))) == x
        assert all(abs(v) < 1 << 63 for v in codebooks.limbs(x))


# Spelling.


def plain_variants(rows):
    import re

    n: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= 7 and k >= 2})

    def one(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        if abs(len(x) - len(y)) != 1:
            return False
        x, y = sorted((x, y), key=len)
        return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    near = {w: [v for v in n if one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


def spelled(seed=2):
    rng = random.Random(seed)
    stems = ["internation", "abcdefgh", "aaaaaaaa", "überraschung", "zzzzzzz"]
    words = []
    for stem in stems:
        for k in range(90):
            w = list(stem)
            for _ in range(rng.randrange(0, 3)):
                at, letter = rng.randrange(len(w)), rng.choice("abxyzéÀ×")
                w[at : at + rng.randrange(0, 2)] = [letter] * rng.randrange(0, 2)
            words += ["".join(w)] * rng.choice([1, 2, 2, 3, 21, 30, 400 if k < 2 else 2])
    words += ["aaaaaaa", "aaaaaaaaa", "Aaaaaaaab"] * 3 + ["short", "x" * 3000, "x" * 3001] * 2
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(words[s : s + 40])) for i, s in enumerate(range(0, len(words), 40))]
    return [*rows, (900, None), (901, ""), (None, "internation überraschung Internation"), rows[3], (902, "ß ŒUVRES÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷")]


@pytest.mark.parametrize("block", [2, 6, 48, 10_000])
def test_variants_against_force(spark, block):
    rows = spelled()
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, word string").select("doc_id", "text")
    assert sorted(map(tuple, spelling.variants(df, block=block).collect()), key=repr) == sorted(plain_variants(rows), key=repr)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_blocks_stay_small(spark):
    """A block over the bound is halved until it is small or has one open letter."""
    rows = [(f"prefixed{a}{b}{c}", 2) for a in "abcdefg" for b in "abcdefg" for c in "abcdefg"]
    parts = spelling.blocks(spark.createDataFrame(rows, "word string, n long"), 20)
    assert len(parts) > 1
    for part in parts:
        for r in part.groupBy(*spelling.PLACE).count().collect():
            assert r["count"] <= 20 or r.e - r.a == 1


# Neighbours.


def nearest_by_force(rows, k, every=20):
    """The contract over rows of (id, vector); a query is an id and a vector."""
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in rows if i % every == 0}):
        scored = sorted((-functools.reduce(lambda t, ab: t + ab[0] * ab[1], zip(x, v, strict=True), 0.0), i) for i, x in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize(("scale", "kind"), [(1e-40, "float"), (1e19, "float"), (1e21, "float"), (1e38, "float"), (1e-140, "double"), (1e150, "double"), (1.0, "float")])
def test_nearest_at_any_scale(spark, scale, kind):
    from quillon.llm import ann

    rng = np.random.default_rng(11)
    v = rng.standard_normal((300, 24)) if scale != 1e-40 else np.abs(rng.standard_normal((300, 24)))
    v = v / np.abs(v).max() * scale
    v = v.astype(np.float32).astype(float) if kind == "float" else v
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")
    got, want = sorted(map(tuple, ann.nearest(df, k=10, block=90, queries=7).collect())), nearest_by_force(list(enumerate(v.tolist())), 10)
    assert len(got) == len(want) and len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.98 * len(want)


def test_nearest_of_repeated_ids_and_equal_vectors(spark):
    from quillon.llm import ann

    rng = np.random.default_rng(12)
    v = rng.standard_normal((60, 8)).round(2).tolist()
    rows = list(enumerate(v)) + [(7, v[7])] * 3 + [(8, v[40])] + [(20, v[20])] + [(100 + i, v[3]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.nearest(df, k=12, block=50, queries=2).collect())) == sorted(nearest_by_force(rows, 12))
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(70)], "vec_id long, embedding array<float>")
    got = ann.nearest(same, k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, i) for q in (0, 20, 40, 60) for i in [x for x in range(6) if x != q][:5]]


def test_codes_decide(spark):
    """Few vectors come to be ranked exactly, and those are nearly all that must."""
    from quillon.llm import ann

    v = np.random.default_rng(13).standard_normal((3000, 64)).astype(np.float32)
    rows = ann.keyed(ann.clean(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")))
    asked = range(0, 3000, 20)
    found = {(r.query_id, r.vec_id) for r in ann.candidates(rows, block=700).collect()}
    assert len(found) < 0.2 * 3000 * len(asked)
    score = v[::20].astype(float) @ v.T.astype(float)
    want = {(q, i) for q, s in zip(asked, score, strict=True) for i in [x for x in np.argsort(-s) if x != q][:20]}
    assert len(found & want) >= 0.98 * len(want)


# Stages over columns of any name, and the whole pipeline against its stages.


def test_stages_carry_any_names(spark):
    from pyspark.sql import functions as F

    from quillon.llm import mixing, neardup, packing, pii, sharding, toxicity

    rows = [(k, f"some plain words here number {k % 3} call 555-123-4567", "en", "s", 40, k, "t") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d e` string")
    assert toxicity.filtered(docs, toxicity.Model()).columns == docs.columns and toxicity.filtered(docs, toxicity.Model()).count() == 9
    for stage in (neardup.distinct, pii.masked, mixing.copies_in_order):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() > 0, stage
    assert {r["a.b"] for r in pii.masked(docs).collect()} == set(range(9))
    assert packing.pack(docs.where(F.col("`a.b`") < 5)).select("doc_id").distinct().count() == 5


def test_mixing_is_in_order_and_spreads_null_ids(spark, tmp_path):
    from quillon.llm import mixing

    rows = [(None if k % 2 else k, f"word{k} " * (1 + k % 5), "en", "s") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    at = [r.position for r in mixing.query(spark, str(tmp_path)).collect()]
    known = [x for x in at if x is not None]
    assert known == sorted(known) and at[: len(known)] == known and len(at) == 200
    rows = [(None, f"word{k}", "en", "s") for k in range(100)]
    places = [r.position for r in mixing.mix(spark.createDataFrame(rows, df.schema)).where("taken > 0").collect()]
    assert len(set(places)) > 60


def test_contradicting_labels(spark):
    from quillon.llm import toxicity

    docs = spark.createDataFrame([(k, "vile gruesome words" if k % 2 else "kind words") for k in range(600)], "doc_id long, text string")
    twice = [(k, y) for k in range(600) for y in ((0, 1) if k % 2 else (0, 0))]
    models = [toxicity.train(docs, spark.createDataFrame(order, "doc_id long, toxic int").repartition(n)) for n, order in ((1, twice), (5, twice[::-1]))]
    assert models[0].weights == models[1].weights != {}
