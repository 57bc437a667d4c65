"""What was expected against what was found, by rare words; names in texts, by rare grams."""

from __future__ import annotations

import random
import re

from quillon.functions import inn as N
from quillon.operators import evaluate as V
from quillon.plans import retrieval as P


def test_containment_against_force(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(30)] + ["common", "usual"] * 20
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
    expected = [(k, rng.choice([text(), text(), f"решение № {k % 7} {text()}"])) for k in range(80)] + [(80, None), (81, ""), (82, "абв"), (83, "common"), (83, "common")]
    items = [(k, text(), str(k % 9) if k % 2 else "") for k in range(80)] + [(90, None, None), (91, "common usual", "3"), (91, "common usual", "3")]
    get = lambda t: set(re.findall("[а-яёa-z0-9]{4,}", (t or "").lower()))
    want = set()
    for a, x in expected:
        number = re.search(r"№\s*([0-9]{1,4})", x or "")
        for b, y, n in items:
            if x is not None and (n == number[1] if number else bool(get(x)) and y is not None and 2 * len(get(x) & get(y)) >= len(get(x))):
                want.add((a, b))
    e, i = spark.createDataFrame(expected, "a int, x string"), spark.createDataFrame(items, "b int, y string, number string")
    assert {tuple(r) for r in V.expected_matches(e, i).collect()} == want
    assert V.expected_matches(e.limit(0), i).count() == V.expected_matches(e, i.limit(0)).count() == 0


def test_frequent_words_make_few_pairs(spark):
    """A text with enough rare words meets nobody by its frequent one."""
    rows = [(k, f"common rare{k}a rare{k}b rare{k}c") for k in range(200)]
    e, i = spark.createDataFrame(rows, "a int, x string"), spark.createDataFrame([(k, t, "") for k, t in rows], "b int, y string, number string")
    assert V.candidates(e, i).count() == 200


def test_names_against_force(spark):
    """Names of few letters, so that spellings share grams and lie in each other; awkward rows."""
    rng = random.Random(7)
    part = lambda n: "".join(rng.choice("абв") for _ in range(n))
    known = spark.createDataFrame([(part(rng.randrange(3, 9)),) for _ in range(60)] + [("левотироксин натрия",), ("",), (None,)], "inn string")
    texts = [(k, " ".join(part(rng.randrange(2, 14)) for _ in range(rng.randrange(0, 12)))) for k in range(120)]
    texts += [(None, None), (None, "Левотироксин\n НАТРИЯ"), (500, ""), (501, "абв " * 30_000), (502, texts[0][1]), (502, texts[0][1]), (503, "😀" * 9)]
    spelled = [tuple(r) for r in N.spellings(known).collect()]
    want = []
    for key, text in texts:
        low = " ".join((text or "").lower().replace("ё", "е").split())
        want.append((key, sorted({n for n, s in spelled if s in low})))
    df = spark.createDataFrame(texts, "`a.key` int, text string")
    found = N.detect(df, "a.key", "text", known)
    assert sorted(((r[0], list(r[1])) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(not r.inns for r in N.detect(df, "a.key", "text", known.limit(0)).collect())
    assert N.detect(df.limit(0), "a.key", "text", known).count() == 0


def test_a_spelling_meets_texts_by_its_rarest_gram(spark):
    """A beginning that all texts share makes no pairs."""
    texts = spark.createDataFrame([(str(k), f"бронхо{chr(0x430 + k % 30) * 5}") for k in range(300)], "__text string, __low string")
    spelled = spark.createDataFrame([("a", "бронхобббб"), ("b", "бронхоэюяэ")], "name string, spelling string")
    assert {(int(r[0]) % 30, r[1]) for r in N.candidates(texts, spelled).collect()} == {(1, "бронхобббб")}


def test_grams_of_texts_are_not_shuffled_for_few_spellings(spark):
    """The plan as it is before anything runs: it doesn't hang on which stage ends first."""
    texts = spark.createDataFrame([(k, f"текст {k} бронхобббб") for k in range(20)], "id int, text string")
    plan = N.detect(texts, "id", "text", N.vocabulary(spark))._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_questions_in_texts_against_force(spark, tmp_path):
    """Questions of every length, few words, so that texts nearly hold them; odd spaces and rows."""
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["a", "b", "ab", "", "б\n"]) for _ in range(n))
    texts = [(k, some(rng.randrange(0, 60))) for k in range(150)] + [(None, "a b ab a b"), (200, None), (201, ""), (202, "z " * 20_000 + some(30))]
    asked = [(k, t[s : s + rng.randrange(1, 70)]) for k in range(120) for t in [rng.choice(texts[:150])[1]] for s in [rng.randrange(0, 9)]] + [(300, None), (301, ""), (302, "b"), (302, some(30))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(a, d) for a, x in asked for d, y in texts if x and y and x in y}
    found = P.relevant(spark, str(tmp_path))
    got = {tuple(r) for r in found.collect()}
    assert {r for r in got if r[1] is not None} == {r for r in want if r[1] is not None} and len(want) > 500
    spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert P.relevant(spark, str(tmp_path)).count() == 0


def test_a_text_gives_few_hashes(spark):
    """Far fewer than words, and texts aren't shuffled to be confirmed."""
    df = spark.createDataFrame([(1, " ".join(f"w{k * 7919 % 5003}" for k in range(5000)))], "id long, text string")
    assert df.mapInArrow(P._least(*P.RUNS[0]), "id long, gram long").count() < 0.3 * 5000
