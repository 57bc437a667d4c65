"""Structure of acts against a plain fold, and chunks with a bound."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import ingest as D

ACT = """ПРИЛОЖЕНИЕ № 2
ЧАСТЬ II
РАЗДЕЛ III
Глава 2. Общие
Общие положения
1. Первый пункт.
продолжение пункта
2. Второй пункт:
а) подпункт.
Особые случаи
3. Третий пункт.
Показатель | Норма
4. строка | 90
Не заголовок

IV. Другой раздел
5. Пятый пункт"""


def fold(text):
    """The rules, line by line."""
    lines = [(k, x.strip(" \t\n\r\f\x0b")) for k, x in enumerate((text or "").split("\n"))]
    lines = [(k, x) for k, x in lines if x]
    cells = [bool(re.search(r"\t|\|| {3,}", x)) for _, x in lines]
    rules = {"appendix": r"(?i)приложение\s*(№?\s*[0-9]*)", "part": r"(?i)часть\s+([IVXLC]+)\b", "section": r"(?i)(?:раздел\s+)?([IVXLC]+)(?:\.|$)", "chapter": r"(?i)глава\s+([0-9]+)", "paragraph": r"([0-9]{1,3})\.\s", "subparagraph": r"([а-яa-z]|[0-9]{1,2})\)\s"}
    base = [next((n for n in D.LEVELS if n in rules and re.match(rules[n], x)), None) for _, x in lines]
    state, out = dict.fromkeys(D.LEVELS, ""), []
    for k, (no, x) in enumerate(lines):
        table = cells[k] and (k > 0 and cells[k - 1] or k + 1 < len(lines) and cells[k + 1])
        level = None if table else base[k]
        if not table and base[k] is None and not cells[k] and len(x) <= 120 and x[0].isupper() and (len(x) == 1 or x[-1] not in ".;:,!?…-"):
            done = k == 0 or x and lines[k - 1][1][-1] in ".;:!?…" or base[k - 1] in ("appendix", "part", "section", "chapter")
            if done and k + 1 < len(lines) and base[k + 1] == "paragraph" and not cells[k + 1]:
                level = "subsection"
        if level:
            state[level] = x if level == "subsection" else re.match(rules[level], x)[1].strip()
            for lower in D.LEVELS[D.LEVELS.index(level) + 1 :]:
                state[lower] = ""
        out.append((no, level and D.LEVELS.index(level), bool(table), *state.values()))
    return out


def acts():
    rng = random.Random(5)
    kinds = ["ПРИЛОЖЕНИЕ № 7", "приложение", "Часть IV", "часть", "РАЗДЕЛ II", "V. Имя", "X", "Глава 3", "ГЛАВА 12. Имя", "Общие положения", "Срок", "не имя", "1. Пункт.", "2. Пункт,", "33.нет", "б) под;", "7) под", "a | b", "1. a\tb", "один   два", "", "  ", "конец.", "Ещё:"]
    return [ACT, "", None, "\n\n", "Один заголовок", *("\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 25))) for _ in range(150))]


def test_structure_against_a_fold(spark):
    texts = acts()
    got: dict = {}
    for r in D.structured(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")).orderBy("document_id", "line_no").collect():
        got.setdefault(r.document_id, []).append((r.line_no, r.level, r.is_table, *(r[n] for n in D.LEVELS)))
    for k, text in enumerate(texts):
        assert got.get(k, []) == fold(text), text
    sub = {r[0]: r[3 + D.LEVELS.index("subsection")] for r in got[0]}
    assert sub[5] == sub[8] == "Общие положения" and sub[10] == sub[13] == "Особые случаи" and sub[15] == ""


def test_units(spark):
    rows = D.merged(D.structured(spark.createDataFrame([(1, ACT)], "document_id int, text string"))).orderBy("unit").collect()
    assert [r.text for r in rows if r.is_table] == ["Показатель | Норма\n4. строка | 90"]
    assert "1. Первый пункт. продолжение пункта" in [r.text for r in rows] and "Не заголовок" in [r.text for r in rows]
    assert [r.text for r in rows if r.heading_only] == ["ПРИЛОЖЕНИЕ № 2", "ЧАСТЬ II", "РАЗДЕЛ III", "Глава 2. Общие", "Общие положения", "Особые случаи", "IV. Другой раздел"]


TEXTS = ["", "a", "x" * 9000, "слово " * 2000, "Одно. " * 3000, "a, " * 4000, "Длинное предложение, " * 300 + ". Конец", "." * 5000, "\n".join(["строка | 1"] * 700), "а" * 2601 + ". " + "б" * 2600, " ".join(f"Предложение номер {i}, с запятой." for i in range(900))]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("target", "most", "overlap"), [(1600, 2600, 200), (50, 60, 20), (10, 10, 0)])
def test_parts_are_bounded_and_whole(text, target, most, overlap):
    parts = D.cut_text(text, target, most, overlap)
    assert all(0 < len(p) <= most for p in parts)
    at = 0
    for begin, own, end in D.cut_spans(text, target, most, overlap):
        assert begin <= own < end and own - begin <= overlap + 2 and not text[at:own].strip()
        at = end
    assert not text[at:].strip()


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))]
        costs = [rng.choice([0.0, 0.5, 2.0]) for _ in sizes]
        worth = lambda i, j: abs(10 - sum(sizes[i:j])) / 10 * (0.25 if j == len(sizes) and sum(sizes[i:j]) < 10 else 1.0) + (costs[i] if i else 0.0)  # noqa: B023, E731
        best = min(sum(worth(a, b) for a, b in zip([0, *e[:-1]], e, strict=True)) for e in ends_of(len(sizes)) if all(sum(sizes[a:b]) <= 14 for a, b in zip([0, *e[:-1]], e, strict=True)))
        got = D.cheapest(lambda i, j: sum(sizes[i:j]), len(sizes), 10, 14, lambda i: costs[i])  # noqa: B023
        assert sum(worth(a, b) for a, b in zip([0, *got[:-1]], got, strict=True)) == pytest.approx(best)


def ends_of(n):
    return [[k + 1 for k in range(n) if k == n - 1 or mask >> k & 1] for mask in range(1 << (n - 1))]


def test_time_is_linear():
    for unit in ("Одно. ", "слово ", "a,", "я" * 50):
        took = []
        for size in (60_000, 240_000):
            text = unit * (size // len(unit))
            start = time.process_time()
            D.cut_text(text, 1600, 2600, 200)
            took.append(time.process_time() - start)
        assert took[1] < 8 * took[0] + 0.2 and took[1] < 10


def test_chunks_keep_their_bounds(spark):
    rng = random.Random(8)
    texts = [*acts(), "\n".join(f"{k}. " + "слово " * rng.randrange(1, 900) for k in range(1, 30)), "Глава 1\n1. " + "x" * 9000 + "\nГлава 2\n2. один.\nГлава 1\n3. снова.", "\n".join(["a | b"] * 900)]
    rows = D.act_chunks(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string"), 160, 260, 40).orderBy("document_id", "ordinal").collect()
    assert all(0 < r.body_chars <= 260 for r in rows)
    bodies: dict = {}
    for r in rows:
        assert r.ordinal == len(bodies.setdefault(r.document_id, []))
        bodies[r.document_id].append(r.text.split("]\n", 1)[1])
    again = [r for r in rows if r.document_id == len(texts) - 2]
    assert [r.chapter for r in again][-3:] == ["1", "2", "1"] and again[-1].text.endswith("3. снова.")
    assert all(r.is_table for r in rows if r.document_id == len(texts) - 1)
    whole = D.merged(D.structured(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string"))).where("not heading_only")
    for r in whole.select("document_id", F.length("text").alias("n"), "text").collect():
        if r.n <= 260:
            assert any(r.text in b for b in bodies[r.document_id])
