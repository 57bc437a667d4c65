"""Prose and lists of an answer against a fold over its lines."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillon.functions import text as T

KEPT = re.compile(r"(?:[-*+]\s|\d+[.)]\s|#{1,6}\s|>|\|)")


def reflow(text):
    groups: list[tuple[bool, list[str]]] = []
    fresh = True
    for raw in (text or "").strip().splitlines():
        line, bare = raw.rstrip(), raw.strip()
        if not bare:
            fresh = True
            continue
        fixed = bool(KEPT.match(bare))
        same = bool(groups) and not fresh
        if fixed and same and groups[-1][0]:
            groups[-1][1].append(line)
        elif not fixed and same and groups[-1][0]:
            groups[-1][1][-1] += f" {bare}"  # goes on with the item above
        elif not fixed and same:
            groups[-1][1].append(bare)
        else:
            groups.append((fixed, [line if fixed else bare]))
        fresh = False
    return "\n\n".join(("\n" if fixed else " ").join(lines) for fixed, lines in groups)


def test_blocks_against_a_fold(spark):
    rng = random.Random(9)
    parts = ["a", "слово и", "- b", "* ", "1) c", "12.", "12. d", "# h", "####### no", "> q", "| t | u |", "  - in", " deep ", "", " ", "\t", "\u00a0x", "-", "٣. e"]
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\n\n", "\u2028", "\x1c", "\x0b"]
    texts = ["".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randrange(12))) for _ in range(600)] + [None, "", " \n ", "x" * 50_000, "a\n" * 20_000, "- a\n\n" * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.prose_markdown(F.col("text")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.t == reflow(texts[r.id]), repr((texts[r.id] or "")[:200])
