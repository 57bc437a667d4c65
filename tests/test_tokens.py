"""Tokens and chunks by fewer steps, against the plain ways."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.sources.tables import blocks

PARTS = [*"aя5 \n\t\r\f.,-—(İKЁ", "ё", "12", "-\n", "\r\n", " ,5", ".7", "\n12\n", "\n- 3 -\n", "слово", "word", "и", "«", "'", " ", "­", "‐", "​", "　", "﻿", " ", "\u0085", "é", "𝒳", "_", "№ "]


def texts(n):
    pick = random.Random(7)
    return ["", *("".join(pick.choices(PARTS, k=pick.randint(1, 30))) for _ in range(n))]


def test_tokens_are_those_of_the_whole_normalisation(spark):
    found = F.regexp_extract_all(T.normalize_for_search(F.col("t")), F.lit(r"[а-яa-z]+|[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    plain = F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(T.STOP_WORDS))
    rows = spark.createDataFrame([(t,) for t in [*texts(6000), None]], "t string").select("t", T.tokens(F.col("t")).alias("got"), plain.alias("want"))
    assert [r for r in rows.collect() if r.got != r.want] == []


def test_blocks_are_those_of_a_loop(spark):
    """And they need no Python worker, whose memory grew with the rows of a batch."""

    def loop(text, size):
        out, at = [], 0
        for line in text.split("\n"):
            if line := line.strip(" \t\n\r\f\x0b"):
                if out and out[-1][0] == at // size:
                    out[-1][1].append(line)
                else:
                    out.append((at // size, [line]))
                at += len(line) + 1
        return [(b, "\n".join(lines)) for b, lines in out]

    for size in (1, 7, 40):
        rows = spark.createDataFrame([(t,) for t in texts(1500)], "t string").select("t", blocks(F.col("t"), size).alias("b"))
        assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
        assert [r.t for r in rows.collect() if [tuple(x) for x in r.b] != loop(r.t, size)] == []
