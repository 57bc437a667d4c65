"""Small tables with the awkward cases, and brute-force versions."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(n=80, seed=3):
    """Rows with nulls, empty, short, long, tied, repeated and nearly equal texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base, passage = prose(90), prose(30)
    texts = [None, "", " \n\t", "one", "one", "one two", "a " * 25, "x y z " * 30, prose(6000)]
    for i in range(n - len(texts)):
        k = i % 6
        if k == 0:
            texts.append(base)
        elif k == 1:
            w = base.split()
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif k == 2:
            texts.append(f"{prose(20)} {passage}\n{prose(15)}")
        elif k == 3:
            texts.append(base.upper() if i % 4 else prose(70))
        else:
            texts.append(prose(rng.randrange(1, 120)) + rng.choice([" $$$ ###", "", " é ü"]))
    langs, sources = ["en", "de", None], ["s1", "s1", "s2", None]
    return [(i, t, langs[i % 3], sources[i % 4], None if i % 5 == 0 else len(t or ""), "e") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, tmp_path, **tables):
    """A folder of tables as the queries read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
