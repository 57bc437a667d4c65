"""Spelling variants: words one edit apart, each pointing to its far more frequent form.

Words are maximal runs of letters of at least ``LEAST`` code points, A-Z lower-cased,
one code point deleted where the contract's checksum says so, that occur at
least twice. Two words are near if one inserted, deleted or replaced code point
parts them. A word's form is its near word with the largest count, if that is at
least ``FACTOR`` times its own; its root is where its forms end.

One edit leaves one half of the shorter word whole. With m letters in it and h =
m // 2, the two words share their first h letters, or their last m - h: they
stand together in a block of the dictionary sorted forwards, or of the one
sorted by reversed words. A word of L letters stands in the blocks of m = L
(pairs of L and L, L and L + 1) and of m = L - 1. Blocks lie whole in a range
partition and are scanned in order.

A block of more than ``BLOCK`` words is subdivided before it is dealt out. The
edit of a block's pairs lies in some letters [a, e) of the shorter word; the
words share what is before and after. That range is halved, and each half is a
block of its own: those that also share the first half, and those that also
share the second. This ends at one letter, where a block has at most an
alphabet of words of m letters, and of m + 1 letters an alphabet squared, which
are looked up by letter. So no block is ever larger than that, and blocks of a
few words are verified pair by pair. A pair is counted in one block: in a
second half only if it doesn't share the first half.

A block tells each word how many near words it has there and which is the most
frequent; no pairs are sent. Sums over a word's blocks give the result. Forms
rise by ``FACTOR``, so a chain has at most log(n) links; roots follow it by
doubling.

Null text: no words. Null doc_id: nothing is deleted. Repeated rows count as
often as they stand there. Equal counts: the smaller word in code-point order.
An empty table, or one without such words, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, meet

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, TWICE, FACTOR, EVERY, BLOCK = 7, 2, 10, 31, 48
#: A block: letters of the shorter word, range of the edit, bound of the shared beginning, the shared letters.
PLACE = ["m", "a", "e", "below", "head", "tail"]
NO_BOUND = 1 << 30


def words(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """docs(doc_id, text) -> word, n: words of at least ``least`` letters."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))).alias("w"))
    h = F.coalesce(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("w")).cast("binary")), F.lit(1))
    at = (h % F.length("w")).cast("int")
    kept = F.when(h % every == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    return found.select(kept.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _placed(rows: DataFrame, m: F.Column, a: F.Column, e: F.Column, below: F.Column) -> DataFrame:
    """word, n in the block whose pairs share ``a`` letters and, from the end, ``m - e``."""
    size = F.length("word")
    after = (m - e).cast("int")
    tail = F.reverse(F.substring("word", size - after + 1, after))  # reversed: the order of the backward dictionary
    return rows.select(m.cast("int").alias("m"), a.cast("int").alias("a"), e.cast("int").alias("e"), below.cast("int").alias("below"), F.substring("word", F.lit(1), a.cast("int")).alias("head"), tail.alias("tail"), "word", "n")


def _halves(rows: DataFrame) -> DataFrame:
    """The blocks [a, e) of ``rows`` cut in two: the edit is behind the shared first half, or in it."""
    middle = F.col("a") + F.floor((F.col("e") - F.col("a")) / 2)
    both = F.explode(F.array(F.struct(middle.alias("a"), F.col("e").alias("e"), F.col("below").alias("below")), F.struct(F.col("a").alias("a"), middle.alias("e"), middle.alias("below"))))
    cuts = rows.select("word", "n", "m", both.alias("c"))
    return _placed(cuts, F.col("m"), F.col("c.a"), F.col("c.e"), F.col("c.below"))


def blocks(counted: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """Rows of small blocks, a frame for each level of subdivision."""
    size = F.length("word")
    every = counted.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).withColumns({"a": F.lit(0), "e": F.col("m"), "below": F.lit(NO_BOUND)})
    rows, done = _halves(every), []
    while True:
        key = F.xxhash64(*PLACE).alias("k")
        rows = cut(rows.select("*", key))
        sizes = rows.groupBy("k", *PLACE).agg(F.count(F.lit(1)).alias("n"))
        big = cut(sizes.where((F.col("n") > block) & (F.col("e") - F.col("a") > 1)).groupBy("k").agg(F.sum("n").alias("n")))
        if big.isEmpty():
            return [*done, rows.drop("k")]
        told = cut(meet(rows, big.select("k", F.lit(True).alias("big")), big, "k", "left").withColumn("big", F.col("big").isNotNull() & (F.col("e") - F.col("a") > 1)))
        done.append(told.where("not big").drop("k", "big"))
        rows = _halves(told.where("big").drop("k", "big"))


def near(x: str, y: str) -> bool:
    """Whether exactly one edit parts two different words."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    p = 0
    while p < len(x) and x[p] == y[p]:
        p += 1
    return x[p + (len(x) == len(y)) :] == y[p + 1 :]


def shared(x: str, y: str, most: int) -> int:
    """Length of the common beginning, up to ``most``."""
    p, most = 0, min(len(x), len(y), most)
    while p < most and x[p] == y[p]:
        p += 1
    return p


class Told(dict):
    """word -> [near words, largest count, its word] of one block."""

    def add(self, word: str, other: str, n: int) -> None:
        held = self.get(word)
        if held is None:
            self[word] = [1, n, other]
            return
        held[0] += 1
        if n > held[1] or n == held[1] and other < held[2]:
            held[1:] = n, other


def verified(m: int, a: int, e: int, below: int, members: list[tuple[str, int]]) -> Told:
    """Near words of one block."""
    told = Told()
    short, long = [x for x in members if len(x[0]) == m], [x for x in members if len(x[0]) == m + 1]
    if e - a > 1:
        for i, (x, n) in enumerate(short):
            for y, k in [*short[i + 1 :], *long]:
                if near(x, y) and (below == NO_BOUND or shared(x, y, below) < below):
                    told.add(x, y, k)
                    told.add(y, x, n)
        return told
    # one letter is open: words of m letters differ there and nowhere else
    at = {x[a]: (x, n) for x, n in short}
    best = sorted(short, key=lambda x: (-x[1], x[0]))[:2]
    for x, _ in short if len(short) > 1 else []:
        y, k = best[1] if best[0][0] == x else best[0]
        told[x] = [len(short) - 1, k, y]
    for y, k in long:  # two letters, one of which goes
        for letter in {y[a], y[a + 1]}:
            if letter in at:
                x, n = at[letter]
                if below == NO_BOUND or shared(x, y, below) < below:
                    told.add(x, y, k)
                    told.add(y, x, n)
    return told


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of a sorted partition, one after the other."""
    place, members, out = None, [], []

    def end() -> None:
        if len(members) > 1:
            out.extend((w, *t) for w, t in verified(*place[:4], members).items())

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row[:6] != place:
                end()
                place, members = row[:6], []
            members.append((row[6], row[7]))
        yield pd.DataFrame(out, columns=["word", "n_near", "best", "other"])
        out = []
    end()
    yield pd.DataFrame(out, columns=["word", "n_near", "best", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the last of the chain of forms."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, factor: int = FACTOR, twice: int = TWICE, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> word, form, root, n, n_near, form_n."""
    counted = cut(words(docs).where(F.col("n") >= twice))
    found = None
    for part in blocks(counted, block):
        ranged = part.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE, "word")
        told = ranged.mapInPandas(scan, "word string, n_near long, best long, other string")
        found = told if found is None else found.unionByName(told)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best")).alias("best"), "other")).alias("top"))
    rows = counted.join(best, "word", "left").withColumn("form_n", -F.col("top.best"))
    takes = F.col("form_n") >= factor * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("top.other")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir).select("doc_id", "text"))


#: A checksum's steps: eight shifts of a byte give its table, the bytes of a word its sum.
_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"
SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{7,}}')), '{UPPER}', '{LOWER}') AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, w, count(*) AS k, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b FROM t GROUP BY ALL),
c AS MATERIALIZED (SELECT {_TABLE} AS t),
h AS (SELECT w, k, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(b, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) END AS h FROM d, c),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM h),
n AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY ALL HAVING sum(k) >= 2),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
e AS (SELECT a.word AS x, b.word AS y FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word UNION SELECT g.word, n.word FROM g JOIN n ON g.rest = n.word UNION SELECT n.word, g.word FROM g JOIN n ON g.rest = n.word),
f AS MATERIALIZED (SELECT x AS word, count(*) AS n_near, arg_min(y, {{'k': -n.n, 'w': encode(y)}}) AS other, max(n.n) AS form_n FROM e JOIN n ON e.y = n.word GROUP BY ALL),
r AS MATERIALIZED (SELECT n.word, n.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n.n THEN other END AS form, CASE WHEN form_n >= 10 * n.n THEN form_n END AS form_n FROM n LEFT JOIN f USING (word)),
u AS (SELECT word, word AS root, form AS next FROM r UNION ALL SELECT u.word, u.next, r.form FROM u JOIN r ON u.next = r.word)
SELECT r.word, r.form, u.root, r.n, r.n_near, r.form_n FROM r JOIN u ON u.word = r.word AND u.next IS NULL
"""
