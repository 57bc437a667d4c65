"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Folding: lower case, look-alike letters of other scripts and digits that stand
for letters become Latin letters, punctuation and white space become spaces;
every entry begins at the start of a word.

Lexicon: words and word beginnings of the labelled training texts with their
log odds of standing in a toxic text, by document counts, smoothed and lowered
by their standard error.  A longer
entry goes if a shorter one says nearly the same.  Exception phrases are the
words, and the pairs of words, around an entry that occur in training texts
labelled clean and hardly in toxic ones: a match inside one doesn't count.

Score: of the matches at a word's start the longest counts.  The sum of the
distinct entries' weights is divided by a slowly growing function of the
text's length; a logistic function of that, of the strongest entry and of the
share of matching words is the score.  It is fitted on training texts which
the lexicon was not learned from.

Learning takes rows of ``labels`` with ``crc32(doc_id) mod 5 <> 0``, of these at
most ``TRAIN_ROWS`` by a hash of the id, and keeps at most ``ENTRIES`` entries and
as many exception phrases, which bounds the model; all documents are scored, over whole texts, in one pass without a shuffle.

Null or empty text: the score of no match.  No labels, or only clean ones: score 0;
only toxic ones: score 1.  Rows of labels without id or label are not used; of
contradicting labels of one id toxic counts.  Null or repeated doc_id: rows stay (``held_out``
is false for null).  Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fold_of, frugal, mapped, table

TRAIN_ROWS, ENTRIES, LEAST_DOCS, LEAST_ODDS = 20_000, 4_000, 4, 2.0
BEGINNINGS = (4, 5, 6, 7, 8, 10)
#: Standard errors by which a weight is lowered.
ERRORS = 1.5
FOLDS, HELD_OUT = 5, 0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Look-alikes, and digits and signs used as letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a",
}


def _table() -> dict[int, str]:
    fold = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for code in range(128):
        if not chr(code).isalnum() and chr(code) not in LOOK_ALIKES:
            fold[code] = " "
    fold |= {code: chr(code - 0xFF21 + 97) for code in range(0xFF21, 0xFF3B)} | {code: chr(code - 0xFF41 + 97) for code in range(0xFF41, 0xFF5B)}
    return fold | {code: None for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


FOLD = _table()
#: A whole run of signs before a letter; no run is tried twice.
SIGN_IN_WORD = re.compile(r"(?<!\$)\$++(?=\w)")


def fold(text: str | None) -> str:
    """The text as the lexicon sees it, between two spaces."""
    text = (text or "").lower()
    if "$" in text:
        text = SIGN_IN_WORD.sub(lambda m: "s" * len(m[0]), text)
    return f" {text.translate(FOLD)} "


def features(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:k]}" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            a.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0))
        if len(a):
            a.make_automaton()
        return a


def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, length, weight) of the longest entry at each start, outside exceptions."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight == 0.0:
            spared.append((start, end))
        elif start not in best or best[start][0] < length:
            best[start] = (length, weight)
    if spared:
        spared.sort()
        kept, i, reach = {}, 0, -1
        for start in sorted(best):  # an exception that begins before and ends at the word's end or after
            while i < len(spared) and spared[i][0] <= start:
                reach = max(reach, spared[i][1])
                i += 1
            if reach < start + min(best[start][0], 2):
                kept[start] = best[start]
        best = kept
    return [(s, length, w) for s, (length, w) in best.items()]


def evidence(automaton, folded: str) -> tuple[float, float, float, float]:
    """What the score is a function of."""
    found = matches(automaton, folded)
    words = len(folded.split())
    long = np.log1p(words / 50)
    if not found:
        return 0.0, 0.0, 0.0, long
    distinct = {folded[s : s + length]: w for s, length, w in found}
    return sum(distinct.values()) / (1 + long), max(distinct.values()), min(1.0, 20 * len(found) / (words + 20)), long


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) -> the model."""
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = chosen.where(fold_of(F.col("id"), FOLDS) != HELD_OUT).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    sample = cut(sample.select("text", "y", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10)) < 3).alias("curve")).repartition(12))
    learn, curve = sample.where("not curve"), sample.where("curve")

    def count(batches, units):
        for pdf in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(pdf.text, pdf.y, strict=True):
                (toxic if y else clean).update(units(fold(text)))
            keys = list(toxic | clean)
            yield pd.DataFrame({"unit": pd.Series(keys, dtype=object), "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})

    def counted(units):
        return learn.mapInPandas(frugal(lambda it: count(it, units)), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    total = learn.groupBy("y").count().collect()
    n = {0: 0, 1: 0} | {r.y: r["count"] for r in total}
    if not n[0] or not n[1]:
        return Model(curve=[30.0 if n[1] else -30.0, 0, 0, 0, 0])
    units = counted(lambda t: {f for w in set(t.split()) if len(w) > 2 for f in features(w)})
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    sure = odds - ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    least = min(LEAST_DOCS, max(1, n[1] // 3))
    units = units.withColumn("w", sure).where((F.col("toxic") >= least) & (F.col("w") >= LEAST_ODDS)).orderBy(F.desc(F.col("toxic") * F.col("w")), "unit").limit(ENTRIES)
    weights = {r.unit: float(r.w) for r in units.collect()}
    for entry in sorted(weights, key=len, reverse=True):
        word = entry.strip()
        if any(weights.get(f" {word[:k]}", -9) >= weights[entry] - 0.7 for k in BEGINNINGS if k < len(word) or (k == len(word) and entry.endswith(" "))):
            del weights[entry]
    model = Model(weights)

    def around(folded: str) -> set[str]:
        found, a = set(), holder[0]
        for s, _, _ in matches(a, folded):
            end = folded.find(" ", s + 1)
            word, after = folded[s + 1 : end], folded[end + 1 : end + 40].split(" ", 1)[0]
            before = folded[max(0, s - 40) : s].rsplit(" ", 1)[-1]
            found.add(f" {word} ")
            if after:
                found.add(f" {word} {after} ")
            if before:
                found.add(f" {before} {word} ")
        return found

    holder: list = [None]

    def phrases(it):
        holder[0] = model.automaton()
        yield from count(it, around)

    spared = learn.mapInPandas(frugal(phrases), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared = spared.withColumn("w", odds).where("clean >= 3 and w < 0").orderBy(F.desc("clean"), "unit").limit(ENTRIES)
    model.exceptions = [r.unit for r in spared.collect() if r.unit not in model.weights]

    def seen(it):
        a = model.automaton()
        for pdf in it:
            got = np.array([evidence(a, fold(t)) for t in pdf.text], float).reshape(-1, 4)
            yield pd.DataFrame({"y": pdf.y, "a": got[:, 0], "b": got[:, 1], "c": got[:, 2], "d": got[:, 3]})

    known = curve.mapInPandas(frugal(seen), "y int, a double, b double, c double, d double").toPandas()
    if known.y.nunique() < 2:
        model.curve = [-4.0, 1.0, 0.3, 1.0, 0.0]
    else:
        model.curve = _logistic(known[["a", "b", "c", "d"]].to_numpy(), known.y.to_numpy(float)).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""

    def run(batches):
        a, w = model.automaton(), np.array(model.curve or [-30.0, 0, 0, 0, 0])
        for pdf in batches:
            x = np.array([evidence(a, fold(t)) for t in pdf.text], float).reshape(-1, 4)
            s = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInPandas(frugal(run), SCHEMA)


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that the score rejects, row by row."""
    def run(batches):
        a, w = model.automaton(), np.array(model.curve or [-30.0, 0, 0, 0, 0])
        for batch in batches:
            x = np.array([evidence(a, fold(t)) for t in batch["text"].to_pylist()], float).reshape(-1, 4)
            yield batch.filter(pa_bools(w[0] + x @ w[1:] < 0))

    return mapped(docs, run)


def pa_bools(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values.tolist(), pa.bool_())


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs, table(spark, sf_dir, "labels"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, fit(spark, docs, sf_dir))
