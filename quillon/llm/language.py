"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For every bit a binary classifier, a
logistic regression over hashed byte n-grams, predicts the bit of a text's
language.  Decoding weighs each bit's logistic loss by how far its classifier
beats chance in training, adds up the losses against every codeword and takes
the least; a text whose two best codewords are close is flagged ambiguous.

Codes: all distinct splits of the languages for up to five of them, above that
the random code, of several drawn from a fixed seed, whose codewords are
furthest apart.

Learning takes documents with a language and ``crc32(doc_id) mod 4 <> 2``, of
these at most ``TRAIN_ROWS / languages`` a language, ``LEAST`` where that is less,
by a hash of the id.  Every language is learned; the sample grows with the number
of languages only.  All texts are predicted whole, in one pass without a shuffle.

Null text or text without a letter: ``und``, score 0.  Nothing to learn from:
``und``, score 0.  Null or repeated doc_id: rows stay (``held_out`` is false for
null).  Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, fold_of, frugal

TRAIN_ROWS, LEAST, BITS, ROUNDS, SEED = 2_400, 8, 12, 120, 7
FOLDS, HELD_OUT = 4, 2
#: Two best codewords closer than this part of the worst loss: ambiguous.
CLOSE = 0.08
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def _plain() -> np.ndarray:
    """Bytes as the classifiers see them: ASCII without letters is a space."""
    to = np.arange(256, dtype=np.uint8)
    for code in range(128):
        if not chr(code).isalpha():
            to[code] = 32
    return to


PLAIN = _plain()


def lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Unit vector of hashed 1- to 4-grams of bytes, square roots of counts."""
    b = PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    total = np.zeros(1 << bits)
    code = b.copy()
    for n in range(1, 5):
        if n > 1:
            if len(b) < n:
                break
            code = code[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        total += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    total = np.sqrt(total)
    return (total / max(1e-9, np.sqrt((total * total).sum()))).astype(np.float32)


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """n rows of +1 and -1."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))  # the first language is always +1
        return (1 - 2 * ((splits[None, :] << 1 >> np.arange(n)[:, None]) & 1)).astype(np.float32)
    width, best = max(15, int(np.ceil(10 * np.log2(n)))), None
    rng = np.random.default_rng(seed)
    for _ in range(40):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        apart = (width - code @ code.T) / 2 + width * np.eye(n)
        if (np.abs(code.sum(axis=0)) < n).all() and (best is None or apart.min() > best[0]):
            best = apart.min(), code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (features + 1) x bits
    trust: np.ndarray  # of each bit


def learn(x: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regressions of all bits at once, by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = np.zeros((x.shape[1], target.shape[1]), np.float32)
    ahead, rate = w.copy(), np.float32(2.0)
    for k in range(rounds):
        pull = target / (1 + np.exp(np.clip(target * (x @ ahead), -30, 30)))
        after = ahead + rate * (x.T @ pull / np.float32(len(x)) * np.float32(8) - np.float32(ridge) * ahead)
        ahead, w = after + np.float32(k / (k + 3)) * (after - w), after
    return w


def train(docs: DataFrame, rows: int = TRAIN_ROWS, least: int = LEAST) -> Model | None:
    """docs(doc_id, text, lang) -> the model; None if no language can be learned."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return None
    share = max(least, rows // len(sizes))
    first = W.partitionBy("lang").orderBy("h", "doc_id")
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, 2.0 * share / r["count"]))])[F.col("lang")]  # about twice the share, so that no task ranks a whole language
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).where((F.col("h") / float(1 << 63) + 1) / 2 < part)
    ids = ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= share)
    sample = known.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def vectors(batches):
        for pdf in batches:
            keep = [lettered(t) for t in pdf.text]
            pdf = pdf[keep]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "lang": pdf.lang.astype(object), "v": pd.Series([grams(t).astype(np.float16).tobytes() for t in pdf.text], index=pdf.index, dtype=object)})

    got = sorted(sample.mapInPandas(frugal(vectors), "doc_id long, lang string, v binary").collect(), key=lambda r: (r.doc_id, r.lang))
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    x = np.stack([np.frombuffer(r.v, np.float16) for r in got]).astype(np.float32)
    y = np.array([languages.index(r.lang) for r in got])
    code = codewords(len(languages))
    target = code[y]
    weights = learn(x, target)
    right = (np.sign(x @ weights[:-1] + weights[-1]) == target).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.05)
    return Model(languages, code, weights, trust / trust.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score, and whether another is close, of each row of margins."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None, :, :]) @ model.trust
    order = np.argsort(loss, axis=1, kind="stable")
    rows = np.arange(len(loss))
    odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 3)
    score = 1 / odds.sum(axis=1)
    if loss.shape[1] == 1:
        return order[:, 0], np.ones(len(loss)), np.zeros(len(loss), bool)
    gap = (loss[rows, order[:, 1]] - loss[rows, order[:, 0]]) / np.maximum(loss.max(axis=1), 1e-9)
    return order[:, 0], score, gap < CLOSE


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score, ambiguous."""

    def run(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf.text]
            able = np.array([bool(model) and lettered(t) for t in texts], bool)
            lang, score, close = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if able.any():
                where = np.flatnonzero(able)
                w = model.weights
                margins = np.stack([grams(texts[i]) @ w[:-1] + w[-1] for i in where])
                best, s, c = decode(model, margins)
                lang[where], score[where], close[where] = [model.languages[b] for b in best], s, c
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "lang_pred": pd.Series(lang, dtype=object), "score": score, "ambiguous": close})

    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInPandas(frugal(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return predict(docs, train(docs))
