"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length 1, turned by ``TURNS`` fixed random orthogonal
matrices, and kept as the signs of its components under each (one bit a
dimension and turn, packed) beside corrections: its length, and per turn the
inner product ``a`` of the turned unit vector with its own code. For a query q,
turned alike, ``<code, q> / a`` estimates the inner product of the unit vectors
with a standard error of ``sqrt((1 - a^2) / (a^2 (D - 1)))`` at most, turns
independently of each other; the estimate is the mean over turns and ``BOUND``
standard errors of that mean are its error bound.

Blocks of codes meet blocks of queries twice; full vectors never travel with
them. The first time each block gives the k best estimates of each query; the
best k of all join their vectors, and the least of their exact inner products
is the query's bar. The second time each vector whose upper bound reaches the
bar is a candidate. Candidates alone join their vectors and are ranked by the
exact inner product in double precision, added up in component order.

All estimates are of unit vectors; lengths are relative to the table's greatest
component, in double precision. So vectors of any finite length take part
alike. Products beyond a double's range are infinite, as the measure has it.

Scale: ids, codes and queries are packed by a hash of the row, ``BLOCK`` and
``QUERIES`` rows together; a block of codes goes to every block of queries, which
is the stated query set against all rows. Of equal vectors only the k + 1 rows
with the smallest ids can be among anyone's k nearest (one of them may be the
query itself), so the others, which those stand for, get no code of their own;
Spark finds them by a limit on ranks before it deals rows out. Bars and candidates
grow with the number of queries.

Vectors that are null, zero, of another length than the commonest, or hold null
or non-finite components take no part; nor do rows without an id. Queries: ids
divisible by ``EVERY``. A query's own row is every row with its id. Rows with the
same id and vector are candidates as often as they stand there and one query;
different vectors of one id are rows and queries of their own, whose answers
bear the same query_id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, frugal, table

K, EVERY, BOUND, TURNS, BLOCK, QUERIES, SEED = 20, 20, 3.0, 8, 8192, 1024, 20240611
#: Room for single precision in estimates of unit vectors.
ROOM = 1e-5
PAIR = "query_id long, q_h long, vec_id long, h long"


def rotations(dim: int, turns: int = TURNS, seed: int = SEED) -> np.ndarray:
    rng, out = np.random.default_rng(seed), []
    for _ in range(turns):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their length."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(unit: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (rows x turns x bytes) and corrections (rows x turns)."""
    turned = np.einsum("nd,red->nre", unit, turns)
    return np.packbits(turned >= 0, axis=2), (np.abs(turned).sum(axis=2) / np.sqrt(unit.shape[1])).astype(np.float32)


def spread(fit: np.ndarray, dim: int, bound: float) -> np.ndarray:
    """Error bounds of the estimates, a row each."""
    own = np.maximum(1 - fit.astype(np.float64) ** 2, 0) / (fit.astype(np.float64) ** 2 * max(dim - 1, 1))
    return bound * np.sqrt(own.sum(axis=1)) / fit.shape[1] + ROOM


def codes_of(codes: np.ndarray, fit: np.ndarray, dim: int) -> np.ndarray:
    """Signs as numbers, weighed so that one product with a turned query is the mean estimate."""
    n, turns = fit.shape
    signs = np.unpackbits(codes, axis=2, count=dim).astype(np.float32) * 2 - 1
    return (signs / (fit * (np.sqrt(dim) * turns))[:, :, None].astype(np.float32)).reshape(n, turns * dim)


def turned(unit: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return np.einsum("nd,red->nre", unit, turns).reshape(len(unit), -1).astype(np.float32)


def _scaled(v: str | Column, most: Column) -> Column:
    """Length of a vector in units of ``most``."""
    top = F.array_max(F.transform(v, F.abs))
    return top / most * F.sqrt(F.aggregate(F.transform(v, lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x))


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double): the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    return rows.join(F.broadcast(size.select("d")), F.size("v") == F.col("d")).drop("d")


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, h, v, copies, nu: one row for each id and vector, with its relative length."""
    rows = rows.groupBy("vec_id", F.xxhash64("v").alias("h")).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    return cut(rows)


def index(rows: DataFrame, blocks: int, turns: int = TURNS, seed: int = SEED) -> DataFrame:
    """Blocks of codes: ids, hashes, relative lengths, codes and corrections as binary."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(part.v.to_numpy()).astype(np.float64)
        codes, fit = encode(units(vectors), rotations(vectors.shape[1], turns, seed))
        packed = {"ids": part.vec_id.to_numpy(np.int64), "hs": part.h.to_numpy(np.int64), "nus": part.nu.to_numpy(np.float64), "codes": codes, "fits": fit}
        return pd.DataFrame({"block": part.block[:1], "n": [len(part)], "dim": [vectors.shape[1]]} | {k: [x.tobytes()] for k, x in packed.items()})

    dealt = rows.withColumn("block", F.expr(f"pmod(xxhash64(vec_id, h), {blocks})").cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, "block int, n int, dim int, ids binary, hs binary, nus binary, codes binary, fits binary")


def asking(rows: DataFrame, sets: int) -> DataFrame:
    """Blocks of queries with their bars; a null bar leaves every vector a candidate."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        bars = part.bar.fillna(-np.inf).to_numpy(np.float64)
        unit = units(np.stack(part.v.to_numpy()).astype(np.float64))
        return pd.DataFrame({"ask": part.ask[:1], "q_ids": [part.vec_id.to_numpy(np.int64).tobytes()], "q_hs": [part.h.to_numpy(np.int64).tobytes()], "queries": [unit.tobytes()], "bars": [bars.tobytes()]})

    dealt = rows.withColumn("ask", F.expr(f"pmod(xxhash64(vec_id, h), {sets})").cast("int"))
    return dealt.groupBy("ask").applyInPandas(pack, "ask int, q_ids binary, q_hs binary, queries binary, bars binary")


def matched(store: DataFrame, asks: DataFrame, sets: int, parts: int, choose, schema: str, turns: int, seed: int) -> DataFrame:
    """Every block of codes with every block of queries; ``choose`` takes what it wants of a query's estimates."""

    def meet(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, hs, nus = np.frombuffer(r.ids, np.int64), np.frombuffer(r.hs, np.int64), np.frombuffer(r.nus)
                fit = np.frombuffer(r.fits, np.float32).reshape(r.n, turns)
                signs = codes_of(np.frombuffer(r.codes, np.uint8).reshape(r.n, turns, -1), fit, r.dim)
                q_ids, q_hs, bars = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_hs, np.int64), np.frombuffer(r.bars)
                asked = turned(np.frombuffer(r.queries).reshape(-1, r.dim), rotations(r.dim, turns, seed))
                step = max(1, 2_000_000 // max(r.n, 1))
                for s in range(0, len(q_ids), step):
                    guess = asked[s : s + step] @ signs.T
                    picked = [choose(q, g, ids != q, nus, fit, r.dim, bar) for q, g, bar in zip(q_ids[s : s + step], guess, bars[s : s + step], strict=True)]
                    sizes = [len(p) for p, _ in picked]
                    at = np.concatenate([p for p, _ in picked])
                    out = {"query_id": np.repeat(q_ids[s : s + step], sizes), "q_h": np.repeat(q_hs[s : s + step], sizes), "vec_id": ids[at], "h": hs[at], "worth": np.concatenate([w for _, w in picked])}
                    yield pd.DataFrame(out)

    spread_out = store.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    return spread_out.join(asks, "ask").repartition(parts, "ask", "block").mapInPandas(frugal(meet), schema)


def best_guesses(k: int):
    """The k best estimates, own row aside."""

    def choose(q, guess, other, nus, fit, dim, bar):
        worth = np.where(other, nus * guess, -np.inf)
        at = np.argpartition(-worth, k - 1)[:k] if len(worth) > k else np.arange(len(worth))
        at = at[other[at]]
        return at, worth[at]

    return choose


def within_bounds(bound: float):
    """All whose upper bound reaches the bar."""

    def choose(q, guess, other, nus, fit, dim, bar):
        high = nus * (guess + spread(fit, dim, bound))
        at = np.flatnonzero(other & (high >= bar))
        return at, high[at]

    return choose


def _product(x: str, y: str, by: Column, of: Column) -> Column:
    """Inner product of two arrays, each divided first, added up in component order."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a / by) * (b / of)), F.lit(0.0), lambda a, x: a + x)


def candidates(rows: DataFrame, k: int = K, every: int = EVERY, bound: float = BOUND, block: int = BLOCK, queries: int = QUERIES, turns: int = TURNS, seed: int = SEED) -> DataFrame:
    """keyed rows -> query_id, q_h, vec_id, h: what the error bounds leave to be ranked exactly."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    blocks, sets = max(1, -(-size.n // block)), max(1, -(-size.q // queries))
    parts, most = max(2, min(blocks * sets, 4096)), F.lit(float(size.most or 1.0))
    rows = rows.withColumn("nu", _scaled("v", most))
    same = W.partitionBy("h", F.xxhash64(F.lit(1), "v")).orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    store, asked = cut(index(first, blocks, turns, seed)), rows.where(F.col("vec_id") % every == 0)
    open_ = asking(asked.withColumn("bar", F.lit(None).cast("double")), sets)
    own = W.partitionBy("query_id", "q_h").orderBy(F.desc("worth"), "vec_id", "h")
    tried = matched(store, open_, sets, parts, best_guesses(k), f"{PAIR}, worth double", turns, seed)
    tried = tried.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k).drop("place", "worth")
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("h").alias("q_h"), F.col("v").alias("q_v"), F.col("nu").alias("q_nu"))
    exact = tried.join(rows.select("vec_id", "h", "v"), ["vec_id", "h"]).join(q, ["query_id", "q_h"])
    exact = exact.withColumn("worth", _product("v", "q_v", most, most) / F.col("q_nu"))
    bars = exact.groupBy("query_id", "q_h").agg(F.min("worth").alias("bar"), F.count(F.lit(1)).alias("n"))
    bars = bars.select(F.col("query_id").alias("vec_id"), F.col("q_h").alias("h"), F.when(F.col("n") >= k, F.col("bar") - F.abs("bar") * 1e-9).alias("bar"))
    asks = asking(asked.join(bars, ["vec_id", "h"], "left"), sets)
    return matched(store, asks, sets, parts, within_bounds(bound), f"{PAIR}, worth double", turns, seed).drop("worth")


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, **parameters) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score."""
    rows = keyed(clean(vectors))
    found = candidates(rows, k, every, **parameters)
    q = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("q_h"), F.col("v").alias("q_v"))
    one = F.lit(1.0)
    scored = found.join(rows.select("vec_id", "h", "v", "copies"), ["vec_id", "h"]).join(q, ["query_id", "q_h"])
    scored = scored.select("query_id", "q_h", "vec_id", "h", "copies", _product("v", "q_v", one, one).alias("score"))
    own = W.partitionBy("query_id", "q_h").orderBy(F.desc("score"), "vec_id", "h")
    top = scored.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)
    each = top.select("query_id", "q_h", "vec_id", "h", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))).alias("copy"))
    ranked = each.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id", "h", "copy")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
