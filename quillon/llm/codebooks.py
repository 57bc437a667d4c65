"""Vector code compression: a vector becomes one codebook entry for each of its parts.

Components become integers, ``floor(SCALE * x)``. A vector is cut into ``PARTS``
consecutive parts, as equal as its length allows, and each part position has a
codebook of at most ``ENTRIES`` entries, which begins as that part of the
vectors with the smallest ids. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and replaces each entry by
the floor of its parts' mean; an entry that no part chose stays. After ``ROUNDS``
rounds parts are assigned once more.

Nearest entries come from a kd-tree per codebook, built on the driver each round
and broadcast. A search visits the child on a part's own side first and the
other child wherever the distance to its box is at most the best distance so
far, equal included, so an equally near entry of a lower index is never missed.
A batch of vectors walks a tree together. Everything is integer arithmetic: in
64 bits where all sums fit, else with Python's integers, so every finite vector
takes part at any scale.

Sums go from tasks to Spark's aggregate as limbs of ``LIMB`` bits, one row for
each part, entry, position and limb of a task; the driver gets one row for each
of a codebook's numbers.

Rows whose vector is null, empty, or holds null or non-finite components are
dropped; so are vectors of another length than the commonest (of equally common
lengths the shortest). A length that ``PARTS`` doesn't divide gives parts that
differ by one; a part without components gets code 0. Rows without an id come
last among the seeds; repeated ids are rows of their own, ordered by vector. With
fewer vectors than entries a codebook is smaller. Errors above a long's range
stay at its greatest value. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frugal, meet, table

PARTS, ENTRIES, ROUNDS, SCALE, LIMB = 8, 16, 6, 4096, 40
#: Entries at which a node of the tree stays a leaf.
LEAF = 2
GREATEST = (1 << 63) - 1
Entry = list[int]


def narrow(dim: int) -> int:
    """Magnitude up to which squared distances of whole vectors, and sums of a batch, stay in 64 bits."""
    return int((2.0**60 / max(dim, 1)) ** 0.5)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of vectors: int64 where the numbers allow it, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(SCALE))
    if not scaled.size or np.abs(scaled).max() <= narrow(values.shape[1]):
        return scaled.astype(np.int64)
    exact = [int(s) if np.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(values.shape)


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


class Tree:
    """A kd-tree over the entries of one codebook. A node is (axis, value, left, right, low and high corner)
    or (None, indexes): entries with a component of at most ``value`` lie left."""

    def __init__(self, entries: list[Entry], most: int):
        self.entries = entries
        big = max((abs(x) for e in entries for x in e), default=0) > most
        self.points = np.array(entries, dtype=object if big else np.int64).reshape(len(entries), -1)
        self.root = self._grow(list(range(len(entries))))

    def _grow(self, members: list[int]) -> tuple[Any, ...]:
        own = [self.entries[m] for m in members]
        low, high = [min(c) for c in zip(*own, strict=True)], [max(c) for c in zip(*own, strict=True)]
        wide = [h - a for a, h in zip(low, high, strict=True)]
        if len(members) <= LEAF or not wide or max(wide) == 0:
            return None, members, low, high
        axis = wide.index(max(wide))
        value = sorted(e[axis] for e in own)[(len(own) - 1) // 2]
        if value == high[axis]:  # the median is the greatest: cut below it
            value = max(e[axis] for e in own if e[axis] < value)
        sides = [m for m in members if self.entries[m][axis] <= value], [m for m in members if self.entries[m][axis] > value]
        return (axis, value), [self._grow(s) for s in sides], low, high

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, ties to the lower index."""
        points = self.points
        if parts.dtype == object or points.dtype == object:
            parts, points = parts.astype(object), points.astype(object)
        n = len(parts)
        best = np.full(n, -1, parts.dtype if parts.dtype == object else np.int64)
        index = np.full(n, len(self.entries), np.int64)

        def visit(node: tuple[Any, ...], rows: np.ndarray) -> None:
            if not len(rows):
                return
            how, inside, low, high = node
            own = parts[rows]
            if (index[rows] < len(self.entries)).any():  # branch and bound: boxes at most as far as the best so far
                corner = [np.array(c, dtype=points.dtype) for c in (low, high)]
                beyond = np.maximum(np.maximum(corner[0] - own, own - corner[1]), 0)
                near = ((beyond * beyond).sum(axis=1) <= best[rows]) | (index[rows] == len(self.entries))
                rows, own = rows[near], own[near]
            if how is None:
                for m in inside:
                    off = own - points[m]
                    far = (off * off).sum(axis=1)
                    have, at = best[rows], index[rows]
                    wins = ((far < have) | ((far == have) & (m < at)) | (at == len(self.entries))).astype(bool)
                    best[rows[wins]], index[rows[wins]] = far[wins], m
                return
            axis, value = how
            left = (own[:, axis] <= value).astype(bool)
            visit(inside[0], rows[left])
            visit(inside[1], rows[left])
            visit(inside[1], rows[~left])
            visit(inside[0], rows[~left])

        visit(self.root, np.arange(n))
        return index, best


def usable(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors as doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(values.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    flat = values.take(pa.array(rows)).flatten().cast(pa.float64(), safe=False)
    numbers = np.asarray(flat.fill_null(np.nan)).reshape(len(rows), dim)
    sound = np.isfinite(numbers).all(axis=1)
    return rows[sound], numbers[sound]


def limbs(total: int) -> list[int]:
    """Signed limbs: sum of limb * 2^(LIMB k)."""
    out = []
    while not -(1 << LIMB) < total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def sums(trees: list[Tree], vectors: np.ndarray, into: dict[tuple[int, int], list[Any]]) -> None:
    """Add counts and component sums of each entry's parts."""
    numbers = integers(vectors)
    for p, (a, b) in enumerate(cuts(vectors.shape[1], len(trees))):
        own = numbers[:, a:b]
        index, _ = trees[p].nearest(own)
        for e in np.unique(index).tolist():
            mine = own[index == e]
            held = into.setdefault((p, e), [0, [0] * (b - a)])
            held[0] += len(mine)
            held[1] = [x + int(y) for x, y in zip(held[1], mine.sum(axis=0).tolist() if b > a else [], strict=True)]


def seeds(vectors: DataFrame, dim: int, entries: int = ENTRIES) -> list[list[int]]:
    """The vectors with the smallest ids, as integers."""
    first = sound(vectors, dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    return [integers(np.array([r.v], dtype=np.float64))[0].tolist() for r in first]


def sound(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, v: rows with a vector of finite components."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where("v is not null and size(v) > 0")
    rows = rows if dim is None else rows.where(F.size("v") == dim)
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[list[Entry]]]:
    """Length of the vectors and the codebooks; (0, []) for an empty table."""
    length = sound(vectors).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if length is None:
        return 0, []
    dim = length.dim
    first = seeds(vectors, dim, entries)
    books = [[s[a:b] for s in first] for a, b in cuts(dim, parts)]
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast([Tree(b, narrow(dim)) for b in books])

        def run(batches, sent=sent):
            into: dict[tuple[int, int], list[Any]] = {}
            for batch in batches:
                _, numbers = usable(batch["embedding"], dim)
                if len(numbers):
                    sums(sent.value, numbers, into)
            rows = [(p, e, -1, 0, n) for (p, e), (n, _) in into.items()]
            rows += [(p, e, k, j, x) for (p, e), (_, total) in into.items() for k, t in enumerate(total) for j, x in enumerate(limbs(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["part", "entry", "position", "limb", "total"])

        told = vectors.select("embedding").mapInArrow(frugal(run), "part long, entry long, position long, limb long, total long")
        told = told.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total")).collect()
        count, total = {}, {}
        for r in told:
            if r.position < 0:
                count[r.part, r.entry] = r.total
            else:
                at = r.part, r.entry, r.position
                total[at] = total.get(at, 0) + (r.total << (LIMB * r.limb))
        books = [[[total[p, e, k] // count[p, e] for k in range(len(old))] if (p, e) in count else old for e, old in enumerate(book)] for p, book in enumerate(books)]
        sent.unpersist()
    return dim, books


def encode(vectors: DataFrame, dim: int, books: list[list[Entry]]) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, label, code, error."""
    kinds = {f.name: f.dataType for f in vectors.schema}
    sent = vectors.sparkSession.sparkContext.broadcast([Tree(b, narrow(dim)) for b in books])

    def run(batches):
        for batch in batches:
            rows, vectors = usable(batch["embedding"], dim)
            numbers, found = integers(vectors), []
            error: Any = np.zeros(len(rows), np.int64)
            for tree, (a, b) in zip(sent.value, cuts(dim, len(sent.value)), strict=True):
                index, far = tree.nearest(numbers[:, a:b])
                found.append(index)
                error = error + far
            code = ["".join(map("{:02x}".format, c)) for c in np.stack(found, axis=1).tolist()] if found else []
            keep = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(keep), batch["label"].take(keep), pa.array(code, pa.string()), pa.array([min(int(e), GREATEST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(frugal(run), f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, code string, error long")


def digest(books: list[list[Entry]]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def decode(codes: list[str], books: list[list[Entry]]) -> np.ndarray:
    """The vectors that codes stand for, as numbers of the original scale."""
    return np.array([[x / SCALE for p, b in enumerate(books) for x in b[int(c[2 * p : 2 * p + 2], 16)]] for c in codes])


def coded(vectors: DataFrame, **parameters) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256."""
    dim, books = fit(vectors, **parameters)
    rows = cut(encode(vectors, dim, books).withColumn("__of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(GREATEST).cast("decimal(38,0)")).cast("long")
    labels = rows.groupBy("__of").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n"))
    return meet(rows, labels.drop("n"), labels, "__of").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _round(k: int) -> str:
    """The entries after round k + 1 from those before."""
    return f"""
a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, arg_min(c.entry, {{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.entry}}) AS entry
  FROM p JOIN c{k} c ON p.part = c.part GROUP BY ALL),
m{k} AS (SELECT part, entry, i, sum(p.x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN p USING (vec_id, part), range(1, 9) g(i) GROUP BY ALL),
n{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n USING (part, entry))"""


#: The same rows in DuckDB where ids are not repeated, vectors have 64 components and numbers fit.
SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * 8 + 1:part * 8 + 8] AS x FROM v, range(8) t(part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN s USING (vec_id)),{",".join(_round(k) for k in range(ROUNDS))},
e AS (SELECT p.vec_id, p.part, min({{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.entry}}) AS best FROM p JOIN c{ROUNDS} c ON p.part = c.part GROUP BY ALL),
r AS (SELECT vec_id, string_agg(printf('%02x', best.e::INT), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM e GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM r JOIN v USING (vec_id)
"""
