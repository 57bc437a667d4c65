"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives fixed counts (words, characters, signs, repeated lines, repeated
three-word windows).  Texts that fail the base rules are out.  The counts of
the others become a vector of logarithms and square roots of shares; for every
language and source the location and scatter of the ``COVER`` of its rows with
the smallest covariance determinant are estimated, and a row whose Mahalanobis
distance from them is above ``CUT`` (the 0.9999 quantile of chi with five degrees) is rejected.

Estimation (FAST-MCD over aggregates): ``STARTS`` initial estimates of each
group, two of them robust: medians with quartile distances, spatial signs around
the medians, and plain means and covariances.  From each, ``STEPS`` concentration
steps: distances of all rows under the last estimate, the radius that covers
``COVER`` of the rows, mean and covariance of the rows inside.  The start whose
inner rows' covariance has the least determinant wins.  A last step takes the
rows within the 0.975 quantile.  Covariances are multiplied by the factor that
makes them consistent for normal rows.

A step is two aggregations: counts of distances by rings (``RINGS`` for each
doubling; rows at the radius's ring are inside), then sums of the rows inside.
A group of any size meets as counts and sums; rows are never collected or
sampled.  Rows meet their group's estimate by broadcast, up to ``MODELS`` estimates,
and beyond that by group and one of ``PARTS`` parts, so no group is one task's.  Vectors are in whole thousandths, so that the sums are exact and reruns agree.

Directions without scatter: a group whose inner rows all have no sign or no
repeated line has variance 0 there.  In units of ``NOISE``, the deviations that
counting alone gives a text of 200 words, the scatter's eigenvalues are 1 at
least, also in determinants; a direction that varies more than that is judged by
its own scatter.  Small groups: every group's estimate is averaged with that of
all rows together, which weighs like ``SHRINK`` rows.

Null text: no words, so it fails the base.  Null language or source: a group of
their own.  Null or repeated doc_id: rows stay.  Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCodes, cut, documents, forget, frugal, shift_pair, stored, words_of

COVER, STEPS, RINGS, SHRINK, CUT = 0.75, 4, 256, 20, 5.1
STARTS = ("quartiles", "signs", "plain")
#: Estimates that are broadcast (under 1 kB each), and parts of a group's rows beyond that.
MODELS, PARTS = 20_000, 64
#: The 0.975 quantile of chi with five degrees, and the share it covers.
NEAR, NEAR_SHARE = 3.582, 0.975
SIGNS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
Z = tuple(f"z{i}" for i in range(5))
#: Counting noise of 200 words: a count k that comes in clumps of c has a deviation
#: of sqrt(c) / 2 on the root scale.  Word lengths deviate by half of their mean,
#: signs come in fours, lines one by one, repeated windows bring six words.
NOISE = tuple(x / 200**0.5 for x in (1.0, 0.5, (4 / 5) ** 0.5 / 2, 10**0.5 / 2, 6**0.5 / 2))
SCALE = 1000


def repeats(codes: np.ndarray, window: int = 3) -> int:
    """Words in windows found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    keys = shift_pair(shift_pair(codes[:n], codes[1 : n + 1]), codes[2 : n + 2])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[1:n] |= same
    twice[: n - 1] |= same
    hit = np.zeros(n + window - 1, bool)
    found = order[twice[:n]]
    for d in range(window):
        hit[found + d] = True
    return int(hit.sum())


def counts_of(text: str | None, codes: WordCodes) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SIGNS)), dup, repeats(codes.of(words))


def stats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) -> counts, one pass over the texts."""

    def run(batches):
        codes = WordCodes()
        for pdf in batches:
            got = np.array([counts_of(t if isinstance(t, str) else None, codes) for t in pdf.text], np.int64).reshape(-1, 5)
            out = pdf[["doc_id", "lang", "source"]].copy()
            for i, name in enumerate(COUNTS):
                out[name] = got[:, i]
            yield out

    counts = docs.select("doc_id", "text", "lang", "source").mapInPandas(frugal(run), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    parts = (
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") * 10 / words),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return {z: F.round(p * SCALE).cast("long") for z, p in zip(Z, parts, strict=True)}


def _distance(center: str, inverse: str) -> Column:
    """Mahalanobis distance of the row's vector (in thousandths)."""
    d = [(F.col(z) - F.col(center)[i]) / SCALE for i, z in enumerate(Z)]
    square = sum(d[i] * d[j] * F.col(inverse)[5 * i + j] for i in range(5) for j in range(5))
    return F.sqrt(F.greatest(square, F.lit(0.0)))


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, for odd degrees of freedom."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, degrees, 2):
        total, term = total - term, term * x / (k + 2)
    return total


def consistency(share: float) -> float:
    """What the covariance of the inner ``share`` of normal rows is multiplied by."""
    if share >= 1:
        return 1.0
    low, high = 0.0, 100.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, len(Z)) < share else (low, middle)
    return share / chi_square(high, len(Z) + 2)


def floored(scatter: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant, no direction under its noise."""
    noise = np.outer(NOISE, NOISE)
    size, way = np.linalg.eigh(scatter / noise)
    size = np.maximum(size, 1.0)
    return way / size @ way.T / noise, float(np.log(size).sum())


MODEL = "group string, start int, rows long, center array<double>, scatter array<double>, inverse array<double>, det double"


def sums() -> list[Column]:
    """Sums and products of the vectors' components."""
    one = [F.sum(z).alias(f"s{i}") for i, z in enumerate(Z)]
    return [F.count(F.lit(1)).alias("n"), *one, *[F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"s{i}{j}") for i in range(5) for j in range(i, 5)]]


def moments(row: dict, n: float, names: str = "s") -> tuple[np.ndarray, np.ndarray]:
    """Mean (thousandths) and covariance of ``n`` rows with these sums."""
    mean = np.array([row[f"{names}{i}"] for i in range(5)], float) / n
    square = np.zeros((5, 5))
    for i in range(5):
        for j in range(i, 5):
            square[i, j] = square[j, i] = row[f"{names}{i}{j}"] / n - mean[i] * mean[j]
    return mean, square / SCALE**2


def estimated(sums: DataFrame, share: Column) -> DataFrame:
    """Models of rows (group, start, rows, n, sums) whose inner rows are ``share`` of the normal ones."""

    def fit(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                mean, scatter = moments(row, row["n"])
                scatter = scatter * consistency(row["share"])
                inverse, det = floored(scatter)
                out.append((row["group"], row["start"], row["rows"], mean.tolist(), scatter.ravel().tolist(), inverse.ravel().tolist(), det))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in MODEL.split(", ")])

    return stored(sums.withColumn("share", share).mapInPandas(fit, MODEL), "model")


def with_all(rows: DataFrame) -> DataFrame:
    """rows(group, z0..z4) with their part, once for their group and once for the group '' of all."""
    rows = rows.select("group", (F.monotonically_increasing_id() % PARTS).cast("int").alias("part"), *Z)
    return rows.unionByName(rows.withColumn("group", F.lit("")))


def meeting(rows: DataFrame, model: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` (with their part) joined with a written ``model`` of few rows a group."""
    if model.count() <= MODELS:
        return rows.join(F.broadcast(model), on, how)
    return rows.join(model.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, "part"], how)


def starts(rows: DataFrame) -> DataFrame:
    """The initial models; medians and quartiles are exact at any size: what moves
    are counts of whole thousandths."""
    found = rows.groupBy("group").agg(*[F.percentile(z, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{z}") for z in Z])
    wide = [F.greatest((F.col(f"q_{z}")[2] - F.col(f"q_{z}")[0]) / (1.349 * SCALE), F.lit(noise)) for z, noise in zip(Z, NOISE, strict=True)]
    found = stored(found.select("group", F.array(*[F.col(f"q_{z}")[1] for z in Z]).alias("middle"), F.array(*wide).alias("wide")), "middle")
    unit = [(F.col(z) - F.col("middle")[i]) / (F.col("wide")[i] * SCALE) for i, z in enumerate(Z)]
    length = F.greatest(sum(u * u for u in unit), F.lit(1e-12))
    signs = [F.sum(F.round(unit[i] * unit[j] / length * 1_000_000).cast("long")).alias(f"u{i}{j}") for i in range(5) for j in range(i, 5)]
    sum_of = meeting(rows, found, ["group"]).groupBy("group").agg(*sums(), *signs).join(found, "group")

    def make(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                middle, wide = np.array(row["middle"]), np.array(row["wide"])
                mean, scatter = moments(row, row["n"])
                sign = np.array([[row[f"u{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)]) / row["n"] / 1e6 * 5
                for k, (center, own) in enumerate(((middle, np.diag(wide**2)), (middle, sign * np.outer(wide, wide)), (mean, scatter))):
                    inverse, det = floored(own)
                    out.append((row["group"], k, row["n"], center.tolist(), own.ravel().tolist(), inverse.ravel().tolist(), det))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in MODEL.split(", ")])

    return stored(sum_of.mapInPandas(make, MODEL), "model")


def concentrated(rows: DataFrame, model: DataFrame, cover: float) -> DataFrame:
    """One concentration step of every start."""
    ringed = meeting(rows, model.select("group", "start", "center", "inverse"), ["group"])
    ringed = ringed.select("group", "start", "part", *Z, F.floor(F.log2(1 + _distance("center", "inverse")) * RINGS).cast("int").alias("ring"))
    radius = ringed.groupBy("group", "start").agg(F.expr(f"percentile_disc({cover}) WITHIN GROUP (ORDER BY ring)").alias("radius"), F.count(F.lit(1)).alias("rows"))
    radius = stored(radius, "radius")
    inner = meeting(ringed, radius, ["group", "start"]).where("ring <= radius").groupBy("group", "start", "rows").agg(*sums())
    return estimated(inner, F.col("n") / F.col("rows"))


def scatters(rows: DataFrame, steps: int = STEPS, cover: float = COVER) -> DataFrame:
    """rows(group, z0..z4) -> the model of least determinant of each group, and of
    the group '' of all rows together."""
    both = with_all(rows)
    model = starts(both)
    for _ in range(steps):
        after = concentrated(both, model, cover)
        forget(model)
        model = after
    best = model.groupBy("group").agg(F.min_by(F.struct("start", "center", "scatter", "inverse", "det"), F.struct("det", "start")).alias("m")).select("group", "m.*")
    return stored(best, "best")


def weighted(rows: DataFrame, best: DataFrame) -> DataFrame:
    """The last step: group, rows, center, scatter of the rows that are near."""
    both = with_all(rows)
    inner = meeting(both, best, ["group"]).where(_distance("center", "inverse") <= NEAR)
    total = both.groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    inner = inner.groupBy("group").agg(*sums()).join(total, "group").withColumn("start", F.lit(0))
    return estimated(inner, F.lit(NEAR_SHARE))


def averaged(model: DataFrame, shrink: int = SHRINK) -> DataFrame:
    """group, center, inverse: each group's estimate averaged with that of all rows."""
    every = model.where("group = ''").select(F.col("center").alias("all_center"), F.col("scatter").alias("all_scatter"))

    def make(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                part = row["rows"] / (row["rows"] + shrink)
                mean = part * np.array(row["center"]) + (1 - part) * np.array(row["all_center"])
                scatter = part * np.array(row["scatter"]) + (1 - part) * np.array(row["all_scatter"])
                out.append((row["group"], mean.tolist(), floored(scatter.reshape(5, 5))[0].ravel().tolist()))
            yield pd.DataFrame(out, columns=["group", "center", "inverse"])

    own = model.where("group <> ''").crossJoin(F.broadcast(every))  # one row
    return stored(own.mapInPandas(make, "group string, center array<double>, inverse array<double>"), "scatter")


def judge(docs: DataFrame, distance: float = CUT, shrink: int = SHRINK, **parameters) -> DataFrame:
    """docs(doc_id, text, lang, source) -> counts, base_failed, distance, kept."""
    group = F.to_json(F.struct("lang", "source"))
    rows = cut(stats(docs).withColumn("group", group).withColumns(vector()))
    able = rows.where("not base_failed")
    model = averaged(weighted(able, scatters(able, **parameters)), shrink)
    rows = meeting(rows.withColumn("part", (F.monotonically_increasing_id() % PARTS).cast("int")), model, ["group"], "left")
    far = F.coalesce(_distance("center", "inverse"), F.lit(0.0))
    return rows.select("doc_id", *COUNTS, "base_failed", far.alias("distance"), (~F.col("base_failed") & (far <= distance)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
