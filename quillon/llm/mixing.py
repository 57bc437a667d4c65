"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]:
``g(t) = 1 + a (2t - 1)`` with a slope ``a`` in [-1, 1].  Its integral
``G(t) = t + a (t^2 - t)`` is the share of the source's tokens asked for
until t.  A source's documents stand in a fixed pseudo-random order; the
share of the source's tokens supplied before a document is put through the
inverse of ``G`` and gives the document's training position.  A range sort by
position is the training order.

Targets: weights share ``budget`` times all words; a target stops at
``cap`` times its source's size and the excess goes to the others by weight,
which is water-filling: sort sources by cap/weight, find the level at which
capped and uncapped amounts add up to the budget.

A source that needs r times its size passes whole floor(r) times; of the
next pass it takes the first documents of its order, the last of them in
part, so that the taken words add up to the target to within a word.

Scale: words are counted in one scan, whose narrow result is cut to the
checkpoint folder.  Prefix sums go by (source, hash bucket): 4096 bucket sums
a source are accumulated, then each bucket adds up its own rows, so a source
with a third of all rows is spread over 4096 groups.

Null text or text without words: size 0, taken 0.  Null source: a source of
its own, ordered last.  Null doc_id: the text's hash stands in for it. Null
and repeated doc_id: rows stay; ties are ordered by size.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, cut, documents, n_words

WEIGHTS = (3.0, 1.0, 2.0)
#: Slope of the schedule of each weight's sources: the heaviest come early.
SLOPES = (-0.5, 0.0, 0.5)
BUDGET, CAP = 1.5, 2.0


def _cycle(values: tuple[float, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), ((index % len(values)) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget=BUDGET, cap=CAP) -> DataFrame:
    """no_source, src, source_size -> with weight, slope and target.  One row a source."""
    by_name = W.orderBy("no_source", F.encode("src", "utf-8"))
    index = F.row_number().over(by_name) - 1
    s = sizes.withColumn("k", index).withColumn("weight", _cycle(weights, F.col("k"))).withColumn("slope", _cycle(slopes, F.col("k")))
    s = s.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    up = W.orderBy("ratio", "k")
    upto, rest, every = up.rowsBetween(W.unboundedPreceding, W.currentRow), up.rowsBetween(W.currentRow, W.unboundedFollowing), W.partitionBy()
    s = s.withColumn("capped", F.sum("limit").over(upto) - F.col("limit")).withColumn("open", F.sum("weight").over(rest)).withColumn("all", budget * F.sum("source_size").over(every))
    # the level if this source and those after it were not capped; the first that fits is the level of all
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    s = s.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(every)["level"], F.lit(float("inf"))))
    return s.withColumn("target", F.least("limit", F.col("level") * F.col("weight"))).select("no_source", "src", "source_size", "weight", "slope", "target")


def _inverse(slope: Column, share: Column) -> Column:
    """t with G(t) = share."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise((root - (1 - slope)) / (2 * slope) + 0.0)


def mix(docs: DataFrame, keys: tuple[str, ...] = (), **parameters) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken, position, copies.
    Columns ``keys`` of ``docs`` go through and order ties."""
    base = docs.select(*keys, "doc_id", n_words(F.col("text")).alias("size"), F.col("source").isNull().cast("int").alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("h"))
    base = cut(base.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")))
    sums = base.groupBy("no_source", "src", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("no_source", "src").agg(F.sum("bucket_size").alias("source_size")), **parameters)
    upto = W.partitionBy("no_source", "src").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sums.withColumn("start", F.sum("bucket_size").over(upto) - F.col("bucket_size")).drop("bucket_size")
    inside = W.partitionBy("no_source", "src", "bucket").orderBy("h", "size", *keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = base.withColumn("end", F.sum("size").over(inside)).join(starts, ["no_source", "src", "bucket"]).join(goal, ["no_source", "src"])
    rows = rows.withColumn("before", F.col("start") + F.col("end") - F.col("size"))
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    left = F.floor(F.col("target") - whole * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least("size", left - F.col("before")))
    rows = rows.withColumn("taken", (F.col("size") * whole + part).cast("long"))
    share = F.col("before") / F.col("target")
    return rows.select(
        *keys, "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, _inverse(F.col("slope"), F.least(share, F.lit(1.0)))).alias("position"),
        F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(0).alias("copies"),
        "slope",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its training position, range-sorted by it; those that aren't taken come last."""
    return mix(documents(spark, sf_dir)).drop("slope").orderBy(F.asc_nulls_last("position"), "doc_id", "size")


def copies_in_order(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, to the nearest
    whole copy, range-sorted by training position.  Columns of ``docs``.

    A document without words has nothing to mix and stays out.  The k-th copy
    stands where the k-th pass over its source meets it.  Each row has its own
    plan, found by a 128-bit hash of the whole row; ids may be null or repeated.
    """
    rows = docs.select(F.struct(*columns(docs)).alias("__row"))  # columns of any name travel inside
    nulls = F.array(*[F.col("__row")[c].isNull() for c in docs.columns])  # the hash skips nulls
    keys = ("__a", "__b")
    rows = rows.withColumns({k: F.xxhash64(F.lit(k), "__row", nulls) for k in keys})
    plan = mix(rows.select(*keys, "__row.doc_id", "__row.text", "__row.source"), keys, **parameters).where("copies > 0")
    first = F.col("position") + F.col("slope") * (F.col("position") * F.col("position") - F.col("position"))  # G(position): the share of the first copy
    each = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: _inverse(F.col("slope"), F.least(first + k * F.col("source_size") / F.col("target"), F.lit(1.0))))
    plan = plan.select(*keys, each.alias("__each"))
    # equal rows have equal keys: one of them meets the plans of all
    rows = rows.groupBy(*keys).agg(F.first("__row").alias("__row")).join(plan, list(keys)).select("__row", *keys, F.explode("__each").alias("__at"))
    return rows.orderBy("__at", "__row.doc_id", *keys).select("__row.*")


#: The same rows in DuckDB; more columns than the contract's are included.
SQL = """
WITH base AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (source IS NULL)::INT AS no_source, coalesce(source, '') AS src, md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
k AS (SELECT *, row_number() OVER (ORDER BY no_source, encode(src)) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             CASE k % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope,
             2.0::DOUBLE * source_size AS cap FROM k),
c AS (SELECT *, cap / weight AS ratio,
             sum(cap) OVER (ORDER BY cap / weight, k ROWS UNBOUNDED PRECEDING) - cap AS capped,
             sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - capped) / open AS own FROM c),
g AS (SELECT *, least(cap, weight * coalesce((SELECT own FROM l WHERE own <= ratio ORDER BY ratio, k LIMIT 1), 'inf'::DOUBLE)) AS target FROM l),
r AS (SELECT b.*, g.source_size, g.target, g.slope,
             sum(size) OVER (PARTITION BY b.no_source, b.src ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS before,
             floor(CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END)::BIGINT AS whole
      FROM base b JOIN g USING (no_source, src)),
t AS (SELECT *, (size * whole + greatest(0, least(size, floor(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken FROM r)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN least(before / target, 1.0)
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * least(before / target, 1.0)) - (1 - slope)) / (2 * slope) END END::DOUBLE AS position,
       CASE WHEN size > 0 THEN round(taken / size)::INT ELSE 0 END AS copies
FROM t
"""
