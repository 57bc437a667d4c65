"""Sharding by Hilbert-curve order.

Language, source and size are quantised to ``BITS`` bits each.  The cell's
index on the three-dimensional Hilbert curve orders the documents, so that a
run of the order covers a compact box of all three and the files' minima and
maxima prune on each.  The order is cut into runs of equal row counts (law
``rows``: any two shards differ by one row at most).

Quantising: a language or source has its place in the ordered list of the
distinct values, scaled to the grid; a size has its binary logarithm.  Inside
a cell equal texts stand together (by checksum), then by a hash of doc_id.

Scale: the narrow rows (no texts) are cut to the checkpoint folder once.  A
global rank takes no global sort.  Rows are counted by cell: that table has
``2 ** (3 * BITS)`` rows at most whatever the input, and the curve orders it
on the driver.  Each cell has a part for every ``PART_ROWS`` rows; a text
copied more often than that is dealt over parts of its own.  Parts are counted
and accumulated inside their cell, and each part numbers its own rows.

Files: ``write`` sends runs of ``FILE_ROWS`` places to one task each.

Null text: size 16, checksum of the empty text.  Null language or source:
first in the list.  Null or repeated doc_id: rows stay.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, cut, documents

BITS, SHARDS, PART_ROWS = 5, 40, 20_000
#: Rows of a run that one task writes to a file of its shard.
FILE_ROWS = 200_000
AXES = ("lang", "source", "size")
SPAN = 1 << 32


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (n x axes, < 2**bits)."""
    x = points.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):  # undo the turns, from the largest cube down
        low = (1 << level) - 1
        for axis in range(len(x)):
            turned = (x[axis] >> level) & 1 == 1
            change = (x[0] ^ x[axis]) & low
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ change)
            if axis:
                x[axis] = np.where(turned, x[axis], x[axis] ^ change)
    for axis in range(1, len(x)):  # Gray code, one axis upon the next
        x[axis] ^= x[axis - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= parity
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            index = (index << 1) | ((x[axis] >> level) & 1)
    return index


def _place(values: DataFrame, name: str, bits: int) -> DataFrame:
    """Distinct ``name`` -> its scaled place in their order."""
    distinct = values.select(name).distinct()
    rank = F.row_number().over(W.orderBy(F.col(name).asc_nulls_first())) - 1
    total = F.count(F.lit(1)).over(W.partitionBy())
    return distinct.select(name, F.floor(rank * (1 << bits) / total).cast("int").alias(f"axis_{name}"))


def order(docs: DataFrame, keys: tuple[str, ...] = (), bits: int = BITS, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """Rows with their 0-based ``place`` on the curve, and how many they are.
    Columns ``keys`` of ``docs`` go through and order ties."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(*keys, "doc_id", "lang", "source", (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("h", F.crc32(F.concat(F.lit("h"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = cut(rows)
    top = (1 << bits) - 1
    rows = rows.withColumn("axis_size", F.least(F.floor(F.log2("size") * (1 << bits) / 32), F.lit(top)).cast("int"))
    named = cut(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    for name in ("lang", "source"):
        place = _place(named, name, bits).withColumnRenamed(name, "__name")
        named = named.join(place, F.col(name).eqNullSafe(F.col("__name"))).drop("__name")
    named = named.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "axis_lang", "axis_source")
    rows = rows.join(named, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))).drop("__lang", "__source")
    rows = rows.withColumn("cell", (F.col("axis_lang") * (1 << bits) + F.col("axis_source")) * (1 << bits) + F.col("axis_size"))
    cells = np.array([tuple(r) for r in rows.groupBy("cell").count().collect()], np.int64).reshape(-1, 2)  # 2**(3 * bits) rows at most
    point = np.stack([cells[:, 0] >> (2 * bits), (cells[:, 0] >> bits) & top, cells[:, 0] & top], axis=1)
    curve = hilbert_index(point, bits)
    cells, curve = cells[np.argsort(curve)], np.sort(curve)
    start = np.cumsum(cells[:, 1]) - cells[:, 1]
    plan = spark.createDataFrame(
        [(int(c), int(i), int(s), int(-(-n // part_rows))) for (c, n), i, s in zip(cells, curve, start, strict=True)],
        "cell int, hilbert int, cell_start long, parts int",
    )
    rows = rows.join(F.broadcast(plan), "cell")
    hot = rows.groupBy("cell", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > part_rows)
    rows = rows.join(hot, ["cell", "text_crc32"], "left")
    alone = F.col("copies").isNotNull()
    rows = rows.withColumns({
        "part": F.floor(F.col("text_crc32") * F.col("parts") / SPAN).cast("int"),
        "group": F.when(alone, F.col("text_crc32")).otherwise(F.lit(-1)).cast("long"),
        "deal": F.when(alone, F.floor(F.col("h") * F.ceil(F.col("copies") / part_rows) / SPAN)).otherwise(0).cast("int"),
    })
    key = ["cell", "part", "group", "deal"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("cell").orderBy("part", "group", "deal").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("part_start", F.sum("n").over(upto) - F.col("n")).drop("n")
    inside = W.partitionBy(*key).orderBy("text_crc32", "h", "doc_id", "size", *keys)
    rows = rows.withColumn("own", F.row_number().over(inside) - 1).join(counts, key)
    return rows.withColumn("place", F.col("cell_start") + F.col("part_start") + F.col("own")), int(cells[:, 1].sum())


def shard(docs: DataFrame, shards: int = SHARDS, keys: tuple[str, ...] = (), **parameters) -> DataFrame:
    """docs(doc_id, text, lang, source) -> one row per document with shard and slot."""
    rows, total = order(docs, keys, **parameters)
    total = max(total, 1)
    number = F.floor(F.expr(f"place * {shards} div {total}"))
    rows = rows.withColumn("shard", number.cast("int"))
    first: Column = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return rows.select(*keys, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write(docs: DataFrame, path: str, shards: int = SHARDS, file_rows: int = FILE_ROWS, **parameters) -> None:
    """The documents themselves as Parquet folders ``shard=K``, in runs of ``file_rows``
    rows: a run is in one file, in curve order, so no task writes a whole shard.

    Each row finds its place by a 128-bit hash of the whole row; ids may be null or
    repeated.  A column ``shard`` of ``docs`` gives way to the folder's."""
    rows = docs.select(F.struct(*columns(docs)).alias("__row"))  # columns of any name travel inside
    nulls = F.array(*[F.col("__row")[c].isNull() for c in docs.columns])  # the hash skips nulls
    keys = ("__a", "__b")
    rows = rows.withColumns({k: F.xxhash64(F.lit(k), "__row", nulls) for k in keys})
    places = shard(rows.select(*keys, *(F.col("__row")[c].alias(c) for c in ("doc_id", "text", "lang", "source"))), shards, keys, **parameters)
    places = places.select(*keys, F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), F.expr(f"slot div {file_rows}").alias("__run"))
    # equal rows have equal keys: one of them meets the places of all
    rows = rows.groupBy(*keys).agg(F.first("__row").alias("__row")).join(places, list(keys))
    rows = rows.repartition("__shard", "__run").sortWithinPartitions("__shard", "__slot")
    rows.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c.lower() != "shard"), F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
