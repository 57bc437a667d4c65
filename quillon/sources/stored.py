"""Tables that are changed where they are stored.

A table is a Parquet folder with a subfolder for each hash of the key. A change
reads and rewrites only the subfolders in which a row really changes, by dynamic
partition overwrite: new files are written aside and take the place of the old
ones when all are there, so a lost executor repeats its tasks and a lost driver
repeats the change. A change that was made already changes nothing. Rows
without a key have no place in a table and stay out.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

PART = "__part"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local master may use a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, for plans that read a small result of a
    long plan several times.  The folder is the cluster's; a local master may use its own."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder, and read; the files stay."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def row_hashes(names: list[str]) -> list[Column]:
    """Two hashes of a row that tell nulls apart."""
    cells = [F.struct(*names), F.array(*[F.col(n).isNull() for n in names])]
    return [F.xxhash64(F.lit(seed), *cells) for seed in (1, 2)]


class StoredTable:
    """A stored table with ``key``, in ``parts`` subfolders. A key may have several rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | StructType, parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.names = self.schema.fieldNames()

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("int")

    def _rows(self) -> DataFrame:
        """Rows with the number of their subfolder."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema).withColumn(PART, F.lit(0))
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(PART, IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().select(*self.names)

    def find(self, *keys) -> DataFrame:
        """Rows of a few keys; only their subfolders are read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        there = [r[0] for r in asked.select(self._part()).distinct().collect()]
        return self._rows().where(F.col(PART).isin(there) & F.col(self.key).isin(list(keys))).select(*self.names)

    def _prints(self, rows: DataFrame) -> DataFrame:
        """key and a print of all its rows, whatever their order."""
        one, two = row_hashes(self.names)
        sums = [F.sum(h.cast("decimal(38,0)")) for h in (one, two)]
        return rows.groupBy(self.key).agg(F.struct(F.count(F.lit(1)).alias("n"), sums[0].alias("a"), sums[1].alias("b")).alias("print"))

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """Put ``rows`` in the place of all rows of ``keys``; keys without rows go. The subfolders rewritten."""
        shared_folder(self.spark)
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().checkpoint()  # both are read several times
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).join(keys, self.key, "left_semi").select(*self.names).checkpoint()
        near = [r[0] for r in keys.select(self._part()).distinct().collect()]  # at most ``parts`` numbers
        there = self._rows().where(F.col(PART).isin(near))
        was = self._prints(there.join(keys, self.key, "left_semi")).withColumnRenamed("print", "was")
        differ = self._prints(rows).join(was, self.key, "full").where(~F.col("print").eqNullSafe(F.col("was")))
        touched = sorted(r[0] for r in differ.select(self._part()).distinct().collect())
        if not touched:
            return []
        after = there.where(F.col(PART).isin(touched)).join(keys, self.key, "left_anti").unionByName(rows.withColumn(PART, self._part()).where(F.col(PART).isin(touched)))
        full = {r[0] for r in after.select(PART).distinct().collect()}
        after.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        for part in touched:  # dynamic overwrite leaves a subfolder that no row falls into
            if part not in full:
                delete_folder(self.spark, f"{self.path}/{PART}={part}")
        return touched

    def upsert(self, batch: DataFrame, order: str) -> list[int]:
        """Whole rows replace rows with their key, others are added; the last of a batch by ``order`` wins."""
        w = W.partitionBy(self.key).orderBy(F.desc(order), *[F.desc(c) for c in row_hashes(self.names)])
        last = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1")
        return self.replace(last, last)

    def delete(self, keys: DataFrame) -> list[int]:
        return self.replace(keys, self.spark.createDataFrame([], self.schema))

    def files(self) -> dict[int, set[str]]:
        """Names of the files of each subfolder."""
        found = self._rows().select(PART, F.col("_metadata.file_name").alias("file")).distinct() if exists(self.spark, self.path) else None
        out: dict[int, set[str]] = {}
        for r in found.collect() if found is not None else []:
            out.setdefault(r[0], set()).add(r[1])
        return out


class StoredRegistry:
    """Documents and their chunks, in subfolders by the same hash of document_id."""

    def __init__(self, spark: SparkSession, path: str, documents: str | StructType, parts: int = 64):
        self.documents = StoredTable(spark, f"{path}/documents", "document_id", documents, parts)
        self.chunks = StoredTable(spark, f"{path}/chunks", "document_id", "document_id bigint, ordinal int, text string", parts)

    def upsert(self, batch: DataFrame, order: str) -> list[int]:
        return self.documents.upsert(batch, order)

    def replace_chunks(self, texts: DataFrame) -> list[int]:
        """texts(document_id, texts array): all chunks of these documents, numbered by their place in the list.
        Of several lists for a document the greatest counts; a null or empty list leaves it without chunks."""
        one = texts.groupBy("document_id").agg(F.max("texts").alias("texts"))
        return self.chunks.replace(one, one.select("document_id", F.posexplode("texts").alias("ordinal", "text")))

    def prune(self, keep: DataFrame) -> DataFrame:
        """Remove documents that aren't in ``keep``, and their chunks. The removed ids, settled before anything is removed."""
        shared_folder(keep.sparkSession)
        known = self.documents.read().select("document_id").unionByName(self.chunks.read().select("document_id")).distinct()
        stale = known.join(keep.select("document_id"), "document_id", "left_anti").checkpoint()
        self.chunks.delete(stale)  # first: a change that is cut off here is found and finished by the next
        self.documents.delete(stale)
        return stale
