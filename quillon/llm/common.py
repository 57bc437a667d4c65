"""Helpers that the training-corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of documents that a Python worker handles at once.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator]) -> DataFrame:
    """``df.mapInArrow(run)`` with the schema of ``df``, whatever its columns' names; ``run`` sees the names."""
    names = df.columns
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))

    def renamed(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f"c{k}" for k in range(len(names))])

    return plain.mapInArrow(frugal(renamed), plain.schema).toDF(*names)


def folder(df: DataFrame) -> str:
    """The session's checkpoint folder.

    It is the cluster's ``spark.checkpoint.dir``.  Where none is set, a folder of
    this machine serves a local master, as in tests; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from there."""
    folder(df)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it; the files stay."""
    df.write.parquet(path := f"{folder(df)}/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` or ``stored`` has written and nothing reads any more."""
    context = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        paths = {file.get()} if file.isDefined() else set()
    else:
        paths = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def meet(rows: DataFrame, facts: DataFrame, counts: DataFrame, key: str, how: str = "inner", most: int = 2_000) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key; ``counts`` has ``key`` and its number of rows, ``n``.

    The facts of keys with over 1 000 rows, the ``most`` commonest of them at most, are
    broadcast: that many small rows. No other key holds over 1 000 rows or a
    ``most``-th of all, so the rest may be dealt out by key. Keys are not null;
    ``how`` is inner or left.
    """
    hot = cut(counts.where("n > 1000").orderBy(F.desc("n"), key).limit(most).select(key))
    if hot.isEmpty():
        return rows.join(facts, key, how)
    keys = F.broadcast(hot)
    near = rows.join(F.broadcast(facts.join(keys, key, "left_semi")), key, how).join(keys, key, "left_semi")
    return near.unionByName(rows.join(keys, key, "left_anti").join(facts.join(keys, key, "left_anti"), key, how))


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, in pieces of ``BATCH_ROWS`` rows whatever the
    session's Arrow batches are.  Freed memory goes back to the system at the end:
    Spark keeps Python workers for the stages that follow."""

    def pieces(batches):
        for batch in batches:
            for s in range(0, max(1, len(batch)), BATCH_ROWS):
                yield batch.iloc[s : s + BATCH_ROWS].reset_index(drop=True) if isinstance(batch, pd.DataFrame) else batch.slice(s, BATCH_ROWS)

    def wrapped(batches):
        yield from run(pieces(batches))
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal id modulo ``parts``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() cuts at exactly the six white-space bytes of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordCodes(dict):
    """Word -> 64-bit code, kept while the table stays below ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, over an array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shift_pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Code of the concatenation of two neighbouring pieces."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)
