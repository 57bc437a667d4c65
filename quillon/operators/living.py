"""A lexical index that lives on: blocks of chunks are stored, added and retracted.

An index is a folder of segments; each refresh adds one. A segment has the new and changed
documents' chunks as blocks with their inverted lists; by how much each term's document
frequency changes; and the documents' new state, alive or not. A row of ``commits`` makes a
segment count, and carries its part of the totals; files of a refresh that was cut off count
for nothing and are written over by the next.

A chunk of a block counts if its segment is the last that names its document and the
document is alive in it; others are taken out when the block is read. Frequencies and totals
are sums over segments, so a search equals one over an index built anew. Postings are never
shuffled: what meets by documents is their numbers and the places of their chunks.
``compacted`` writes the living chunks as one segment elsewhere.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import DEFAULT, EngineConfig
from quillon.functions.text import tokens
from quillon.operators import ranking as R
from quillon.sources.stored import delete_folder, exists, kept, settled, shared_folder

#: A block of ``ranking.inverted``, its number, and the documents of its chunks.
BLOCKS = f"{R.INVERTED}, block long, documents array<long>"
SCHEMAS = {
    "blocks": f"{BLOCKS}, segment int",
    "terms": "token string, df bigint, segment int",
    "changes": "document_id bigint, print string, alive boolean, segment int, bucket int",
}
COMMITS = "segment int, chunks bigint, words bigint, documents bigint"


def _blocks(batches):
    for batch in batches:
        for s in range(0, len(batch), R.BLOCK):
            part = batch.slice(s, R.BLOCK)
            documents = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("document_id").cast(pa.int64()))
            for block in R._inverted([part]):
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array([uuid.uuid4().int >> 65]), documents], names=[f.split()[0] for f in BLOCKS.split(", ")])


def _marked(batch, i: int, n: int) -> np.ndarray:
    """Which of a block's ``n`` chunks are at ``places``."""
    marked = np.zeros(n, bool)
    if batch.column("places")[i].is_valid:
        marked[batch.column("places")[i].values.to_numpy()] = True
    return marked


def _without(batches):
    """Blocks without the chunks at ``places`` and what stands in them alone."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    for batch in batches:
        for i in range(len(batch)):
            ids, dl, terms, starts, at, tf, documents = R._cells(batch, i, "ids", "dl", "terms", "starts", "at", "tf", "documents")
            stays = ~_marked(batch, i, len(ids))
            if stays.all():
                yield batch.slice(i, 1).select(names)
                continue
            held = stays[at]
            before = np.append(0, np.cumsum(held))[starts]
            some = np.diff(before) > 0
            starts = np.append(before[:-1][some], before[-1])
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            chunks = [whole(x.filter(pa.array(stays))) for x in (ids, dl)]
            lists = [R._blob(x, np.int32) for x in (starts, (np.cumsum(stays) - 1)[at[held]], tf[held])]
            columns = [*chunks, whole(terms.filter(pa.array(some))), *lists, batch.column("block").slice(i, 1), whole(documents.filter(pa.array(stays)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _retracted(batches):
    """Blocks with ``places`` -> in how many chunks there each term stands, negative."""
    for batch in batches:
        for i in range(len(batch)):
            dl, terms, starts, at = R._cells(batch, i, "dl", "terms", "starts", "at")
            df = np.diff(np.append(0, np.cumsum(_marked(batch, i, len(dl))[at]))[starts])
            yield pa.RecordBatch.from_arrays([terms.filter(pa.array(df > 0)), pa.array(-df[df > 0].astype(np.int64))], names=["token", "df"])


class LivingIndex:
    """``buckets`` subfolders a segment for the documents' states."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.buckets)).cast("int")

    def commits(self) -> DataFrame:
        """A row for each segment that counts."""
        at = f"{self.path}/commits"
        return self.spark.read.schema(COMMITS).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], COMMITS)

    def _table(self, name: str, segments: list[int]) -> DataFrame:
        at = f"{self.path}/{name}"
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(at) if segments and exists(self.spark, at) else self.spark.createDataFrame([], SCHEMAS[name])
        return rows.where(F.col("segment").isin(segments))

    def _segments(self) -> list[int]:
        return sorted(r.segment for r in self.commits().select("segment").collect())

    def _states(self, segments: list[int], buckets: list[int] | None = None) -> DataFrame:
        """document_id, times changed, and its last state."""
        changes = self._table("changes", segments)
        changes = changes if buckets is None else changes.where(F.col("bucket").isin(buckets))
        return changes.groupBy("document_id").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("segment", "alive", "print")).alias("s")).select("document_id", "times", "s.segment", "s.alive", "s.print")

    def documents(self) -> DataFrame:
        """document_id, print, segment of the documents that are alive."""
        return self._states(self._segments()).where("alive").select("document_id", "print", "segment")

    def _chunks(self, segments: list[int]) -> DataFrame:
        """segment, block, place, document_id, dl of every stored chunk."""
        each = F.posexplode(F.arrays_zip(F.col("documents").alias("document_id"), "dl")).alias("place", "c")
        return self._table("blocks", segments).select("segment", "block", each).select("segment", "block", "place", "c.document_id", "c.dl")

    def _placed(self, chunks: DataFrame, segments: list[int], how: str) -> DataFrame:
        """Stored blocks with the ``places`` of some of their chunks, which are written first: Spark broadcasts them
        if they are few."""
        places = kept(chunks.groupBy("segment", "block").agg(F.collect_list("place").alias("places")), "places")
        return self._table("blocks", segments).join(places, ["segment", "block"], how)

    def _living(self, segments: list[int]) -> DataFrame:
        """Blocks of the chunks of living documents' last states. Only documents that have changed since
        they were added are looked up."""
        moved = self._states(segments).where("times > 1 or not alive").select("document_id", F.col("segment").alias("last"), "alive")
        dead = self._chunks(segments).join(moved, "document_id").where("not (alive and segment = last)")
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        return self._placed(dead, segments, "left").select(*names, "places").mapInArrow(_without, BLOCKS)

    def _write(self, rows: DataFrame, name: str, segment: int, by: str | None = None) -> None:
        at = f"{self.path}/{name}/segment={segment}"
        if by is None:
            rows.write.mode("overwrite").parquet(at)
        else:
            rows.withColumn("bucket", self._bucket(by)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)

    def refresh(self, chunks: DataFrame | None = None, deleted: DataFrame | None = None) -> dict[str, int] | None:
        """Bring documents up to date: ``chunks`` (document_id, key, text) has all chunks of each of its
        documents, ``deleted`` (document_id) what goes; a document in both stays. What is unchanged is
        not touched. Counts of the segment, None if nothing changed. Rows without document_id or key stay out."""
        spark, segments = self.spark, self._segments()
        shared_folder(spark)
        chunks = spark.createDataFrame([], "document_id bigint, key bigint, text string") if chunks is None else chunks.select("document_id", "key", "text").where("document_id is not null and key is not null")
        deleted = spark.createDataFrame([], "document_id bigint") if deleted is None else deleted.select("document_id").distinct()
        cells = [F.col("key"), F.coalesce("text", F.lit(""))]
        sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
        given = settled(chunks.groupBy("document_id").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("print")))
        if segments:
            deleted = settled(deleted)
            named = given.select("document_id").unionByName(deleted)
            homes = [r[0] for r in named.select(self._bucket("document_id")).distinct().collect()]  # at most ``buckets`` numbers
            live = self._states(segments, homes).where("alive")
            fresh = given.join(live.select("document_id", "print"), ["document_id", "print"], "left_anti").withColumn("alive", F.lit(True))
            gone = deleted.join(live, "document_id", "left_semi").join(given, "document_id", "left_anti").select("document_id", F.lit(None).cast("string").alias("print"), F.lit(False).alias("alive"))
            changes = settled(fresh.unionByName(gone))
            changed = chunks.join(changes.where("alive"), "document_id", "left_semi")
        else:  # all that is given is new, and nothing is there to go
            changes, changed = given.withColumn("alive", F.lit(True)), chunks
        if changes.isEmpty():
            return None
        segment = max(segments, default=0) + 1
        words = changed.select("document_id", "key", tokens(F.col("text")).alias("tokens"))
        self._write(words.select("document_id", "key", F.size("tokens").alias("dl"), "tokens", F.lit(None).cast("array<long>").alias("tf")).mapInArrow(_blocks, BLOCKS), "blocks", segment)
        delta = self._table("blocks", [segment]).mapInArrow(R._frequencies, "token string, df long, dl long").where("token is not null").select("token", "df")
        sizes = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        plus, minus, replaced = sizes(self._chunks([segment])), (0, 0), 0
        if segments:
            old = settled(changes.select("document_id").join(live.select("document_id", "segment"), "document_id"))  # what to retract
            former = self._chunks(segments).join(old, ["document_id", "segment"], "left_semi")
            minus, replaced = sizes(former), old.count()
            delta = delta.unionByName(self._placed(former, segments, "inner").select("dl", "terms", "starts", "at", "places").mapInArrow(_retracted, "token string, df long"))
        self._write(delta.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0"), "terms", segment)
        self._write(changes, "changes", segment, "document_id")
        told = changes.agg(F.count_if("alive").alias("changed"), F.count_if(~F.col("alive")).alias("deleted")).first()
        spark.createDataFrame([(segment, plus[0] - minus[0], plus[1] - minus[1], told.changed - replaced)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return {"segment": segment, "changed": told.changed, "deleted": told.deleted, "chunks": plus[0] - minus[0]}

    def idf(self, config: EngineConfig = DEFAULT) -> DataFrame:
        """token, df, idf of the terms of living chunks; no block is read."""
        return self._idf(self._segments(), config)

    def _idf(self, segments: list[int], config: EngineConfig) -> DataFrame:
        df = self._table("terms", segments).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        return R.idf(df, self._totals(), config)

    def _totals(self) -> DataFrame:
        return self.commits().agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("chunks")).alias("avgdl"))

    def index(self, config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
        """The tables of ``bm25_index``, of living chunks."""
        segments = self._segments()
        blocks = self._living(segments)
        return R.block_tables(blocks) | {"idf": self._idf(segments, config), "totals": self._totals()}

    def search(self, queries: DataFrame, k: int, config: EngineConfig = DEFAULT) -> DataFrame:
        return R.bm25_search(self.index(config), queries, k, config)

    def compacted(self, path: str) -> LivingIndex:
        """An index of one segment with the living chunks, elsewhere; this one stays as it is for its readers."""
        segments, other = self._segments(), LivingIndex(self.spark, path, self.buckets)
        other._write(self._living(segments), "blocks", 1)
        other._write(self._table("terms", segments).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0"), "terms", 1)
        other._write(self._states(segments).where("alive").select("document_id", "print", "alive"), "changes", 1, "document_id")
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("chunks", "words", "documents")]
        self.commits().agg(*sums).select(F.lit(1).alias("segment"), "chunks", "words", "documents").coalesce(1).write.mode("append").parquet(f"{path}/commits")
        return other

    def drop(self) -> None:
        delete_folder(self.spark, self.path)
