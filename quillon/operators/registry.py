"""The document registry: filters, search, upserts, pruning, counts, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COUNTABLE = ("source_authority", "document_type", "status", "version_status", "source_tier", "download_status")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def listed(documents: DataFrame, authority: str = "", kind: str = "", search: str = "") -> DataFrame:
    """Documents by equality filters (empty: none) and a literal search, which
    ignores the case of ASCII letters only, in title, short title and number."""
    out = documents
    if authority:
        out = out.where(F.col("source_authority") == authority)
    if kind:
        out = out.where(F.col("document_type") == kind)
    if search:
        needle = F.lit(search.translate(str.maketrans(UPPER, LOWER)))
        found = lambda c: F.contains(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), needle)
        out = out.where(found(F.col("title")) | found(F.col("short_title")) | found(F.col("document_number")))
    return out.orderBy(F.asc_nulls_first("source_tier"), F.asc_nulls_first("document_number"), "document_id")


def by_id(documents: DataFrame, key: str, value) -> DataFrame:
    return documents.where(F.col(key) == value)


def by_hash(documents: DataFrame, digest: str) -> DataFrame:
    return documents.where(F.col("sha256") == digest).orderBy("document_id").limit(1)


def upserted(old: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``batch`` replace rows of ``old`` with their key; the last of a batch wins."""
    new = batch.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n", order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replaced_chunks(chunks: DataFrame, document_id, texts: DataFrame) -> DataFrame:
    """Chunks with those of one document replaced by texts(document_id, text array), numbered by place."""
    new = texts.where(F.col("document_id") == document_id).select("document_id", F.posexplode("text").alias("ordinal", "text"))
    return chunks.select("document_id", "ordinal", "text").where(F.col("document_id") != document_id).unionByName(new)


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, n_chunks for every document."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return documents.select("document_id").join(n, "document_id", "left").select("document_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def with_value(rows: DataFrame, key: str, at, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(key) == at, value).otherwise(F.col(column)))


def stale(documents: DataFrame, keep: DataFrame) -> DataFrame:
    return documents.join(keep.select("document_id"), "document_id", "left_anti").select("document_id")


def pruned(documents: DataFrame, chunks: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents that aren't in ``keep``."""
    kept = keep.select("document_id").distinct()
    return documents.join(kept, "document_id", "left_semi"), chunks.join(kept, "document_id", "left_semi")


def numbers(documents: DataFrame) -> DataFrame:
    return documents.where("document_number is not null and document_number <> ''").select("document_number").distinct()


def counts_by(documents: DataFrame, column: str) -> DataFrame:
    """value, n; null and empty values together are ``unknown``."""
    if column not in COUNTABLE:
        raise ValueError(f"not a countable column: {column}")
    return documents.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def counts_by_year(documents: DataFrame) -> DataFrame:
    year = F.coalesce(F.date_format("adoption_date", "yyyy"), F.lit("unknown"))
    return documents.groupBy(year.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: totals and guarded averages."""
    d = documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("raw_bytes"), F.max("download_date").alias("last_update"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))
    share = lambda a, b, n: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), n)).otherwise(0.0)
    both = d.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumns({"chunks_per_document": share("chunks", "documents", 2), "tokens_per_chunk": share("tokens", "chunks", 1)})


def topics(documents: DataFrame) -> DataFrame:
    """Topics by falling count."""
    return documents.select(F.explode("topic").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def overview(documents: DataFrame, rows: int = 600) -> DataFrame:
    """The registry page: the first rows in order, titles cut, dates as day.month.year."""
    first = documents.orderBy(F.asc_nulls_first("source_tier"), F.asc_nulls_first("document_number"), "document_id").limit(rows)
    return first.select("document_id", F.substring("title", 1, 140).alias("title"), F.coalesce(F.date_format("adoption_date", "dd.MM.yyyy"), F.lit("")).alias("adopted"), "source_tier", "status")


def sidebar(documents: DataFrame) -> DataFrame:
    """One row of indicators."""
    eaeu = F.col("source_authority") == "EAEU"
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(eaeu).alias("eaeu"), F.count_if(~eaeu).alias("other"),
        F.count_if(F.col("source_tier").isin("TIER_1", "TIER_2") & eaeu).alias("binding"), F.count_if(F.col("status") == "superseded").alias("superseded"),
    )


def run_log(events: DataFrame) -> DataFrame:
    """events(run_id, stage, started, finished, status, seq): the latest state of each run."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("stage", "status"), "seq").alias("s"), F.min("started").alias("started"), F.max("finished").alias("finished")).select("run_id", "s.stage", "s.status", "started", "finished")


def last_run(events: DataFrame) -> DataFrame:
    return run_log(events).orderBy(F.desc("run_id")).limit(1)


def health(documents: DataFrame, chunks: DataFrame, bm25_entries: DataFrame, points: DataFrame, without_file: DataFrame | None = None) -> DataFrame:
    """check, severity, found, expected: one row a check; ``raw_files`` where the documents without a raw file are given."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("one", F.lit(1))
    loaded = documents.where("download_status = 'ok'")
    bare = loaded.join(chunks.select("document_id"), "document_id", "left_anti")
    loads = documents.agg(F.count_if(F.col("download_status") == "manual_required").alias("manual"), F.count_if(F.col("download_status") == "failed").alias("failed"), F.count(F.lit(1)).alias("documents")).withColumn("one", F.lit(1))
    row = loads.join(n(chunks, "chunks"), "one").join(n(bare, "bare"), "one").join(n(bm25_entries, "entries"), "one").join(n(points, "points"), "one")

    def check(name: str, found: str, wanted: Column, bad: str, fatal: Column) -> Column:
        level = F.when(fatal, "FAIL").when(F.col(found) == wanted, "OK").otherwise(bad)
        return F.struct(F.lit(name).alias("check"), level.alias("severity"), F.col(found).cast("long").alias("found"), wanted.cast("long").alias("expected"))

    zero, never = F.lit(0), F.lit(False)
    checks = F.array(
        F.struct(F.lit("documents").alias("check"), F.when(F.col("documents") > 0, "OK").otherwise("FAIL").alias("severity"), F.col("documents").alias("found"), F.col("documents").alias("expected")),
        check("manual", "manual", zero, "WARN", never), check("failed", "failed", zero, "WARN", never), check("without_chunks", "bare", zero, "WARN", never),
        check("bm25_entries", "entries", F.col("chunks"), "WARN", F.col("entries") == 0), check("vectors", "points", F.col("chunks"), "WARN", F.col("points") == 0),
    )
    if without_file is not None:
        row = row.join(n(without_file, "gone"), "one")
        checks = F.concat(checks, F.array(check("raw_files", "gone", zero, "WARN", never)))
    return row.select(F.explode(checks).alias("c")).select("c.*")
