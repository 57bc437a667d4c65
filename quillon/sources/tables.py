"""Tables of the engine, derived from the driver's tables with explicit types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import DEFAULT, EngineConfig
from quillon.functions import text as T
from quillon.sources.stored import kept

TYPES = ["council_decision", "college_decision", "expert_committee_recommendation", "guideline", "unknown"]
VERSIONS = ["consolidated", "original_with_known_amendments", "requires_expert_validation"]
OTHERS = ["ICH", "EMA", "WHO", "OTHER"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, times of the documents with several labels, few as a rule; written, so that Spark knows how few."""
    counts = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return kept(counts.where("times > 1"), "repeats")


def registry(spark: SparkSession, sf_dir: str, text: bool = False, only: DataFrame | None = None, status: bool = True) -> DataFrame:
    """One row a document, or one for each of its labels.  Tier, authority, status and the rest follow from
    source, labels and id by fixed rules.  ``only`` (document_id): a few documents, which are broadcast.
    Without ``status`` the rows are the same, but no text is shuffled to meet its label."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    if only is not None:
        docs = docs.join(F.broadcast(only.select(F.col("document_id").alias("doc_id"))), "doc_id", "left_semi")
    n = F.expr("try_cast(substring(source, 4) as int)")
    if status:
        d = docs.join(labels, "doc_id", "left")
    else:
        d = docs.join(_repeats(spark, sf_dir), "doc_id", "left").withColumn("again", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    d = d.withColumn("n", F.coalesce(n, F.lit(0)))
    ten = F.col("n") % 10
    tier = F.when(ten <= 2, "TIER_1").when(ten <= 4, "TIER_2").when(ten <= 7, "TIER_3").when(ten == 8, "TIER_4").otherwise("TIER_5")
    label = F.when(F.col("toxic") == 1, "expired").when(F.col("quality") == 0, "superseded").when(F.col("quality") == 1, "active").otherwise("unknown")
    first = F.substring(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), 1, 160)
    load = F.when(F.col("doc_id") % 17 == 0, "failed").when(F.col("doc_id") % 17 == 1, "manual_required").otherwise("ok")
    columns = {
        "document_id": F.col("doc_id"),
        "title": F.concat(first, F.lit(" № "), F.col("n").cast("string")),
        "short_title": F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Act "), F.col("doc_id").cast("string"))),
        "document_number": F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("n").cast("string")),
        "document_type": _pick(TYPES, F.col("doc_id") % 5),
        "source_tier": tier,
        "source_authority": F.when(ten >= 8, _pick(OTHERS, F.col("n") % 4)).otherwise("EAEU"),
        "status": label if status else None,
        "version_status": _pick(VERSIONS, F.col("doc_id") % 3),
        "language": F.coalesce("lang", F.lit("")),
        "adoption_date": F.when(F.col("doc_id") % 13 != 0, F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") % 5000).cast("int"))),
        "download_date": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")),
        "download_status": load,
        "sha256": F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256),
        "size_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"),
        "topic": F.array_compact(F.array("lang", "source")),
        "source_url": F.concat(F.lit("https://acts.example/"), F.col("doc_id").cast("string")),
    }
    if text:
        columns["text"] = F.coalesce("text", F.lit(""))
    return d.select(*[c.alias(k) for k, c in columns.items() if c is not None])


def blocks(text: Column, size: int) -> Column:
    """Array of (block, text): lines packed by the place of their first character,
    ``size`` characters a block.  Linear in the text, which a fold of arrays is not;
    nothing is shuffled, and nothing goes to Python.

    Line ends of the joined lines never touch, so two of them can mark where a block
    begins: at the first line end in ``size`` characters, each of which stands before a line.
    """
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(" \t\r\f\x0b")))
    lines = F.array_join(F.filter(stripped, lambda line: line != ""), "\n")
    pieces = F.regexp_extract_all(F.concat(F.lit("\n"), lines), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))

    def packed(p: Column) -> Column:
        numbers = F.array_compact(F.transform(p, lambda x, i: F.when(F.contains(x, F.lit("\n")), i.cast("long"))))
        marked = F.array_join(F.transform(p, lambda x: F.regexp_replace(x, r"\A([^\n]*+)\n", "$1\n\n")), "")
        return F.filter(F.zip_with(numbers, F.filter(F.split(marked, "\n\n"), lambda x: x != ""), lambda n, x: F.struct(n.alias("block"), x.alias("text"))), lambda b: b["text"].isNotNull())

    return T.once(pieces, packed)


CARD_CHARS = 20


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id of the documents that have a chunk: a card, or a text with something in it."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.where((F.length("text") < CARD_CHARS) | F.col("text").rlike(r"[^ \t\n\r\f\x0B]")).select("document_id")


def chunks(spark: SparkSession, sf_dir: str, config: EngineConfig = DEFAULT, only: DataFrame | None = None, status: bool = True) -> DataFrame:
    """Chunks with the document's fields beside them.  Documents of under ``CARD_CHARS``
    characters give one metadata card instead.  ``only`` and ``status`` as for the registry."""
    d = registry(spark, sf_dir, text=True, only=only, status=status)
    card = F.length("text") < CARD_CHARS
    own = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("title").alias("text")))
    c = d.select("*", F.posexplode(F.when(card, own).otherwise(blocks(F.col("text"), config.chunk_chars))).alias("ordinal", "b"), card.alias("is_card"))
    c = c.withColumns({"text": F.col("b.text"), "heading": F.when(F.col("is_card"), T.CARD_HEADING).otherwise(""), "paragraph": F.when(F.col("is_card"), "").otherwise((F.col("ordinal") + 1).cast("string"))})
    none = F.lit("")
    ident = T.chunk_id(F.col("document_id"), [none, none, none, none, none, F.col("paragraph"), none], F.col("text"), F.col("ordinal"))
    return c.select(
        ident.alias("chunk_id"), "document_id", "ordinal", "title", "short_title", "document_number", "source_tier", "source_authority", *["status"] * status, "version_status", "adoption_date", "source_url",
        "is_card", "heading", "paragraph", "text", F.length("text").alias("char_count"), F.greatest(F.lit(1), F.floor(F.length("text") / 3)).cast("int").alias("token_estimate"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point, embedding: the vector of a document's first chunk."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
