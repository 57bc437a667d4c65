"""Queries over what is stored and changed: tables, and the index that lives on."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators.living import LivingIndex
from quillon.plans import retrieval as P
from quillon.plans import sql as Q
from quillon.plans.catalogue import UPSERT, query
from quillon.sources import tables as B
from quillon.sources.stored import StoredRegistry, StoredTable, new_folder


@query("r4_stored_upsert", "reg", UPSERT)
def _(spark, sf):
    """Statuses as a stored table; a batch that names each tenth document twice."""
    d = B.registry(spark, sf).select("document_id", "status")
    kept = StoredTable(spark, new_folder(spark, "status"), "document_id", d.schema)
    kept.upsert(d.withColumn("seq", F.lit(0)), "seq")
    some = d.where("document_id % 10 = 3")
    kept.upsert(some.withColumns({"status": F.lit("first"), "seq": F.lit(1)}).unionByName(some.withColumns({"status": F.lit("second"), "seq": F.lit(2)})), "seq")
    return kept.read()


def _registry(spark, sf):
    d = B.registry(spark, sf).select("document_id", "title", "short_title", "status")
    kept = StoredRegistry(spark, new_folder(spark, "registry"), d.schema)
    kept.upsert(d.withColumn("seq", F.lit(0)), "seq")
    chunks = B.chunks(spark, sf).select("document_id", "ordinal", "text")
    kept.chunks.replace(chunks, chunks)
    return kept, d


@query("r5_stored_chunks", "chunk reg", """SELECT document_id, ordinal, sha256(text) AS text_hash FROM chunk WHERE document_id % 10 <> 5
UNION ALL SELECT document_id, unnest([0, 1, 2]), sha256(unnest([title, short_title, 'end'])) FROM reg WHERE document_id % 20 = 5""")
def _(spark, sf):
    """Chunks replaced by a list of three for some documents, by an empty one for others."""
    kept, d = _registry(spark, sf)
    three = F.when(F.col("document_id") % 20 == 5, F.array("title", "short_title", F.lit("end"))).otherwise(F.array().cast("array<string>"))
    kept.replace_chunks(d.where("document_id % 10 = 5").select("document_id", three.alias("texts")))
    return kept.chunks.read().select("document_id", "ordinal", F.sha2("text", 256).alias("text_hash"))


@query("r8_stored_prune", "chunk reg", "SELECT document_id, status <> 'active' AS stale, CASE WHEN status = 'active' THEN coalesce(m, 0) ELSE 0 END AS n_chunks FROM reg LEFT JOIN (SELECT document_id, count(*) AS m FROM chunk GROUP BY ALL) USING (document_id)")
def _(spark, sf):
    """Documents that aren't active go, with their chunks; what is left, and the ids that went."""
    kept, d = _registry(spark, sf)
    stale = kept.prune(d.where("status = 'active'"))
    n = kept.chunks.read().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    left = kept.documents.read().select("document_id", F.lit(False).alias("stale")).unionByName(stale.select("document_id", F.lit(True).alias("stale")))
    return left.join(n, "document_id", "left").select("document_id", "stale", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query("r22_metadata_upsert", "reg", "SELECT 'documents' AS key, (SELECT count(*) FROM reg)::VARCHAR AS value UNION ALL SELECT 'status:' || status, count(*)::VARCHAR FROM reg GROUP BY status UNION ALL SELECT 'schema_version', '2'")
def _(spark, sf):
    """Key-value facts about the registry, stored, then brought up to date."""
    d = B.registry(spark, sf).select("document_id", "status")
    kept = StoredTable(spark, new_folder(spark, "metadata"), "key", "key string, value string", parts=4)

    def told(rows, version):
        one = rows.agg(F.lit("documents").alias("key"), F.count(F.lit(1)).cast("string").alias("value"))
        each = rows.groupBy(F.concat(F.lit("status:"), F.col("status")).alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
        named = spark.range(1).select(F.lit("schema_version").alias("key"), F.lit(version).alias("value"))
        return one.unionByName(each).unionByName(named).withColumn("seq", F.lit(1))

    kept.upsert(told(d.where("document_id % 2 = 0"), "1"), "seq")
    kept.upsert(told(d, "2"), "seq")
    return kept.read()


@query("k8_stored_vectors", "", "SELECT vec_id AS key, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE vec_id % 7 <> 0")
def _(spark, sf):
    """Vectors stored by key, some replaced, some deleted."""
    v = B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label", "embedding")
    kept = StoredTable(spark, new_folder(spark, "vectors"), "key", v.schema)
    kept.upsert(v.withColumn("seq", F.lit(0)), "seq")
    kept.upsert(v.where("key % 5 = 0").withColumns({"label": F.lit(-1), "seq": F.lit(1)}), "seq")
    kept.delete(v.where("key % 7 = 0"))
    return kept.read().select("key", "label", F.round(F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


#: The chunks that are left after ``_living``.
LEFT = "FROM body b JOIN reg r USING (document_id) WHERE b.document_id % 10 <> 9"


def _left(needs: str, sql: str) -> str:
    return Q.with_(needs, sql).replace("FROM body b JOIN reg r USING (document_id)", LEFT)


def _living(spark, sf) -> LivingIndex:
    """An index of older texts, brought up to date: new documents, changed ones, deleted ones."""
    now = P.chunk_texts(spark, sf)
    old = now.where("document_id % 10 <> 7").withColumn("text", F.when(F.col("document_id") % 10 == 3, F.reverse("text")).otherwise(F.col("text")))
    live = LivingIndex(spark, new_folder(spark, "index"))
    live.refresh(old)
    live.refresh(now.where("document_id % 10 in (3, 7)"), now.where("document_id % 10 = 9").select("document_id"))
    return live


@query("k1_living_idf", "", _left("idf", "SELECT token, df, round(idf, 6) AS idf FROM idf"))
def _(spark, sf):
    return _living(spark, sf).idf().select("token", "df", F.round("idf", 6).alias("idf"))


@query("k2_living_search", "", _left("lex", "SELECT query, key, score, rank FROM lex"))
def _(spark, sf):
    return _living(spark, sf).search(P.asked(spark, sf).select("query", "text"), 40)


@query("i6_living_refresh", "reg", "SELECT document_id FROM reg WHERE document_id % 10 <> 9")
def _(spark, sf):
    """What is alive after the refreshes, and after one more that has nothing new."""
    live = _living(spark, sf)
    now = P.chunk_texts(spark, sf).where("document_id % 10 <> 9")
    if live.refresh(now) is not None:
        raise AssertionError("a refresh without changes has written a segment")
    return live.documents().select("document_id")
