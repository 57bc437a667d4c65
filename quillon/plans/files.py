"""Queries over files: what is written from the tables is read back as a user's own would be.

Spark's text, CSV, JSON and binary readers list and split the files, on any file system.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import inn as N
from quillon.operators import registry as S
from quillon.plans import sql as Q
from quillon.plans.catalogue import ORACLES, _named, joined, query
from quillon.sources import files
from quillon.sources import tables as B
from quillon.sources.stored import new_folder


@query("s5_question_lists", "", "SELECT item_id::VARCHAR AS question_id, '\"' || coalesce(text, '') || '\"; вопрос' AS question, 'акт ' || item_id || ',решение № ' || item_id % 25 AS expected_documents, item_id % 2 = 0 AS needs_expert_validation, '' AS notes FROM benchmark")
def _(spark, sf):
    """Questions as ``;`` lists behind a byte-order mark, with quotes and semicolons in them."""
    n = F.col("item_id")
    expected = F.concat(F.lit("акт "), n, F.lit(" || решение № "), n % 25, F.lit("|"))
    question = F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('"; вопрос'))
    made = B.read(spark, sf, "benchmark").select(n.cast("string").alias("﻿question_id"), question.alias("question"), expected.alias("expected_documents"), (n % 2 == 0).cast("string").alias("needs_expert_validation"))
    path = new_folder(spark, "questions")
    made.write.options(sep=";", header=True, escape='"').csv(path)
    return files.load_questions(spark, path).select("question_id", "question", joined("expected_documents").alias("expected_documents"), "needs_expert_validation", "notes")


@query("s6_vocabulary_file", "named", f"SELECT DISTINCT inn FROM (SELECT unnest([{', '.join(Q.q(n) for n in N.ALIASES)}]) AS inn UNION ALL SELECT name || ' ' || document_id % 40 FROM named)")
def _(spark, sf):
    path = new_folder(spark, "vocabulary")
    new = _named(spark, sf).select(F.concat("name", F.lit(" "), F.col("document_id") % 40).alias("inn"))
    files.save_vocabulary(N.registered(N.vocabulary(spark), new), path)
    return files.load_vocabulary(spark, path)


@query("s7_source_lists", "", "SELECT DISTINCT 'src ' || source AS source_id, length(source) % 2 = 0 AS enabled, 'rss' AS discovery, 'https://example.org/' || source || '#top' AS url FROM documents WHERE source IS NOT NULL")
def _(spark, sf):
    """An item for every source, with a comment, quotes and a list in it."""
    s = F.col("source")
    item = F.concat(F.lit("  - id: 'src "), s, F.lit("'  # a source\n    enabled: "), (F.length(s) % 2 == 0).cast("string"), F.lit('\n    discovery: list\n    topics:\n      - one two\n      - three\n    discovery: "rss"\n    url: https://example.org/'), s, F.lit("#top"))
    path = new_folder(spark, "sources")
    B.read(spark, sf, "documents").select("source").where("source is not null").distinct().select(item.alias("value")).write.text(path)
    return files.load_source_list(spark, path)


@query("s8_cases", "", "SELECT item_id AS id, text AS question, [item_id % 3, item_id % 5]::VARCHAR AS expected FROM benchmark")
def _(spark, sf):
    """Cases as JSON arrays over many lines, a hundred a file."""
    path = new_folder(spark, "cases")
    case = F.struct(F.col("item_id").alias("id"), F.col("text").alias("question"), F.array(F.col("item_id") % 3, F.col("item_id") % 5).alias("expected"))
    lists = B.read(spark, sf, "benchmark").groupBy(F.floor(F.col("item_id") / 100).alias("list")).agg(F.to_json(F.collect_list(case), {"pretty": "true"}).alias("value"))
    lists.write.partitionBy("list").text(path)
    cases = files.load_cases(spark, path, "id bigint, question string, expected array<bigint>")
    return cases.select("id", "question", F.concat(F.lit("["), F.array_join(F.col("expected").cast("array<string>"), ", "), F.lit("]")).alias("expected"))


@query("s11_report_file", "reg", "SELECT status, source_tier, count(*) AS documents, sum(size_bytes)::BIGINT AS bytes FROM reg GROUP BY ALL")
def _(spark, sf):
    path = new_folder(spark, "report")
    report = B.registry(spark, sf).groupBy("status", "source_tier").agg(F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes"))
    files.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


def _without_file(spark, sf):
    """Registry rows with a folder of raw files each, of which some aren't there."""
    d = B.registry(spark, sf).withColumn("raw", (F.col("document_id") % 50).cast("string"))
    path = new_folder(spark, "raw")
    d.where("document_id % 50 % 7 <> 0").select("raw", F.col("sha256").alias("value")).repartition("raw").write.partitionBy("raw").text(path)
    return files.missing_files(d, "raw", [path], "raw=([^/]+)/[^/]+$")


@query("s13_missing_files", "reg", "SELECT document_id FROM reg WHERE document_id % 50 % 7 = 0 OR document_id IS NULL")
def _(spark, sf):
    return _without_file(spark, sf).select("document_id")


@query("r21_health_files", "", f"SELECT * FROM ({ORACLES['r21_health']}) UNION ALL SELECT 'raw_files', CASE WHEN count(*) = 0 THEN 'OK' ELSE 'WARN' END, count(*), 0 FROM documents WHERE doc_id % 50 % 7 = 0 OR doc_id IS NULL")
def _(spark, sf):
    c = B.chunks(spark, sf)
    return S.health(B.registry(spark, sf), c, c, B.vectors(spark, sf), _without_file(spark, sf))
