"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import ACT_NUMBER, matches_expected, significant_words


def outcomes(asked: DataFrame, results: DataFrame, relevant: DataFrame) -> DataFrame:
    """asked(request), results(request, rank, document_id, title, source_tier), relevant(request,
    document_id) -> ranks of hits, first hit, titles in order, tiers."""
    hit = results.join(relevant.withColumn("hit", F.lit(True)), ["request", "document_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    by = hit.groupBy("request").agg(
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("rank")))).alias("ranks"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"), F.count(F.lit(1)).alias("retrieved"),
    )
    return asked.select("request").join(by, "request", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def metrics(found: DataFrame, *by: str) -> DataFrame:
    """Recall at 5 and 10, mean reciprocal rank, questions without a hit; zero for no questions."""
    share = lambda k: F.coalesce(F.round(F.avg(F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0)), 3), F.lit(0.0))
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), share(5).alias("recall_at_5"), share(10).alias("recall_at_10"),
        F.coalesce(F.round(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), 3), F.lit(0.0)).alias("mrr"), F.count_if(F.col("first_hit").isNull()).alias("no_hit"),
    )


def tier_mix(results: DataFrame) -> DataFrame:
    return results.groupBy("source_tier").agg(F.count(F.lit(1)).alias("n"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers(request, statements, cited, ids, valid_ids, abstained): shares, null where
    nothing is counted; abstentions count over all."""
    share = lambda a, b: F.when(F.sum(b) > 0, F.round(F.sum(a) / F.sum(b), 3))
    return answers.agg(
        F.count(F.lit(1)).alias("answers"), share("cited", "statements").alias("coverage"), share("valid_ids", "ids").alias("validity"),
        F.when(F.count(F.lit(1)) > 0, F.round(F.count_if("abstained") / F.count(F.lit(1)), 3)).alias("abstention"),
    )


def report(found: DataFrame) -> DataFrame:
    return found.select("request", "first_hit", "ranks", F.slice("titles", 1, 5).alias("titles"))


def candidates(expected: DataFrame, items: DataFrame) -> DataFrame:
    """expected(a, x), items(b, y, number) -> a, b: pairs that may match, each once.

    Half of the n words of x, at least ceil(n / 2), must stand in y. So y has one of the
    n - ceil(n / 2) + 1 rarest words of x, and as many words as must be shared: a word
    of many items is looked up only for texts without enough rarer ones. An x that
    names an act's number meets the items of that number.
    """
    number = F.regexp_extract("x", ACT_NUMBER, 1)
    e = expected.select("a", "x", number.alias("number"), significant_words(F.col("x")).alias("w"))
    n = F.size("w")
    asked = e.where("number = '' and size(w) > 0").select("a", "w", F.ceil(n / 2).cast("int").alias("need"), n.alias("n"))
    held = items.select("b", significant_words(F.col("y")).alias("w")).where("size(w) > 0")
    words = held.select("b", F.size("w").alias("m"), F.explode("w").alias("word"))
    rarity = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    placed = asked.select("a", "need", "n", F.explode("w").alias("word")).join(rarity, "word", "left")  # a word that no item has is the rarest
    ranked = placed.groupBy("a", "need", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("w"))
    first = ranked.select("a", "need", F.explode(F.slice("w", F.lit(1), F.col("n") - F.col("need") + 1)).alias("w")).select("a", "need", F.col("w.word").alias("word"))
    met = first.join(words, "word").where("m >= need").select("a", "b").distinct()
    named = e.where("number <> ''").select("a", "number").join(items.where("number <> ''").select("b", "number"), "number").select("a", "b").distinct()
    return met.unionByName(named)


def expected_matches(expected: DataFrame, items: DataFrame) -> DataFrame:
    """expected(a, x), items(b, y, number) -> a, b: where an item is what was expected."""
    pairs = candidates(expected, items).join(expected.select("a", "x"), "a").join(items.select("b", "y", "number"), "b")
    return pairs.where(matches_expected(F.col("x"), F.col("y"), F.col("number"))).select("a", "b")
