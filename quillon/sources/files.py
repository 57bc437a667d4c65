"""File sources and sinks: question lists, vocabularies, cases, source lists,
indexes, reports, raw files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "question_id string, category string, question string, expected_documents string, expected_topics string, expected_answer_notes string, needs_expert_validation string"


def _parts(name: str):
    return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated questions with '|'-separated lists; a byte-order mark is taken off,
    and a doubled quote inside quotes is one."""
    raw = spark.read.options(sep=";", header=True, multiLine=True, encoding="UTF-8", escape='"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip('"') for c in raw.columns])
    names = [f.split()[0] for f in QUESTIONS.split(", ")]
    raw = raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names])
    return raw.select(
        "question_id", "category", "question", _parts("expected_documents").alias("expected_documents"), _parts("expected_topics").alias("expected_topics"),
        F.coalesce("expected_answer_notes", F.lit("")).alias("notes"), (F.coalesce("needs_expert_validation", F.lit("true")) == "true").alias("needs_expert_validation"),
    )


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """inn: the strings of a JSON array; a missing or broken file gives no rows."""
    none = spark.createDataFrame([], "inn string")
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # the path isn't there
        if "PATH_NOT_FOUND" in str(e):
            return none
        raise
    names = F.from_json("value", "array<string>")
    return text.select(F.explode(names).alias("inn")).where("inn is not null")


def save_vocabulary(known: DataFrame, path: str) -> None:
    known.agg(F.to_json(F.array_sort(F.collect_set("inn"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def load_source_list(spark: SparkSession, path: str) -> DataFrame:
    """source_id, enabled, discovery, url of YAML lists, an item a row.

    Takes plain ``key: value`` lines under ``- key: value`` items; comments, quotes and
    lists inside an item are passed over, the last value of a key counts.  Files are
    read in the tasks, each as a whole.
    """
    files = spark.read.text(path, wholetext=True)
    items = F.filter(F.split("value", r"(?m)^[ \t]*- (?=[A-Za-z_]+[ \t]*:(?:[ \t]|$))"), lambda _, i: i > 0)
    plain = files.select(F.explode(items).alias("item")).select(F.regexp_replace("item", r"(?m)[ \t]#.*$", "").alias("item"))
    rule = r"(?m)^[ \t]*([A-Za-z_]+)[ \t]*:[ \t]*(.*?)[ \t\r]*$"
    pairs = plain.select(F.regexp_extract_all("item", F.lit(rule), F.lit(1)).alias("keys"), F.regexp_extract_all("item", F.lit(rule), F.lit(2)).alias("values"))
    pairs = pairs.select(F.arrays_zip("keys", "values").alias("p"))

    def last(key: str, otherwise: str = "") -> Column:
        said = F.try_element_at(F.filter("p", lambda x: x["keys"] == key), F.lit(-1))["values"]
        return F.coalesce(F.regexp_replace(said, r"""^["']+|["']+$""", ""), F.lit(otherwise))

    name = F.coalesce(F.nullif(last("id"), F.lit("")), last("source_id"))
    return pairs.select(name.alias("source_id"), (last("enabled", "true") != "false").alias("enabled"), last("discovery").alias("discovery"), last("url").alias("url"))


def save_index(path: str, **tables: DataFrame) -> None:
    """Each table of an index as Parquet under ``path``."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame] | None:
    """The tables of an index, None where one is missing or broken."""
    try:
        return {n: spark.read.parquet(f"{path}/{n}") for n in names}
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE")):
            return None
        raise


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def missing_files(registry: DataFrame, column: str, folders: list[str], name: str = "([^/]+)$") -> DataFrame:
    """Rows whose file is in none of the folders; file names only, no contents.  ``name`` takes a
    file's name, or its folder's, from its path.  A row without a name is missing."""
    spark = registry.sparkSession
    there = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f).select(F.regexp_extract("path", name, 1).alias("__file")) for f in folders])
    return registry.join(there.distinct(), F.regexp_extract(column, "[^/]+$", 0) == F.col("__file"), "left_anti")
