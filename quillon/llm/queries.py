"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, archive, codebooks, language, mixing, neardup, packing, pii, quality, sharding, spelling, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_substring": substring.query,
    "op3_language": language.query,
    "op4_hilbert_sharding": sharding.query,
    "op5_personal_data": pii.query,
    "op6_curriculum_mixing": mixing.query,
    "op7_packing": packing.query,
    "op8_quality": quality.query,
    "op9_near_duplicates": neardup.query,
    "op10_nearest": ann.query,
    "op11_archive": archive.query,
    "op12_codebooks": codebooks.query,
    "op13_spelling": spelling.query,
}

#: Where SQL can't express the method, tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_substring": substring.SQL,
    "op6_curriculum_mixing": mixing.SQL,
    "op9_near_duplicates": neardup.SQL,
    "op10_nearest": ann.SQL,
    "op11_archive": archive.SQL,
    "op12_codebooks": codebooks.SQL,
    "op13_spelling": spelling.SQL,
}
