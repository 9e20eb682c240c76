"""Judgment cache: a Parquet table keyed by a hash of what a judgment depends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def cache_key(req_text: Column, unit_text: Column, model: Column, prompt_version: Column, backend: Column) -> Column:
    """SNK-6: SHA-256 of the parts joined by U+001F; any part that differs gives another key."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in (req_text, unit_text, model, prompt_version, backend)]), 256)


def hits(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """JOIN-10: pairs with their cached payload; ids come from the live row."""
    return pairs.join(cached.select("key", "payload"), "key")


def misses(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    return pairs.join(cached.select("key"), "key", "left_anti")


def put(judged: DataFrame, path: str) -> None:
    judged.select("key", "payload").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Latest append wins nothing: equal keys hold equal judgments, and one is kept."""
    return spark.read.schema("key string, payload string").parquet(path).dropDuplicates(["key"])
