"""Keyed text batches: assembling parts, quality checks, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(source: Column, target: Column, longest: int = 4000) -> Column:
    """Names of the checks that a target's paragraphs fail against those of the source."""
    return F.array_compact(F.array(
        F.when(F.size(source) != F.size(target), "count"),
        F.when(F.exists(target, lambda s: F.trim(s) == ""), "empty"),
        F.when(F.exists(target, lambda s: F.length(s) > longest), "long"),
        F.when(F.size(F.array_distinct(target)) < F.size(target), "repeated"),
    ))


def merge_parts(parts: DataFrame, id_: str = "id", paragraphs: str = "paragraphs") -> DataFrame:
    """(key, paragraphs, n_parts, complete) from ids ``key`` or ``key#n``: parts joined in numeric order, complete if they are 1 .. n."""
    p = parts.select(F.substring_index(id_, "#", 1).alias("key"), F.when(F.instr(id_, "#") > 0, F.substring_index(id_, "#", -1).cast("int")).otherwise(1).alias("part"), F.col(paragraphs).alias("ps"))
    g = p.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "ps"))).alias("all"), F.count("*").alias("n_parts"), F.count_distinct("part").alias("d"), F.max("part").alias("last"), F.min("part").alias("first"))
    return g.select("key", F.flatten(F.transform("all", lambda s: s["ps"])).alias("paragraphs"), "n_parts", ((F.col("first") == 1) & (F.col("last") == F.col("n_parts")) & (F.col("d") == F.col("n_parts"))).alias("complete"))
