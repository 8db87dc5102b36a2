"""Append-only event logs with corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def voided(events: DataFrame, log: str, line: str, supersedes: str, is_correction: Column) -> DataFrame:
    """(log, line) of records that a later correction voids; corrections don't void corrections."""
    marks = events.where(is_correction & (F.col(supersedes) < F.col(line))).select(F.col(log), F.col(supersedes).alias(line)).distinct()
    return events.where(~is_correction).join(marks, [log, line], "left_semi")


def without_voided(events: DataFrame, log: str, line: str, supersedes: str, is_correction: Column) -> DataFrame:
    """The records that count: no corrections, nothing that they void."""
    marks = events.where(is_correction & (F.col(supersedes) < F.col(line))).select(F.col(log), F.col(supersedes).alias(line)).distinct()
    return events.where(~is_correction).join(marks, [log, line], "left_anti")


def bad_corrections(events: DataFrame, log: str, line: str, supersedes: str, is_correction: Column) -> DataFrame:
    """(log, line, why) of corrections that point ahead, at nothing, at a correction, or at a record voided before."""
    c = events.where(is_correction).select(log, line, F.col(supersedes).alias("to_"))
    target = events.select(F.col(log), F.col(line).alias("to_"), is_correction.alias("target_is_correction"))
    first = c.where(F.col("to_") < F.col(line)).groupBy(log, "to_").agg(F.min(line).alias("first_"))
    j = c.join(target, [log, "to_"], "left").join(first, [log, "to_"], "left")
    why = F.when(F.col("to_").isNull() | F.col("target_is_correction").isNull(), "no such line").when(F.col("to_") >= F.col(line), "points ahead").when(F.col("target_is_correction"), "corrects a correction").when(F.col(line) > F.col("first_"), "voided before")
    return j.select(log, line, why.alias("why")).where("why IS NOT NULL")


def flatten_json(props: Column) -> Column:
    """Top-level keys of a JSON object with ``data_`` before them; nested values stay JSON."""
    m = F.from_json(props, "map<string,string>")
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit("data_"), e["key"]), e["value"])))
