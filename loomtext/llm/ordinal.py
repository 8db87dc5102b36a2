"""Positions in a sorted order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize, shuffle_width

#: Bits of ``monotonically_increasing_id`` below the number of the partition.
_ROWS = 33


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with i (0-based position in its group, by ``order``) and n (rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size is spread over many
    tasks; a row's position is its place in its range plus the rows of its group in earlier
    ranges. Nulls come first, strings ascend by their UTF-8 bytes; rows that ``order`` leaves
    tied take any order, but a fixed one. ``df`` must be a table (it is read twice) and may
    not have columns named i, n, at_ or part_. Returns a table of the shared folder.
    """
    spark = df.sparkSession
    # The last key spreads repeated rows; a table's rows keep their ids from read to read.
    keyed = df.withColumn("at_", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "at_")]
    ranged = keyed.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by)
    placed = materialize(ranged.withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("at_", _ROWS)), name)
    # At most one row for each group and one for each boundary between ranges.
    parts = placed.groupBy(group, "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("held_"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select(F.col(group).alias("g_"), F.col("part_").alias("p_"), "first_", F.coalesce(F.sum("held_").over(before), F.lit(0)).alias("off_"), F.sum("held_").over(whole).alias("n")), f"{name}-parts")
    out = placed.join(parts, placed[group].eqNullSafe(parts["g_"]) & (placed["part_"] == parts["p_"]))
    return out.select(*df.columns, (F.col("off_") + F.col("at_") - F.col("first_")).alias("i"), "n")
