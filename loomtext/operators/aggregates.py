"""Aggregations: rates, distributions, five-number summaries, pivots, contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .written import written


def five_numbers(df: DataFrame, by: list[str], value: str, most_outliers: int = 12) -> DataFrame:
    """n, min, q1, med, q3, max, whiskers at 1.5 interquartile ranges, outliers beyond them, mean, deviation (0 for one row).

    Quartiles interpolate linearly. Outliers are cut to ``most_outliers`` by rank before they are collected.
    """
    q = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    q = q.select("*", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("med"), F.get("q", F.lit(2)).alias("q3")).drop("q")
    q = q.withColumn("lo_", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("hi_", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    rows = df.select(*by, value).join(q.select(*by, "lo_", "hi_"), by)
    inside = rows.where(f"{value} BETWEEN lo_ AND hi_").groupBy(*by).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    out = rows.where(f"{value} < lo_ OR {value} > hi_").withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value))))
    out = out.where(F.col("k_") <= most_outliers).groupBy(*by).agg(F.sort_array(F.collect_list(value), asc=False).alias("outliers"))
    return q.drop("lo_", "hi_").join(inside, by, "left").join(out, by, "left")


def rate_matrix(df: DataFrame, group: str, label: str, key: str, top: int = 14) -> DataFrame:
    """(group, label, rate): share of the group's keys with the label, for the ``top`` labels by their highest rate."""
    total = df.groupBy(group).agg(F.count_distinct(key).alias("total"))
    rate = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count_distinct(key).alias("n")).join(total, group).select(group, label, (F.col("n") / F.col("total")).alias("rate"))
    best = rate.groupBy(label).agg(F.max("rate").alias("best_")).orderBy(F.desc("best_"), label).limit(top)
    return rate.join(best.select(label), label)


def contingency(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).count().na.fill(0)


def vector_mean(df: DataFrame, by: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean vector per group, dimension by dimension, so that partial sums combine before the shuffle."""
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(*by, w.cast("double").alias("w_"), F.posexplode(vec).alias("d_", "x_"))
    sums = rows.groupBy(*by, "d_").agg((F.sum(F.col("x_").cast("double") * F.col("w_")) / F.sum("w_")).alias("m_"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d_", "m_"))), lambda s: s["m_"]).alias("mean"))


def name_like(tokens: DataFrame, least: int = 5, share: float = 0.9) -> DataFrame:
    """(word) of tokens that are capitalised in ``share`` of at least ``least`` occurrences; ``tokens`` has (tok) as written."""
    t = tokens.groupBy(F.lower("tok").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("tok") != F.lower("tok")).alias("caps"))
    return t.where((F.col("n") >= least) & (F.col("caps") >= share * F.col("n"))).select("word")


def pair_gaps(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, pairs, valued, gap): unordered pairs of a group's rows, those with both values, and the sum of their absolute differences.

    No pair is made: in the order of values, a value differs from all smaller ones by itself times their number, less their sum.
    Values are dealt out by ranges, so a large group is many tasks; a range's part of a group carries on from the ranges before it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    values = df.groupBy(*by, F.col(x).cast("double").alias("x_")).agg(F.count("*").alias("c_"))
    # Written, as ranges are drawn anew each time they are computed.
    ranged = written(values.repartitionByRange(parts, *by, "x_").withColumn("range_", F.spark_partition_id()), "ranges")
    valued = ranged.where("x_ IS NOT NULL")
    sums = lambda c, n: [F.coalesce(F.sum("c_").over(c), F.lit(0)).alias(f"c{n}_"), F.coalesce(F.sum("s_").over(c), F.lit(0.0)).alias(f"s{n}_")]
    before = Window.unboundedPreceding, -1
    whole = valued.groupBy(*by, "range_").agg(F.sum("c_").alias("c_"), F.sum(F.col("c_") * F.col("x_")).alias("s_"))
    starts = whole.select(*by, "range_", *sums(Window.partitionBy(*by).orderBy("range_").rowsBetween(*before), 1))
    own = valued.withColumn("s_", F.col("c_") * F.col("x_")).select(*by, "range_", "x_", "c_", *sums(Window.partitionBy("range_", *by).orderBy("x_").rowsBetween(*before), 2))
    same = F.lit(True)
    for c in [*by, "range_"]:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}"))
    met = own.alias("o").join(starts.alias("t"), same).select("o.*", "c1_", "s1_")
    gap = F.col("c_") * (F.col("x_") * (F.col("c1_") + F.col("c2_")) - (F.col("s1_") + F.col("s2_")))
    rows = met.select(*by, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("v"), gap.alias("g"))
    rows = rows.union(ranged.select(*by, "c_", F.when(F.col("x_").isNotNull(), F.col("c_")).otherwise(0), F.lit(0.0)))
    two = lambda c: (F.sum(c) * (F.sum(c) - 1) / 2).cast("long")
    return rows.groupBy(*by).agg(two("n").alias("pairs"), two("v").alias("valued"), F.sum("g").alias("gap"))
