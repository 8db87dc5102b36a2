"""Relational operators over corpora: filters, joins, ranks, upserts, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that aren't None."""
    for k, v in wanted.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    return df


def matches_keyword(word: str, scalars: list[str], arrays: list[str]) -> Column:
    """Case-insensitive: any scalar, or any element of any array, contains the word."""
    low = word.lower()
    out = F.lit(False)
    for c in scalars:
        out = out | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(low)
    for c in arrays:
        out = out | F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x).contains(low))
    return out


def flag_present(left: DataFrame, right: DataFrame, on: str, name: str) -> DataFrame:
    """``left`` with a flag for keys that ``right`` has; rows never multiply."""
    return left.join(right.select(on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def join_with_default(left: DataFrame, right: DataFrame, on: str, defaults: dict) -> DataFrame:
    out = left.join(right, on, "left")
    for k, v in defaults.items():
        out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
    return out


def require_all(left: DataFrame, right: DataFrame, on: list[str], what: str) -> DataFrame:
    """Inner join that fails the query on a key ``right`` lacks."""
    marked = left.join(right.withColumn("found_", F.lit(True)), on, "left")
    return marked.withColumn("ok_", F.assert_true(F.col("found_").isNotNull(), F.lit(f"{what}: unresolved key"))).where("ok_ IS NULL").drop("ok_", "found_")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def latest_wins(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Keyed upsert: of all rows of a key the one with the highest version, ties to ``new``."""
    both = old.withColumn("from_", F.lit(0)).unionByName(new.withColumn("from_", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in both.columns if c not in key]), F.struct(version, "from_")).alias("r")).select(*key, "r.*").drop("from_")


def undirected(edges: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """One row per unordered pair, the first in the given order."""
    pair = edges.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    return pair.withColumn("n_", F.row_number().over(Window.partitionBy("lo", "hi").orderBy(*order))).where("n_ = 1").drop("n_")


def zscore(x: str, by: list[str] | None = None, floor: float = 1e-9) -> Column:
    """(x - mean) / population deviation within a partition."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))


def islands(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Runs of consecutive rows with a flag: by, run number, first and last of ``order``, length."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("run", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w)).where(F.col(flag))
    return marked.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
