"""Inverted-file neighbour index: rows lie in files by their nearest centroid, and a query reads few of them.

Centroids are trained on a bounded sample, every row is indexed. A search reads the files of a
query's ``probes`` nearest centroids; in its exact form it then reads those whose bound reaches the query's
k-th best score so far: a dot product with a row is at most that with its centroid plus the query's
length times the file's radius. ``vectors.knn`` stays the way without an index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .written import shared_folder, written

#: Sampled rows per centroid, rows of a block of lists, queries that meet it at once, the least of them that are worth a block, rows of a file, and products held at once.
SAMPLE, BLOCK, QUERIES, LEAST, FILE, HELD = 64, 131072, 131072, 4096, 200_000, 1 << 22


@dataclass
class Index:
    """Centroids (lists x dims), the table (key, v, list) below ``path``, and its lists (list, n, radius)."""

    path: str
    centroids: np.ndarray
    lists: DataFrame
    kind: str = "array<double>"

    @property
    def rows(self) -> DataFrame:
        return self.lists.sparkSession.read.schema(f"key long, v {self.kind}, off double, list int").parquet(self.path)


def _numbers(df: DataFrame, vec: str) -> tuple[str, Column]:
    """Type and column of vectors: floats stay floats where they are moved, and are doubles where they are multiplied."""
    kind = dict(df.dtypes)[vec]
    return (kind, F.col(vec)) if kind == "array<float>" else ("array<double>", F.transform(vec, lambda x: x.cast("double")))


def trained(df: DataFrame, key: str, vec: str, lists: int, sample: int = SAMPLE, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds over the ``lists * sample`` rows whose keys have the smallest hashes."""
    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v"), F.xxhash64(F.col(key), F.lit(seed)).alias("h")).orderBy("h").limit(lists * sample).toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    x = np.stack(rows["v"].to_numpy()).astype(float)
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(seed).permutation(len(c))[:lists]]
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def build(df: DataFrame, key: str, vec: str, lists: int = 1024, path: str | None = None, sample: int = SAMPLE) -> Index:
    """Index every row that has a key and a vector."""
    spark = df.sparkSession
    c = trained(df, key, vec, lists, sample)
    path = path or f"{shared_folder(spark)}/loomtext-core/ivf-{uuid.uuid4().hex}"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(float)
                near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
                yield batch.assign(list=near, off=np.linalg.norm(x - c[near], axis=1))

    kind, v = _numbers(df, vec)
    rows = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("key"), v.alias("v"))
    placed = rows.mapInPandas(place, f"key long, v {kind}, list int, off double")
    # Rows of a list lie together; a large list is spread over files.
    placed.repartition("list", F.pmod(F.xxhash64("key"), F.lit(8))).write.option("maxRecordsPerFile", FILE).partitionBy("list").parquet(path)
    table = spark.read.schema(f"key long, v {kind}, off double, list int").parquet(path)
    return Index(path, c, written(table.groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("radius")), "lists"), kind)


def _blocks(sizes: dict[int, int], lists: int) -> tuple[list[int | None], list[int | None]]:
    """First and last block of each list: small lists share one, large ones have several; None without rows."""
    first, last, block, held = [None] * lists, [None] * lists, 0, 0
    for name in sorted(sizes):
        if held and held + sizes[name] > BLOCK:
            block, held = block + 1, 0
        first[name], last[name] = block, block + max(1, -(-sizes[name] // BLOCK)) - 1
        block, held = (block, held + sizes[name]) if last[name] == block else (last[name] + 1, 0)
    return first, last


def _scan(asked: DataFrame, index: Index, k: int, self_excluded: bool) -> DataFrame:
    """(q, key, score): for queries (q, v, lists, least) the ``k`` best rows of each block among their lists' rows, those that reach about ``least``.

    A query goes once to each block that has one of its lists, and a block once to each block of queries.
    """
    sizes = {r.list: r.n for r in index.lists.collect()}  # a number for each centroid
    first, last = _blocks(sizes, len(index.centroids))
    number = lambda xs: F.array(*[F.lit(x).cast("int") for x in xs or [None]])
    n, parts = asked.count(), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Fewer queries a block where there would be too few pairs of blocks for all tasks.
    i = max(1, -(-n // QUERIES), min(-(-parts // (1 + max((b for b in last if b is not None), default=0))), -(-n // LEAST)))
    present = F.filter("lists", lambda x: F.get(number(first), x).isNotNull())
    blocks = F.array_distinct(F.flatten(F.transform(present, lambda x: F.sequence(F.get(number(first), x), F.get(number(last), x)))))
    left = asked.select(F.pmod(F.xxhash64("q"), F.lit(i)).cast("int").alias("i"), F.explode(blocks).alias("j"), F.col("q").alias("key"), "v", "lists", "least", F.lit(-1).alias("list"))
    j = F.get(number(first), F.col("list")) + F.pmod(F.xxhash64("key"), F.get(number(last), F.col("list")) - F.get(number(first), F.col("list")) + 1).cast("int")
    right = index.rows.select(F.explode(F.sequence(F.lit(0), F.lit(i - 1))).alias("i"), j.alias("j"), "key", "v", F.lit(None).cast("array<int>").alias("lists"), F.lit(None).cast("double").alias("least"), "list")

    def product(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["list"] < 0], g[g["list"] >= 0].sort_values("key")
        out = [pd.DataFrame({"q": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if not len(a) or not len(b):
            return out[0]
        names, of = np.unique(b["list"].to_numpy(), return_inverse=True)
        n = a["lists"].str.len().to_numpy()
        row, wanted = np.repeat(np.arange(len(a)), n), np.concatenate(a["lists"].to_numpy())
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        need = np.zeros((len(a), len(names)), bool)
        need[row[names[at] == wanted], at[names[at] == wanted]] = True
        # Queries of like lists lie together, so that a tile leaves out what none of its queries needs.
        order = np.lexsort(need.T)
        a, need = a.iloc[order], need[order]
        qs, ps, least = a["key"].to_numpy(), b["key"].to_numpy(), a["least"].to_numpy() - 1e-9
        x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
        tile = max(1, min(256, HELD // len(ps)))
        for start in range(0, len(qs), tile):
            t = slice(start, start + tile)
            some = need[t].any(axis=0)
            cols = np.arange(len(ps)) if some.all() else np.flatnonzero(some[of])
            if not len(cols):
                continue
            s = x[t] @ (y if some.all() else y[cols]).T
            s[~need[t][:, of[cols]] | (s < least[t, None])] = -np.inf
            if self_excluded:
                s[qs[t, None] == ps[cols][None]] = -np.inf
            top = min(k, len(cols))
            row, col = np.nonzero((s >= -np.partition(-s, top - 1, axis=1)[:, top - 1 : top]) & np.isfinite(s))
            out.append(pd.DataFrame({"q": qs[start + row], "key": ps[cols[col]], "score": s[row, col]}))
        return pd.concat(out)

    return left.union(right).groupBy("i", "j").applyInPandas(product, "q long, key long, score double")


def search(index: Index, queries: DataFrame, qkey: str, vec: str, k: int, probes: int = 8, exact: bool = False, self_excluded: bool = True) -> DataFrame:
    """(q, key, score, rank): the ``k`` highest dot products per query, ties by key, among the rows read."""
    c, (kind, v) = index.centroids, _numbers(queries, vec)
    rows = queries.where(F.col(qkey).isNotNull() & F.col(vec).isNotNull()).select(F.col(qkey).cast("long").alias("q"), v.alias("v"))
    best = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(c):
                x = np.stack(batch["v"].to_numpy()).astype(float)
                d = (c * c).sum(1)[None] - 2 * x @ c.T
                n = min(probes, len(c))
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                yield batch.assign(lists=list(near.astype(np.int32)), least=-np.inf)

    table = f"q long, v {kind}, lists array<int>, least double"
    first = rows.mapInPandas(nearest, table)
    found = written(best(_scan(first, index, k, self_excluded)), "found")
    if not exact:
        return found
    radius = np.full(len(c), -np.inf)
    for r in index.lists.collect():  # a number for each centroid, as the centroids are
        radius[r.list] = r.radius
    reach = found.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("q", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("least"))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(c):
                x, least = np.stack(batch["v"].to_numpy()).astype(float), batch["least"].to_numpy()
                top = x @ c.T + np.linalg.norm(x, axis=1)[:, None] * radius[None]
                need = np.isfinite(top) & (top + 1e-9 >= least[:, None])
                # Lists that were read already are left out.
                need[np.repeat(np.arange(len(batch)), batch["lists"].str.len().to_numpy()), np.concatenate(batch["lists"].to_numpy())] = False
                yield batch.assign(lists=[np.flatnonzero(r).astype(np.int32) for r in need])

    more = first.join(reach.withColumnRenamed("least", "reached"), "q", "left").select("q", "v", "lists", F.coalesce("reached", F.lit(float("-inf"))).alias("least")).mapInPandas(within, table)
    return best(found.select("q", "key", "score").union(_scan(more, index, k, self_excluded)))


def rows_read(index: Index, queries: DataFrame, probes: int) -> float:
    """Mean rows of the lists that ``probes`` probes read, for lists drawn by their size."""
    n = index.lists.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")).first()
    return min(float(n.n or 0), probes * float(n.q or 0) / max(1, n.n or 0))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of ``exact``'s (q, key) that ``found`` has."""
    hit = found.select("q", "key").distinct().withColumn("hit", F.lit(1))
    return exact.select("q", "key").join(hit, ["q", "key"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
