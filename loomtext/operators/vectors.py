"""Vector operators: exact nearest neighbours in blocks, group similarities from sums, owner scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as V

#: Rows of a block of the blocked product, and of the tile of it that is multiplied at once.
BLOCK, TILE = 32768, 256


def knn(queries: DataFrame, pool: DataFrame, qkey: str, key: str, vec: str, k: int, block: int = BLOCK) -> DataFrame:
    """(qkey, key, score): the ``k`` highest dot products per query, ties by key; a query never finds its own key.

    Both sides are dealt into blocks; each pair of blocks is one product and leaves k rows per
    query, so what is shuffled is blocks of vectors and short lists, never all pairs.
    """
    q = queries.select(F.col(qkey).cast("long").alias("q"), F.col(vec).alias("v"))
    p = pool.select(F.col(key).cast("long").alias("q"), F.col(vec).alias("v"))
    sizes = [max(1, -(-d.count() // block)) for d in (q, p)]
    deal = lambda d, n: d.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int"))
    left = deal(q, sizes[0]).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(sizes[1] - 1)))).select(F.col("b").alias("i"), F.col("o").alias("j"), "q", "v", F.lit(0).alias("side"))
    right = deal(p, sizes[1]).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(sizes[0] - 1)))).select(F.col("o").alias("i"), F.col("b").alias("j"), "q", "v", F.lit(1).alias("side"))

    def product(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["side"] == 0], g[g["side"] == 1].sort_values("q")
        empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "p": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return empty
        x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
        qs, ps = a["q"].to_numpy(), b["q"].to_numpy()
        n, out = min(k, len(ps)), []
        for at in range(0, len(qs), TILE):
            s = x[at : at + TILE] @ y.T
            s[qs[at : at + TILE, None] == ps[None, :]] = -np.inf
            # All that reach the n-th best score, so that ties go by key; then the first n of each query.
            row, col = np.nonzero(s >= -np.partition(-s, n - 1, axis=1)[:, n - 1 : n])
            score = s[row, col]
            order = np.lexsort((ps[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            fits = (place < n) & np.isfinite(score)
            out.append(pd.DataFrame({"q": qs[at + row[fits]], "p": ps[col[fits]], "score": score[fits]}))
        return pd.concat(out)

    part = left.union(right).groupBy("i", "j").applyInPandas(product, "q long, p long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    out = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(qkey), F.col("p").alias("neighbour" if qkey == key else key), "score", "rank")


def pair_statistics(df: DataFrame, key: str, vec: str, group: str) -> DataFrame:
    """(ga, gb, n, s, ss): count, sum and sum of squares of the dot products of all unordered pairs, by groups.

    No pair is made: dot products of two groups add up to that of their sums, and their squares to the
    product, cell by cell, of the groups' matrices of cross products. Tasks add these up before anything moves.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(g, *map(float, x[:3]), x[3].tolist(), x[4].ravel().tolist()) for g, x in held.items()], columns=["g", "n", "q", "q4", "sum", "cross"])

        for batch in batches:
            for g, rows in batch.groupby("g"):
                x = np.stack(rows["v"].to_numpy()).astype(float)
                q = (x * x).sum(axis=1)
                new = [len(x), q.sum(), (q * q).sum(), x.sum(axis=0), x.T @ x]
                held[g] = [a + b for a, b in zip(held[g], new, strict=True)] if g in held else new
            if len(held) > 256:
                yield told()
                held = {}
        yield told()

    rows = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(vec).alias("v"))
    parts = rows.mapInPandas(run, "g string, n double, q double, q4 double, sum array<double>, cross array<double>")
    flat = parts.select("g", F.posexplode(F.concat(F.array("n", "q", "q4"), "sum", "cross")).alias("i", "x"), F.size("sum").alias("d"))
    cells = flat.groupBy("g", "i").agg(F.sum("x").alias("x"), F.max("d").alias("d"))
    both = cells.alias("a").join(cells.alias("b"), F.expr("a.i = b.i AND a.g <= b.g"))  # groups by groups, one row per cell
    prod, own = F.col("a.x") * F.col("b.x"), F.col("a.g") == F.col("b.g")
    i, d = F.col("a.i"), F.col("a.d")
    at = lambda k: F.sum(F.when(i == k, F.col("a.x")))
    got = both.groupBy(F.col("a.g").alias("ga"), F.col("b.g").alias("gb")).agg(F.sum(F.when(i == 0, prod)).alias("nn"), at(0).alias("n"), at(1).alias("q"), at(2).alias("q4"), F.sum(F.when((i >= 3) & (i < 3 + d), prod)).alias("s"), F.sum(F.when(i >= 3 + d, prod)).alias("ss"), F.first(own).alias("own"))
    half = lambda c, less: F.when(F.col("own"), (F.col(c) - F.col(less)) / 2).otherwise(F.col(c))
    return got.select("ga", "gb", half("nn", "n").cast("long").alias("n"), half("s", "q").alias("s"), half("ss", "q4").alias("ss")).where("n > 0")


def mean_similarity(df: DataFrame, key: str, vec: str, group: str) -> DataFrame:
    """(la, lb, sim): mean dot product over pairs of different rows, by unordered pair of groups.

    From sums alone: the dot products of two groups add up to the dot product of their sums.
    """
    rows = df.select(F.col(group).alias("g"), F.posexplode(vec).alias("d", "x")).groupBy("g", "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count("*").alias("n"))
    sums = rows.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda z: z["s"]).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n"))
    a, b = sums.select(*[F.col(c).alias(f"{c}a") for c in sums.columns]), sums.select(*[F.col(c).alias(f"{c}b") for c in sums.columns])
    j = a.join(b, F.col("ga") <= F.col("gb"))  # groups by groups
    same = F.col("ga") == F.col("gb")
    total = V.dot(F.col("sa"), F.col("sb")) - F.when(same, F.col("qa")).otherwise(0.0)
    n = F.col("na") * F.col("nb") - F.when(same, F.col("na")).otherwise(0)
    return j.select(F.col("ga").alias("la"), F.col("gb").alias("lb"), (total / n).alias("sim")).where("sim IS NOT NULL")


def within_between(df: DataFrame, key: str, vec: str, group: str) -> DataFrame:
    """n_within, n_between, diff of the means, Cohen's d with the mean of both variances."""
    st = pair_statistics(df, key, vec, group).groupBy((F.col("ga") == F.col("gb")).alias("same")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    st = st.select("same", "n", (F.col("s") / F.col("n")).alias("m"), ((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    pick = lambda same, c: F.max(F.when(F.col("same") == same, F.col(c)))
    return st.agg(pick(True, "n").alias("n_within"), pick(False, "n").alias("n_between"), (pick(True, "m") - pick(False, "m")).alias("diff"), ((pick(True, "m") - pick(False, "m")) / F.sqrt((pick(True, "v") + pick(False, "v")) / 2)).alias("d"))


def owner_best(scores: DataFrame, owner: str, window: str, score: str) -> DataFrame:
    """Per owner the best window, the first of equal ones."""
    return scores.groupBy(owner).agg(F.max(score).alias("score"), F.min_by(window, F.struct(-F.col(score), window)).alias("best"))


def encode(df: DataFrame, text: str, encoder, dim: int) -> DataFrame:
    """``df`` with ``vec``; ``encoder`` maps a list of texts to an array of unit rows. It is made once per worker batch stream."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch.tolist()), np.float32)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("vec", F.pandas_udf(run, "array<float>")(F.coalesce(F.col(text), F.lit(""))))


def hashing_encoder(dim: int = 384):
    """A deterministic stand-in for a sentence encoder: signed hashed words, unit length."""

    def run(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def best_by_owner(queries: DataFrame, pool: DataFrame, qkey: str, qvec: str, owner: str, vec: str, keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(qkey, keep, owner, score): each query's highest dot product with any window of each owner, from block products that leave one row per query and owner."""
    keep = keep or []
    n = [max(1, -(-d.count() // block)) for d in (queries, pool)]
    q = queries.select(F.col(qkey).cast("long").alias("q"), F.col(qvec).alias("v"), *keep, F.pmod(F.xxhash64(qkey), F.lit(n[0])).cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n[1] - 1))))
    p = pool.select(F.col(vec).alias("v"), F.col(owner).cast("string").alias("o"), F.pmod(F.xxhash64(vec), F.lit(n[1])).cast("int").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n[0] - 1))))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "o": pd.Series(dtype=str), "score": pd.Series(dtype=float)})
        b = b.sort_values("o")
        x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float).T
        names = b["o"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        m = np.concatenate([np.maximum.reduceat(x[at : at + TILE] @ y, first, axis=1) for at in range(0, len(x), TILE)])
        return pd.DataFrame({"q": np.repeat(a["q"].to_numpy(), len(first)), "o": np.tile(names[first], len(a)), "score": m.ravel()})

    part = q.select("i", "j", "q", "v").groupBy("i", "j").cogroup(p.groupBy("i", "j")).applyInPandas(product, "q long, o string, score double")
    kind = dict(pool.dtypes)[owner]
    best = part.groupBy("q", "o").agg(F.max("score").alias("score")).select(F.col("q").alias(qkey), F.col("o").cast(kind).alias(owner), "score")
    return best.join(queries.select(F.col(qkey).cast("long").alias(qkey), *keep), qkey) if keep else best
