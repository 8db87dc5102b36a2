"""A residual map between two vector spaces, trained by contrast within batches, data-parallel; and the cache of its pairs.

Rows are dealt to batches by a hash that changes every epoch. In a batch each row's own partner is
right and all others are wrong. Tasks take their batches' gradients of one model; these are added
up as a plan, so the driver gets one sum of the model's size for each step, never a row. ``steps`` of an
epoch are slices of the batches, a step of the optimiser each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import written

HIDDEN, EPOCHS, BATCH, TEMPERATURE, RATE, DECAY = 512, 10, 256, 0.05, 1e-3, 0.01


@dataclass
class ResidualMap:
    """x + W2 gelu(W1 x + b1) + b2, of unit length; ``losses`` has an epoch's mean loss each."""

    weights: list[np.ndarray]
    losses: list[float] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _unit(_forward(self.weights, x)[0])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function by a rational fit, within 2e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - tail * np.exp(-x * x))


def _forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = weights
    h = x @ w1 + b1
    half = 0.5 * (1 + _erf(h / np.sqrt(2)))
    return x + (h * half) @ w2 + b2, h, half


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, temperature: float) -> tuple[float, list[np.ndarray]]:
    """The mean contrastive loss of a batch and its gradient for each weight."""
    _, _, w2, _ = weights
    raw, h, half = _forward(weights, x)
    size = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    out, target = raw / size, _unit(y)
    s = out @ target.T / temperature
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(p.diagonal(), 1e-300)).mean())
    p[np.diag_indices(len(p))] -= 1
    g = p @ target / (temperature * len(x))
    g = (g - out * (g * out).sum(axis=1, keepdims=True)) / size
    a = h * half
    gh = g @ w2.T * (half + h * np.exp(-h * h / 2) / np.sqrt(2 * np.pi))
    return loss, [x.T @ gh, gh.sum(axis=0), a.T @ g, g.sum(axis=0)]


def fit_residual(pairs: DataFrame, key: str, x: str, y: str, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, temperature: float = TEMPERATURE, rate: float = RATE, steps: int = 0, seed: int = 0) -> ResidualMap:
    """Train on pairs (key, x, y). ``steps`` per epoch: by default as many as there are batches, up to 16.

    Batches hold ``batch`` rows on average; one of a single row has nothing to tell it from and is left out.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_double = lambda c: F.transform(c, lambda v: v.cast("double"))
    rows = written(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).cast("string").alias("k"), as_double(x).alias("x"), as_double(y).alias("y")), "pairs")
    n, first = rows.count(), rows.first()
    if n < 2:
        raise ValueError("contrast needs two pairs or more")
    d, e = len(first.x), len(first.y)
    if d != e:
        raise ValueError("a residual map keeps the number of dimensions")
    rng, batches = np.random.default_rng(seed), max(1, round(n / batch))
    steps = steps or min(16, batches)
    scale = lambda a, b: rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
    weights = [scale(d, hidden), np.zeros(hidden), scale(hidden, d), np.zeros(d)]
    shapes, cuts = [w.shape for w in weights], np.cumsum([w.size for w in weights])[:-1]
    first_, second, losses, at = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], [], 0

    def step(epoch: int, turn: int) -> tuple[float, list[np.ndarray]] | None:
        held = weights

        def run(g: pd.DataFrame) -> pd.DataFrame:
            if len(g) < 2:
                return pd.DataFrame({"n": pd.Series(dtype="double"), "g": pd.Series(dtype=object)})
            g = g.sort_values("k")
            loss, grads = gradients(held, np.stack(g["x"].to_numpy()), np.stack(g["y"].to_numpy()), temperature)
            return pd.DataFrame({"n": [1.0], "g": [np.concatenate([[loss], *[w.ravel() for w in grads]])]})

        dealt = rows.withColumn("b", F.pmod(F.xxhash64("k", F.lit(seed), F.lit(epoch)), F.lit(batches)).cast("int")).where(F.pmod("b", F.lit(steps)) == turn)
        got = dealt.groupBy("b").applyInPandas(run, "n double, g array<double>").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).first()
        if not got.n:
            return None
        mean = np.asarray(got.g) / got.n
        return mean[0], [w.reshape(s) for w, s in zip(np.split(mean[1:], cuts), shapes, strict=True)]

    for epoch in range(epochs):
        seen = []
        for turn in range(steps):
            got = step(epoch, turn)
            if got is None:
                continue
            at += 1
            seen.append(got[0])
            for i, g in enumerate(got[1]):
                first_[i] = 0.9 * first_[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = first_[i] / (1 - 0.9**at) / (np.sqrt(second[i] / (1 - 0.999**at)) + 1e-8)
                weights = [*weights[:i], weights[i] * (1 - rate * DECAY) - rate * move, *weights[i + 1 :]]
        losses.append(float(np.mean(seen)))
    return ResidualMap(weights, losses)


def apply_residual(df: DataFrame, vec: str, model: ResidualMap) -> DataFrame:
    """``df`` with ``vec`` mapped; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got = batch.notna()
            mapped = iter(model(np.stack(batch[got].to_numpy()).astype(float)) if got.any() else ())
            yield pd.Series([next(mapped) if there else None for there in got], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(vec, F.pandas_udf(run, "array<double>")(F.col(vec)))


def refresh_pairs(pairs: DataFrame, region: str, path: str, embed) -> list:
    """Keep (region, tag, rows of ``embed``) below ``path``, a partition per region; returns the regions computed anew.

    A region's tag is its number of pairs and a hash of them. Only regions whose tag has changed go
    through ``embed`` (a function of DataFrames that keeps ``region``), and only their partitions are replaced.
    """
    spark = pairs.sparkSession
    others = [c for c in pairs.columns if c != region]
    tags = written(pairs.groupBy(region).agg(F.concat_ws("-", F.count("*"), F.hex(F.bit_xor(F.xxhash64(*others))), F.hex(F.sum(F.xxhash64(*others).cast("decimal(38,0)")).cast("string"))).alias("tag")), "tags")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    old = spark.read.parquet(path).select(F.col(region).alias("r_"), F.col("tag").alias("t_")).distinct() if there else None
    stale = tags if old is None else tags.join(old, tags[region].cast("string").eqNullSafe(F.col("r_").cast("string")) & (F.col("tag") == F.col("t_")), "left_anti")
    stale = written(stale, "stale")
    names = [r[0] for r in stale.select(region).collect()]  # a name for each changed region
    if names:
        todo = pairs.join(stale.withColumnRenamed(region, "r_"), F.col(region).eqNullSafe(F.col("r_"))).drop("r_")
        fresh = written(embed(todo.drop("tag")).join(stale.withColumnRenamed(region, "r_"), F.col(region).eqNullSafe(F.col("r_"))).drop("r_"), "fresh")
        fresh.repartition(region).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(region).parquet(path)
    return names


def cached_pairs(spark, path: str, region: str, name, expect: int) -> DataFrame:
    """A region's rows, which must be ``expect`` in number."""
    got = spark.read.parquet(path).where(F.col(region) == name)
    n = got.count()
    if n != expect:
        raise ValueError(f"{name}: {n} pairs in the cache, {expect} expected")
    return got
