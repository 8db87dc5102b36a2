"""Scores of (premise, hypothesis) pairs by a model that workers load once, and runs that resume.

A document is cut to chunks; each chunk meets every hypothesis in one batch of the model. Where a
pair is too long only the premise is cut, for without its hypothesis a pair asks nothing. Results
are kept by (id, fingerprint): a document's fingerprint changes with its text, the hypotheses and
the model, and only documents whose fingerprint isn't stored are scored again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import text as X
from .written import written

#: Tokens of a pair, of which some are marks between its sides; words of a chunk; the score from which a label is assigned.
MAX_TOKENS, MARKS, CHUNK, THRESHOLD = 512, 3, 300, 0.5
SCORES = "id long, fingerprint string, chunk int, truncated boolean, scores array<double>"

Score = Callable[[list[tuple[str, str]]], np.ndarray]


def packed(premise: list[str], hypothesis: list[str], most: int = MAX_TOKENS) -> tuple[list[str], bool]:
    """The premise's tokens that fit beside the whole hypothesis, and whether some didn't."""
    room = max(0, most - MARKS - len(hypothesis))
    return premise[:room], len(premise) > room


def fingerprint(text: Column, hypotheses: dict[str, str], version: str) -> Column:
    """Of a text under these hypotheses, in their order, and this version of the model."""
    rest = json.dumps([list(hypotheses.items()), version], ensure_ascii=False)
    return F.substring(F.sha2(F.concat_ws("\x01", F.coalesce(text, F.lit("")), F.lit(rest)), 256), 1, 16)


def chunk_scores(docs: DataFrame, key: str, text: str, hypotheses: dict[str, str], load: Callable[[], Score], version: str, size: int = CHUNK, most: int = MAX_TOKENS) -> DataFrame:
    """(id, fingerprint, chunk, truncated, scores): of every chunk, a score for each hypothesis in their order.

    ``load`` is called once in a task. An empty or null text is one empty chunk.
    """
    asked = [h for h in hypotheses.values()]
    tokens = [h.split() for h in asked]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or load()
            out, cut = [], []
            for words in batch["words"]:
                sides = [packed(list(words), t, most) for t in tokens]
                cut.append(any(c for _, c in sides))
                out.append(np.asarray(model([(" ".join(p), h) for (p, _), h in zip(sides, asked, strict=True)]), float))
            yield batch[["id", "fingerprint", "chunk"]].assign(truncated=cut, scores=out)

    rows = docs.select(F.col(key).cast("long").alias("id"), fingerprint(F.col(text), hypotheses, version).alias("fingerprint"), V.chunks(X.words(F.coalesce(F.col(text), F.lit(""))), size, 0).alias("cs"))
    return rows.select("id", "fingerprint", F.posexplode("cs").alias("chunk", "words")).mapInPandas(run, SCORES)


def document_scores(scores: DataFrame, hypotheses: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(id, label, score, position, assigned): the best chunk's score, the first of equal ones."""
    names = F.array(*[F.lit(n) for n in hypotheses])
    long = scores.select("id", "chunk", F.posexplode("scores").alias("i", "s"))
    best = long.groupBy("id", "i").agg(F.max("s").alias("score"), F.min(F.struct(-F.col("s"), F.col("chunk"))).alias("first"))
    return best.select("id", F.get(names, F.col("i")).alias("label"), "score", F.col("first.chunk").alias("position"), (F.col("score") >= threshold).alias("assigned"))


def missing(docs: DataFrame, stored: DataFrame, key: str, text: str, hypotheses: dict[str, str], version: str) -> DataFrame:
    """Documents that have no stored scores of their present fingerprint."""
    have = stored.select(F.col("id").alias("id_"), F.col("fingerprint").alias("f_")).distinct()
    seen = (F.col(key).cast("long") == F.col("id_")) & (fingerprint(F.col(text), hypotheses, version) == F.col("f_"))
    return docs.join(have, seen, "left_anti")


def _exists(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored_scores(spark, path: str) -> DataFrame:
    """All rows of a store; none where there is no store yet."""
    return spark.read.schema(SCORES).parquet(f"{path}/*") if _exists(spark, path) else spark.createDataFrame([], SCORES)


def score_missing(docs: DataFrame, path: str, name: str, key: str, text: str, hypotheses: dict[str, str], load: Callable[[], Score], version: str, **how) -> int:
    """Score what ``path`` lacks into its part ``name``, and return the number of documents scored.

    A part is committed as a whole: after an interruption the next run scores the documents of the part that
    was lost and no others. A part of the same name that is complete is kept, so a batch that runs again adds nothing.
    """
    spark = docs.sparkSession
    part = f"{path}/part-{name}"
    if _exists(spark, f"{part}/_SUCCESS"):
        return 0
    # Of repeated ids one text counts, the first in order.
    one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias(text))
    todo = written(missing(one, stored_scores(spark, path), key, text, hypotheses, version), "missing")
    chunk_scores(todo, key, text, hypotheses, load, version, **how).write.mode("overwrite").parquet(part)
    return todo.count()


def scoring_batches(path: str, key: str, text: str, hypotheses: dict[str, str], load: Callable[[], Score], version: str, **how):
    """A ``foreachBatch`` function that scores a stream's new or changed documents."""

    def run(batch: DataFrame, batch_id: int) -> None:
        score_missing(batch, path, f"{batch_id:09d}", key, text, hypotheses, load, version, **how)

    return run


def _features(pairs: list[tuple[str, str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed columns and values of pairs: what share of the hypothesis the premise has, its words, and pairs of words."""
    import xxhash

    at, col, val = [], [], []
    for i, (premise, hypothesis) in enumerate(pairs):
        p, h = set(premise.lower().split()), hypothesis.lower().split()
        found = [w for w in h if w in p]
        terms = [("share", len(found) / max(1, len(h))), ("one", 1.0), *[(f"both {w}", 1.0) for w in found]]
        weight = 1 / max(1, len(p)) ** 0.5
        terms += [(f"{hypothesis} | {w}", weight) for w in p]
        for name, x in terms:
            at.append(i)
            col.append(xxhash.xxh3_64_intdigest(name) % size)
            val.append(x)
    return np.array(at, np.int64), np.array(col, np.int64), np.array(val)


class PairModel:
    """Logistic regression on hashed features of a pair."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        at, col, val = _features(pairs, len(self.weights))
        return 1 / (1 + np.exp(-np.bincount(at, self.weights[col] * val, len(pairs))))


def fit_pairs(examples: DataFrame, premise: str, hypothesis: str, label: str, size: int = 1 << 16, most: int = 20_000, rounds: int = 200, rate: float = 0.5, seed: int = 1) -> PairModel:
    """Train on at most ``most`` examples, those whose hashes are smallest."""
    rows = examples.where(F.col(label).isNotNull()).select(F.coalesce(premise, F.lit("")).alias("p"), F.coalesce(hypothesis, F.lit("")).alias("h"), F.col(label).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("p", "h", F.lit(seed)), "p", "h", "y").limit(most).toPandas()
    weights, square = np.zeros(size), np.full(size, 1e-8)
    if len(rows):
        at, col, val = _features(list(zip(rows["p"], rows["h"], strict=True)), size)
        y = rows["y"].to_numpy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.bincount(at, weights[col] * val, len(y))))
            g = np.bincount(col, val * (p - y)[at], size) / len(y) + 1e-5 * weights
            square += g * g
            weights = weights - rate * g / np.sqrt(square)
    return PairModel(weights)
