"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of itself, all hashed
into one table, so a misspelling shares most of its vector with the word it was. The words
of a window are averaged and go through a linear layer and a softmax; a document's score is
that of its most toxic window. Training passes the gradient through the same soft maximum,
from the label of the whole document. Windows don't overlap, and all words of a text are in
one, so a single insult isn't thinned out by twenty thousand other words.

The labelled sample is bounded by ``MAX_POSITIVE`` + ``MAX_NEGATIVE`` rows of at most
``MAX_CHARS`` characters, drawn by a hash of the key; scoring covers every row and whole texts.

Defined cases: a null, empty or wordless text gets the score of the bias alone; a null label
is no label; where the training labels lack a class, every score is the share of toxic rows
among them (0 without any); repeated rows get equal scores; an empty table gives an empty
result. Keys, sources and languages are never inputs of a score.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import tune, worker_cache

#: Bounds of the training sample.
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 3000, 8000, 40_000
BUCKETS, DIM, WINDOW = 1 << 17, 8, 24
SIZES = (3, 4, 5)
#: Sharpness of the soft maximum over windows in training.
SHARP = 4.0
#: Squared z-score at which a bucket's log odds are halved for a start.
SHRINK = 9.0
#: Least number of minibatches in training; few rows are gone over more often.
UPDATES = 600
#: Least number of training texts for a word to teach anything.
MIN_DOCS = 2
#: 0: rows count alike; 1: classes do.
POWER = 0.25
# Characters that separate words, beside white space.
_MARKS = b".,;:!?\"'()[]{}<>|/\\#%&+=~`^_-"
_BREAKS = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BREAKS).split()


def grams(word: bytes) -> list[int]:
    """Buckets of the character n-grams of a word with its ends marked, and of the whole word."""
    w = b"<" + word + b">"
    out = [zlib.crc32(w) % BUCKETS]
    for n in SIZES:
        out += [zlib.crc32(w[i : i + n]) % BUCKETS for i in range(len(w) - n + 1)]
    return out


class Model:
    """table: one logit share per bucket (embeddings times the difference of the softmax rows); bias; prior: a score for all rows, or None."""

    def __init__(self, table: np.ndarray, bias: float, prior: float | None = None):
        self.table, self.bias, self.prior = table.astype(np.float32), float(bias), prior

    def logit_windows(self, scores: np.ndarray) -> np.ndarray:
        n = len(scores)
        if n == 0:
            return np.array([self.bias])
        starts = np.arange(0, n, WINDOW)
        return np.add.reduceat(scores, starts) / np.minimum(WINDOW, n - starts) + self.bias

    def probability(self, scores: np.ndarray) -> float:
        if self.prior is not None:
            return self.prior
        z = float(self.logit_windows(scores).max())
        return float(1 / (1 + np.exp(-min(max(z, -60), 60))))


class Scorer:
    """Scores texts; remembers the words met most recently."""

    def __init__(self, model: Model, held: int = 300_000):
        self.model, self.held, self.known = model, held, {}

    def __call__(self, text: str) -> float:
        words, table = words_of(text), self.model.table
        try:
            s = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        except KeyError:
            if len(self.known) > self.held:
                self.known = {}
            for w in set(words).difference(self.known):
                self.known[w] = float(table[grams(w)].mean())
            s = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        return self.model.probability(s)


def train(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 64, rate: float = 0.1, seed: int = 1) -> Model:
    """Adagrad on the embeddings, the softmax rows and the bias together."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    # A word of fewer than MIN_DOCS texts can't be told from chance: it holds its place in a window, but learns nothing.
    often = np.zeros(len(vocabulary), np.int64)
    for d in docs:
        often[np.unique(d)] += 1
    flat_, size = array("i"), np.empty(len(vocabulary), np.int64)
    for i, w in enumerate(vocabulary):
        g = grams(w) if often[i] >= MIN_DOCS else [BUCKETS]
        flat_.extend(g)
        size[i] = len(g)
    del vocabulary, often
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(flat_, np.int32) if len(flat_) else np.zeros(0, np.int32)
    # The start: each bucket's shrunken log odds over the texts, along the direction that the softmax tells classes by.
    seen = np.zeros((2, BUCKETS + 1))
    for d, label in zip(docs, labels, strict=True):
        if len(d):
            u = np.unique(d)
            n = size[u]
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            seen[label, np.unique(flat[np.repeat(start[u] - at, n) + np.arange(n.sum())])] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    share = (seen + 0.5) / (total + 1)
    z2 = (share[1] - share[0]) ** 2 / (share[1] * (1 - share[1]) / total[1] + share[0] * (1 - share[0]) / total[0])
    odds = np.log(share[1] / share[0]) * z2 / (z2 + SHRINK)
    way = np.zeros(DIM)
    way[0] = 1.0
    emb = np.vstack([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]) + WINDOW * odds[:, None] * way
    emb[BUCKETS] = 0
    soft = rng.normal(0, 0.1, (2, DIM)) + np.array([[-0.5], [0.5]]) * way
    bias = np.array([0.0, -2.5])
    g_emb, g_soft, g_bias = np.full(BUCKETS + 1, 1e-4), np.full((2, DIM), 1e-4), np.full(2, 1e-4)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    # Clean rows count more than an even split would have it: a filter should leave them alone.
    weight = weight**POWER
    usable = np.array([i for i, d in enumerate(docs) if len(d)])
    rounds = max(epochs, -(-UPDATES * batch // max(len(usable), 1)))
    for _ in range(rounds):
        rng.shuffle(usable)
        for lo in range(0, len(usable), batch):
            ids = usable[lo : lo + batch]
            lengths = np.array([len(docs[i]) for i in ids])
            tokens = np.concatenate([docs[i] for i in ids])
            words, at = np.unique(tokens, return_inverse=True)
            # Words' vectors: means over their n-grams.
            n = size[words]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            pick = flat[np.repeat(start[words] - begin, n) + np.arange(n.sum())]
            vec = np.add.reduceat(emb[pick], begin, axis=0) / n[:, None]
            # Windows' vectors: means over their words.
            win_of_doc = -(-lengths // WINDOW)
            first_of_doc = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            k = np.arange(win_of_doc.sum()) - np.repeat(np.cumsum(win_of_doc) - win_of_doc, win_of_doc)
            begin_w = np.repeat(first_of_doc, win_of_doc) + k * WINDOW
            size_w = np.minimum(WINDOW, np.repeat(first_of_doc + lengths, win_of_doc) - begin_w)
            h = np.add.reduceat(vec[at], begin_w, axis=0) / size_w[:, None]
            logits = h @ soft.T + bias
            z = logits[:, 1] - logits[:, 0]
            # A soft maximum over the windows of a document, then the softmax's loss.
            first = np.concatenate([[0], np.cumsum(win_of_doc)[:-1]])
            top = np.maximum.reduceat(z, first)
            e = np.exp(SHARP * (z - np.repeat(top, win_of_doc)))
            share = e / np.repeat(np.add.reduceat(e, first), win_of_doc)
            pooled = np.add.reduceat(share * z, first)
            p = 1 / (1 + np.exp(-np.clip(pooled, -40, 40)))
            err = (p - y[ids]) * weight[ids] / len(ids)
            dz = np.repeat(err, win_of_doc) * share
            d_logits = np.stack([-dz, dz], axis=1)
            d_soft, d_bias = d_logits.T @ h, d_logits.sum(axis=0)
            d_h = d_logits @ soft / size_w[:, None]
            d_word = np.stack([np.bincount(at, weights=x, minlength=len(words)) for x in np.repeat(d_h, size_w, axis=0).T], axis=1) / n[:, None]
            buckets, back = np.unique(pick, return_inverse=True)
            d_pick = np.repeat(d_word, n, axis=0)
            d_emb = np.stack([np.bincount(back, weights=x, minlength=len(buckets)) for x in d_pick.T], axis=1)
            g_emb[buckets] += (d_emb**2).mean(axis=1)
            emb[buckets] -= rate * d_emb / np.sqrt(g_emb[buckets])[:, None]
            g_soft += d_soft**2
            emb[BUCKETS] = 0
            soft -= 0.1 * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return Model(emb[:BUCKETS] @ (soft[1] - soft[0]), bias[1] - bias[0])


def fold_of(key):
    return F.crc32(F.col(key).cast("string")) % 5


def _trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [b for b in batches if len(b)]
    if not got:
        return
    rows = pd.concat(got).sort_values("k")
    texts, labels = rows["t"].tolist(), rows["y"].astype(int).tolist()
    del rows
    m = train(texts, labels)
    yield pd.DataFrame({"table": [m.table.tobytes()], "bias": [m.bias], "prior": [float("nan") if m.prior is None else m.prior]})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_chars: int = MAX_CHARS) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    tune(docs.sparkSession)
    told = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").groupBy("k").agg(F.max("y").alias("y"))
    told = told.where(F.crc32(F.col("k").cast("string")) % 5 != 0)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).where(F.length("t") <= max_chars)
    got = []
    for y, most in ((1, max_positive), (0, max_negative)):
        # The keys come first, so that texts are read only for the rows drawn.
        drawn = told.where(F.col("y") == y).join(rows.select("k"), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(most)
        got.append(rows.join(F.broadcast(drawn), "k").select("k", "t", "y").dropDuplicates(["k"]))
    # The bounded sample is one task's work; the driver sees the finished table alone.
    made = got[0].union(got[1]).coalesce(1).mapInPandas(_trained, "table binary, bias double, prior double").first()
    if made is None:
        return Model(np.zeros(BUCKETS), 0.0, 0.0)
    return Model(np.frombuffer(made.table, np.float32), made.bias, None if made.prior != made.prior else made.prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the key alone by default), score, predicted."""
    tune(docs.sparkSession)
    kept = keep if keep is not None else [key]
    packed = (model.table, model.bias, model.prior)
    name = f"toxic_{zlib.crc32(packed[0].tobytes() + repr(packed[1:]).encode())}"

    def run(batches):
        scorer = worker_cache(name, lambda: Scorer(Model(*packed)))
        for batch in batches:
            yield pd.Series([scorer(t) for t in batch], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = F.pandas_udf(run, "double")
    out = docs.withColumn("score", scored(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return out.select(*kept, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
