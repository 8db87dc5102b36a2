"""Quality by perplexity: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts the characters of each white-space word (case kept, start and end marked)
from up to four before them; it judges spelling and vocabulary, not the order of words. Counts of
the trusted corpus are gathered word by word: distinct words with their counts, then n-grams, all as
grouped sums, so everything that trusted text says is in and grows with it. Lower orders have
continuation counts; each order has three discounts from its counts of counts; probabilities are
made by joins that are sharded by n-gram and context, from the lowest order up.

Documents meet the model in one of two joins with the same numbers, chosen by the model's size, which
is counted first. Up to ``MAX_ENTRIES`` n-grams the model is broadcast and texts are scored where they are
read. Beyond that everything is sharded: the corpus' distinct n-grams meet the model, falling back to
shorter histories in a pair of joins per order; words get the sum of their n-grams; documents the sum
over their words, in a join that has one row per word on its other side.

A document's perplexity is that of its characters. It is kept if that doesn't exceed the quantile of
its language over trusted documents that the model hasn't seen: one in ``FOLDS`` of them, by a hash
of the key, sets thresholds and isn't trained on.

Defined cases: a null, empty or blank text has no perplexity and isn't kept; a null language
is the language ``''``; a language without unseen trusted documents has the threshold of all of them, and
where there are none at all, that of the trained ones; without any trusted text the perplexity is that
of a uniform guess and every text with words is kept; repeated rows are judged alike; an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, materialize, release, tune, worker_cache

ORDER, QUANTILE, FOLDS = 5, 0.99, 5
#: Entries of the model that may be broadcast (about 100 bytes each), of a task's counters, and languages whose thresholds are broadcast.
MAX_ENTRIES, HELD, FEW = 1_500_000, 150_000, 10_000
#: Bits of the bitmap that narrows trusted rows before they are joined.
BITS = 1 << 26
START, END = "\x02", "\x03"
UNKNOWN = 1 << 16  # symbols among which an unseen character is a uniform guess
NO_KEY = -(1 << 62)


def grams(word: str, order: int = ORDER) -> list[str]:
    """The n-gram of each predicted symbol: its history, as long as there is one, and itself."""
    s = START + word + END
    return [s[:j] for j in range(2, min(order, len(s) + 1))] + [s[j : j + order] for j in range(len(s) - order + 1)]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts ``t``; tasks add up before the shuffle and hold a bounded table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                held.update(t.split())
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}, columns=["word", "n"]).astype({"word": str, "n": "int64"})

    return rows.select("t").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c) of the full-history n-grams of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for w, n in zip(batch["word"].tolist(), batch["n"].tolist(), strict=True):
                for g in grams(w, order):
                    held[g] += n
            if len(held) > HELD:
                yield pd.DataFrame({"g": list(held), "c": list(held.values())})
                held = Counter()
        yield pd.DataFrame({"g": list(held), "c": list(held.values())}, columns=["g", "c"]).astype({"g": str, "c": "int64"})

    return words.mapInPandas(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from n1 .. n4; 0.5, 1 and 1.5 where they are too few."""
    n1, n2, n3, n4 = (counts_of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def model(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, logp, logb): log probability of each n-gram; log backoff weight of each history (null where it is none).

    Entries of histories alone have a null logp.
    """
    top = materialize(gram_counts(word_counts(trusted), order), "grams")
    levels: dict[int, DataFrame] = {}
    for n in range(order, 0, -1):
        own = top.where(F.length("g") == n)
        if n < order:
            above = levels[n + 1].select(F.expr("substring(g, 2)").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
            own = own.union(above).groupBy("g").agg(F.sum("c").alias("c"))
        levels[n] = materialize(own, f"level{n}")
    probability: DataFrame | None = None
    parts = []
    for n in range(1, order + 1):
        level = levels[n]
        few = {r.c: r.k for r in level.where("c <= 4").groupBy("c").agg(F.count("*").alias("k")).collect()}
        d1, d2, d3 = discounts(few)
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        level = level.withColumn("h", F.expr("substring(g, 1, length(g) - 1)")).withColumn("off", F.least(off, F.col("c")))
        history = materialize(level.groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("rest")), "history")
        level = level.join(history, "h")
        if probability is None:
            lower = F.lit(1.0 / UNKNOWN)
        else:
            level = level.withColumn("tail", F.expr("substring(g, 2)")).join(probability.select(F.col("g").alias("tail"), F.col("p").alias("lower")), "tail")
            lower = F.col("lower")
        p = (F.col("c") - F.col("off")) / F.col("total") + F.col("rest") / F.col("total") * lower
        probability = materialize(level.select("g", p.alias("p")), f"p{n}")
        parts.append((probability, history))
    out: DataFrame | None = None
    for probability, history in parts:
        both = probability.select("g", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logb"))
        both = both.union(history.select(F.col("h").alias("g"), F.lit(None).cast("double").alias("logp"), F.log(F.col("rest") / F.col("total")).alias("logb")))
        out = both if out is None else out.union(both)
    made = materialize(out.groupBy("g").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb")), "model")
    forget(top, *levels.values(), *[x for pair in parts for x in pair])
    return made


def gram_score(g: str, logp: dict[str, float], logb: dict[str, float]) -> float:
    """Log probability of an n-gram's last symbol after the others."""
    got = 0.0
    while g not in logp:
        got += logb.get(g[:-1], 0.0)
        if len(g) == 1:
            return got - math.log(UNKNOWN)
        g = g[1:]
    return got + logp[g]


class WordScorer:
    """Sum of log probabilities of a word's symbols; remembers n-grams and the words met most recently."""

    def __init__(self, logp: dict[str, float], logb: dict[str, float], held: int = 120_000):
        self.logp, self.logb, self.held = logp, logb, held
        self.words: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def word(self, w: str) -> float:
        if len(self.words) > self.held:
            self.old, self.words = self.words, {}
        s = self.old.get(w)
        if s is None:
            gs = grams(w)
            try:
                s = sum(map(self.logp.__getitem__, gs))
            except KeyError:
                s = sum(gram_score(g, self.logp, self.logb) for g in gs)
        self.words[w] = s
        return s

    def text(self, t: str) -> tuple[float, int]:
        """(log probability, symbols)."""
        words = t.split()
        get, new = self.words.get, self.word
        total = 0.0
        for w in words:
            s = get(w)
            total += new(w) if s is None else s
        return total, sum(map(len, words)) + len(words)


def _broadcast_scores(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(k, lang, logp, symbols) of rows (k, h, lang, t), texts scored where they are read."""
    import pyarrow as pa

    spark = rows.sparkSession
    # As packed columns; the driver makes no object per entry.
    sink = pa.BufferOutputStream()
    entries = table.toArrow()
    with pa.ipc.new_stream(sink, entries.schema) as out:
        out.write_table(entries)
    packed = sink.getvalue().to_pybytes()
    name = f"kneser_{zlib.crc32(packed)}"
    shared = spark.sparkContext.broadcast(packed)
    del entries, packed

    def load() -> WordScorer:
        got = pa.ipc.open_stream(shared.value).read_all()
        logp: dict[str, float] = {}
        logb: dict[str, float] = {}
        for batch in got.to_batches(max_chunksize=65536):
            for g, p, b in zip(*[batch.column(c).to_pylist() for c in ("g", "logp", "logb")], strict=True):
                if p is not None:
                    logp[g] = p
                if b is not None:
                    logb[g] = b
        return WordScorer(logp, logb)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = worker_cache(name, load)
        for batch in batches:
            got = [scorer.text(t) for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "lang": batch["lang"], "logp": [x for x, _ in got], "symbols": [n for _, n in got]})

    return rows.select("k", "lang", "t").mapInPandas(run, "k long, lang string, logp double, symbols long")


def gram_scores(asked: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, s): log probability of the last symbol of each n-gram ``g`` after the others; one pair of joins per order."""
    asked = asked.select("g", F.col("g").alias("now"), F.lit(0.0).alias("got"))
    done: DataFrame | None = None
    for _ in range(order):
        met = asked.join(table.select(F.col("g").alias("now"), "logp"), "now", "left")
        hit = met.where("logp IS NOT NULL").select("g", (F.col("got") + F.col("logp")).alias("s"))
        done = hit if done is None else done.union(hit)
        missed = met.where("logp IS NULL").withColumn("h", F.expr("substring(now, 1, length(now) - 1)"))
        missed = missed.join(table.select(F.col("g").alias("h"), "logb"), "h", "left").withColumn("got", F.col("got") + F.coalesce("logb", F.lit(0.0)))
        done = done.union(missed.where("length(now) = 1").select("g", (F.col("got") - math.log(UNKNOWN)).alias("s")))
        asked = materialize(missed.where("length(now) > 1").select("g", F.expr("substring(now, 2)").alias("now"), "got"), "shorter")
    return done


def word_scores(counts: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, s): summed log probabilities of each distinct word's symbols."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, g) for w in batch["word"] for g in grams(w, order)], columns=["word", "g"])

    spelled = counts.select("word").mapInPandas(spell, "word string, g string")
    scores = materialize(gram_scores(gram_counts(counts, order).select("g"), table, order), "gram-scores")
    return spelled.join(scores, "g").groupBy("word").agg(F.sum("s").alias("s"))


def _joined_scores(rows: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """The same by joins that are sharded by word and n-gram; no side is broadcast."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ks, hs, ws, ns = [], [], [], []
            for k, h, t in zip(batch["k"].tolist(), batch["h"].tolist(), batch["t"].tolist(), strict=True):
                got = Counter(t.split())
                ks += [k] * len(got)
                hs += [h] * len(got)
                ws += got
                ns += got.values()
            yield pd.DataFrame({"k": pd.array(ks, "int64"), "h": pd.array(hs, "int64"), "word": pd.array(ws, "str"), "n": pd.array(ns, "int32")})

    counts = materialize(word_counts(rows), "corpus-words")
    scores = materialize(word_scores(counts, table, order), "word-scores")
    words = rows.select("k", "h", "t").mapInPandas(split, "k long, h long, word string, n int")
    # One row per word on the right, so a word of many documents is a skewed partition of the left side, which is split.
    met = words.join(scores.hint("merge"), "word").groupBy("k", "h").agg(F.sum(F.col("n") * F.col("s")).alias("logp"), F.sum(F.col("n") * (F.length("word") + 1)).alias("symbols"))
    # Equal rows were added up: the mean is theirs, the sums are divided.
    times = rows.groupBy("k", "h").agg(F.count("*").alias("times"))
    met = times.join(met, ["k", "h"], "left").select("k", "h", F.coalesce(F.col("logp") / F.col("times"), F.lit(0.0)).alias("logp"), F.coalesce(F.col("symbols") / F.col("times"), F.lit(0)).cast("long").alias("symbols"))
    return rows.select("k", "h", "lang").join(met, ["k", "h"]).select("k", "lang", "logp", "symbols")


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``k`` is among ``keys``.

    A bitmap of hashed keys, of ``BITS`` bits whatever their number, is broadcast and lets through every
    wanted row and few others; what passes meets the keys in a shuffled join at any size.
    """
    h = F.pmod(F.xxhash64("k"), F.lit(BITS))
    place = lambda d: d.withColumn("b_", F.floor(h / 32768).cast("long")).withColumn("p_", (h % 32768).cast("long"))
    bitmap = place(keys.select("k")).groupBy("b_").agg(F.expr("bitmap_construct_agg(p_)").alias("bits_"))
    near = place(rows).join(F.broadcast(bitmap), "b_")  # BITS / 8 bytes at most
    byte = F.expr("cast(conv(hex(substring(bits_, cast(p_ div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("shiftleft(1, cast(p_ % 8 as int))")
    return near.where(byte.bitwiseAND(bit) != 0).drop("b_", "p_", "bits_").join(keys.hint("merge"), "k", "left_semi")


def perplexities(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Per row: key, lang, symbols, perplexity, threshold (of its language), kept.

    ``trusted`` has the keys of the documents whose text is trusted.
    """
    spark = docs.sparkSession
    tune(spark)
    good = trusted.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.xxhash64(t).alias("h"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), t.alias("t"))
    unseen = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(FOLDS)) == 0
    table = model(among(rows.where(~unseen), good))
    release(spark)
    scored = _broadcast_scores(rows, table) if table.count() <= max_entries else _joined_scores(rows, table)
    scored = scored.select("k", "lang", "symbols", F.when(F.col("symbols") > 0, F.exp(-F.col("logp") / F.col("symbols"))).alias("perplexity"))
    # Texts are scored where they are read; only their numbers meet the trusted keys.
    scored = materialize(materialize(scored, "scores").join(good.withColumn("trusted", F.lit(True)), "k", "left"), "perplexity")
    known = scored.where("trusted AND symbols > 0")
    some = known.where(unseen)
    by_lang = materialize(some.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold")), "thresholds", 1)
    over = lambda d: d.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    overall = over(some)
    overall = over(known) if overall is None else overall
    small = F.broadcast(by_lang) if by_lang.count() <= FEW else by_lang
    out = scored.join(small, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    kept = (F.col("symbols") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select(F.expr(f"nullif(k, {NO_KEY}L)").alias(key), "lang", "symbols", "perplexity", "threshold", kept.alias("kept"))
