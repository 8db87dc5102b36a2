"""Near duplicates: MinHash signatures, banding, verification on full sets, connected components.

Steps: (1) documents with equal word sequences form a class, found by a grouped minimum;
(2) one representative of each class gets its distinct w-word shingles as 64-bit hashes and
the minima of many universal hash functions over them; (3) bands of the signature deal
representatives into buckets; (4) in each bucket members are held against its smallest key
and linked if the full sets reach the threshold; (5) buckets that aren't in one component then
go on: members are held against the bucket's most central member (with the fewest shingles of
its own), then against another one; what is still outside the bucket's largest component is
held against all sets with one of its rarest shingles, of which every similar set must have
one, so no link that joins components is lost; (6) components by alternating large-star and
small-star over the links.

Only links that join components matter for a component's smallest member, so pairs inside
one component needn't be emitted; a group of near copies as large as a third of all rows
costs its size times a few pivots rather than its square.

Defined cases: null and empty texts and texts without words have no shingles and are linked
with nothing; fewer words than ``width`` give one shingle, the whole sequence; repeated rows
are in one class; rows with the same key but other texts are one node; a row without a key
takes part only through a keyed row of equal words, and has a null component otherwise; an
empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import forget, materialize, release, tune, worker_cache

#: Bands and rows of a band: at a similarity of 0.8 a pair shares no bucket in 3 of a million cases.
BANDS, ROWS = 24, 4
#: Pivot rounds before the rest of each bucket is searched by rare shingles.
PIVOT_ROUNDS = 2


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, remembered for the words met most recently."""

    def __init__(self, held: int = 400_000):
        self.held, self.new = held, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        try:
            return np.fromiter(map(self.new.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(self.new) > self.held:
            self.new = {}
        for w in set(words).difference(self.new):
            self.new[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.new.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, width)
    h = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return np.unique(h)


class Minima:
    """Minima of universal hash functions, the upper half of a * x + b modulo 2 ** 64 with odd a."""

    def __init__(self, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def __call__(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(x), block):
            part = self.a[:, None] * x[None, lo : lo + block] + self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out >> np.uint64(32)


def word_split(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased and all else as it is (bytes know no other letters and blanks)."""
    return text.encode().lower().split()


def sketch(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """(key, content, n_shingles, signature, bands): content is a 128-bit hash of the word sequence.

    Sequences are read whole; one text is held at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashed, minima = worker_cache("words", WordHash), Minima(bands * rows, seed)
        for batch in batches:
            content, size, signs, keys = [], [], [], []
            for t in batch["t"]:
                w = hashed(word_split(t))
                s = shingle_hashes(w, width)
                size.append(len(s))
                content.append(xxhash.xxh3_128_digest(w.tobytes()) if len(w) else b"")
                if len(s):
                    m = minima(s).reshape(bands, rows)
                    band = _mix(m[:, 0] + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    for r in range(1, rows):
                        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + m[:, r])
                    keys.append(band.view(np.int64))
                    signs.append(m.astype("<u4").tobytes())
                else:
                    signs.append(b"")
                    keys.append(np.zeros(0, np.int64))
            yield pd.DataFrame({"key": batch["k"], "content": content, "n_shingles": size, "signature": signs, "bands": keys})

    source = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return source.select("k", "t").mapInPandas(run, "key long, content binary, n_shingles long, signature binary, bands array<long>")


def shingle_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, set): the sorted distinct shingle hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = worker_cache("words", WordHash)
        for batch in batches:
            yield pd.DataFrame({"key": batch["k"], "set": [np.sort(shingle_hashes(hashed(word_split(t)), width).view(np.int64)) for t in batch["t"]]})

    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInPandas(run, "key long, set array<long>")


def likely(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough for the threshold.

    The bar lies six and a half standard deviations below what a pair just at the threshold
    agrees in, so that only pairs of clearly lower similarity go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = percent / 100
        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch["sa"]), "<u4").reshape(len(batch), -1)
                y = np.frombuffer(b"".join(batch["sb"]), "<u4").reshape(len(batch), -1)
                bar = p - 6.5 * (p * (1 - p) / x.shape[1]) ** 0.5
                yield batch.loc[(x == y).mean(axis=1) >= bar, ["a", "b"]]

    joined = pairs.join(signatures.select(F.col("key").alias("a"), F.col("signature").alias("sa")), "a")
    joined = joined.join(signatures.select(F.col("key").alias("b"), F.col("signature").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b), by the exact sizes of intersection and union of the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    out.append(False)
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": out})

    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), "a")
    joined = joined.join(sets.select(F.col("key").alias("b"), F.col("set").alias("set_b")), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInPandas(run, "a long, b long, linked boolean")


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star.

    ``edges`` has (a, b). Nodes without edges don't appear. Each star is a grouped minimum, which is
    combined before its shuffle, and a join with one row per node on its other side.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        kept = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(kept, "u")
        small = small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, f"{name}-edges")
        told = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(now)
        now = after
        if tuple(told) == state:
            break
        state = tuple(told)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def rare_pairs(tokens: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``live`` (key, n, c, least_n, rest) that may be similar, one of them in ``rest``, of different c.

    Two sets of n and n2 shingles are similar only if they share o = percent / (100 + percent) * (n + n2)
    or more. With shingles in one order, rarest first, at most n - o of the one are missing from the
    other, so the first one that both have is among the first n - o + 1 of the one and n2 - o + 1 of the other.
    """
    df = tokens.groupBy("x").agg(F.count("*").alias("df"))
    placed = tokens.join(live, "key").join(df, "x").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("df", "x")))
    need = lambda a, b: f"ceil({percent} * ({a} + {b}) / {100 + percent})"
    heads = materialize(placed.where(f"place <= n - {need('n', 'least_n')} + 1").select("x", "key", "n", "c", "rest", F.col("place").cast("int").alias("place")), "heads")
    o = need("l.n", "r.n")
    met = heads.where("rest").alias("l").join(heads.alias("r"), F.expr(f"l.x = r.x AND l.c <> r.c AND (NOT r.rest OR l.key < r.key) AND l.place <= l.n - {o} + 1 AND r.place <= r.n - {o} + 1"))
    out = materialize(met.select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b")).distinct(), "pairs")
    forget(heads)
    return out


def links(sketches: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) between representatives, enough to give every component whole.

    Returns a table of the shared folder.
    """
    signatures = sketches.select("key", "signature")
    many = sketches.where("n_shingles > 0").select("key", F.explode("bands").alias("bucket"))
    shared = many.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(many.join(shared, "bucket").select("bucket", "key").distinct(), "buckets")
    wanted = buckets.select("key").distinct()
    sets = materialize(shingle_sets(docs.join(wanted.withColumnRenamed("key", key), key), key, text, width), "sets")

    def held_now(comp: DataFrame) -> DataFrame:
        return buckets.join(comp, buckets["key"] == comp["node"], "left").select("bucket", "key", F.coalesce("component", "key").alias("c"))

    def check(pairs: DataFrame) -> DataFrame:
        out = materialize(verified(likely(pairs, signatures, percent), sets, percent), "verified")
        gone.append(out)
        return out.where("linked").select("a", "b")

    gone: list[DataFrame] = []
    # First every member of a bucket against the smallest key of it.
    least = buckets.groupBy("bucket").agg(F.min("key").alias("pk"))
    pairs = materialize(buckets.join(least, "bucket").where("key <> pk").select(F.col("pk").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    gone.append(pairs)
    tried, found = pairs, check(pairs)
    comp = materialize(components(found), "comp")
    gone.append(comp)
    # Buckets of three and more that aren't in one component go on.
    held = held_now(comp)
    open_ = held.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 <> c1 AND size > 2").select("bucket")
    sizes = sketches.select("key", F.col("n_shingles").alias("n")).distinct()
    members = materialize(buckets.join(open_, "bucket").join(sizes, "key").select("bucket", "key", "n"), "members")
    opened = members.select("key").distinct()
    tokens = materialize(sets.join(opened, "key", "left_semi").select("key", F.explode("set").alias("x")), "tokens")
    gone += [members, tokens]
    # Shingles that no other set has make a set peripheral.
    lone = tokens.groupBy("x").agg(F.count("*").alias("df"), F.min("key").alias("key")).where("df = 1").groupBy("key").agg(F.count("*").alias("lone"))
    lone = materialize(opened.join(lone, "key", "left").select("key", F.coalesce("lone", F.lit(0)).alias("lone")), "lone")
    gone.append(lone)
    for turn in range(PIVOT_ROUNDS + 1):
        now = members.join(comp, members["key"] == comp["node"], "left").select("bucket", members["key"], "n", F.coalesce("component", members["key"]).alias("c"))
        if turn < PIVOT_ROUNDS:
            # The most central member; then another one, by a hash.
            order = F.struct(F.col("lone") / F.col("n"), "key", "c") if turn == 0 else F.struct(F.xxhash64("key", F.lit(turn)).cast("double"), "key", "c")
            pivot = now.join(lone, "key").groupBy("bucket").agg(F.min(order).alias("p")).select("bucket", F.col("p.key").alias("pk"), F.col("p.c").alias("pc"))
            pairs = now.join(pivot, "bucket").where("c <> pc").select(F.least("key", "pk").alias("a"), F.greatest("key", "pk").alias("b")).distinct()
        else:
            # Members outside their bucket's largest component: any partner that they have left has one of their rarest shingles.
            top = now.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.min("n").alias("least_n")).groupBy("bucket").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.min("least_n").alias("least_n"))
            judged = now.join(top, "bucket").withColumn("rest", F.col("c") != F.col("top"))
            left = judged.groupBy("bucket").agg(F.bool_or("rest").alias("any")).where("any").select("bucket")
            live = judged.join(left, "bucket").groupBy("key").agg(F.max("n").alias("n"), F.max("c").alias("c"), F.min("least_n").alias("least_n"), F.bool_or("rest").alias("rest"))
            pairs = rare_pairs(tokens, live, percent)
        pairs = materialize(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        gone.append(pairs)
        if pairs.isEmpty():
            continue
        tried = tried.union(pairs)
        fresh = check(pairs)
        if not fresh.isEmpty():
            found = found.union(fresh)
            if turn < PIVOT_ROUNDS:
                comp = materialize(components(found), "comp")
                gone.append(comp)
        release(docs.sparkSession)
    out = materialize(found, "links")
    forget(sets, buckets, *gone)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (smallest key reachable), kept."""
    tune(docs.sparkSession)
    drawn = materialize(sketch(docs, key, text, width, bands, rows), "sketches")
    classes = drawn.where("n_shingles > 0 AND key IS NOT NULL").groupBy("content").agg(F.min("key").alias("rep"))
    reps = drawn.join(classes, "content").where("key = rep").dropDuplicates(["key", "content"]).select("key", "n_shingles", "signature", "bands")
    edges = links(reps, docs, key, text, width, percent)
    comp = components(edges)
    by_class = classes.join(comp, classes["rep"] == comp["node"], "left").select("content", F.coalesce("component", "rep").alias("component_id"))
    by_class = materialize(by_class, "classes")
    out = drawn.select("key", "n_shingles", "content").join(by_class, "content", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
