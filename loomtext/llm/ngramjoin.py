"""Jaccard join of word n-gram sets by vertical partitioning.

N-grams have one global order, which is cut into fragments; a document's set is cut at the same
places. Partial overlaps are counted in each fragment by itself and added up. Three counts go this
way, each on far less than the one before:

(1) By document, on the first part of every set in the order of hashes. A set of n that is linked
with anything lacks ``n - ceil(p * n)`` n-grams of it at most, and what it is linked with has
``ceil(p * n)`` or more. If all sets give their first ``2 * lacking + 1``, two linked ones have
``lacking + 1`` of the smaller set's in common there; fragments tell how many others have.
(2) Documents that are left get an order by frequency, rarest n-gram first, and how many of their
n-grams any other one has; those with fewer than ``ceil(p * n)`` go.
(3) By pair: pairs that share one of their first n-grams are counted in the fragments of rare
n-grams, dropped where the rest can't make up for what is missing, and counted in the other ones.

Sets that are equal are one class. Pairs are proposed in stars: in each group of sets that share an
n-gram, everyone against the smallest, then groups that aren't in one component yet against their
most central member, then what is outside a group's largest component against all others with one
of its rarest n-grams. Links inside a component don't change it and aren't looked for; none between
components is lost, and a group of near copies costs its size, not its square.

Defined cases: null and empty texts and texts without words have no n-grams and are linked with
nothing; fewer words than ``width`` give one n-gram, the whole sequence; repeated rows are in one
class; rows of one key and different texts are one node; rows without a key take part through keyed
rows of equal words only, and have a null component otherwise; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .minhash import WordHash, _mix, components, shingle_hashes, word_split
from .store import forget, materialize, release, shuffle_width, tune, worker_cache

#: N-grams that a task holds before it deals them to fragments, documents among them, and fragments per shuffle partition.
HELD, DOCS, SPREAD = 1_000_000, 65_000, 3
#: Bits of the bitmap of keys whose texts are read again, and what stands for no key.
BITS, NO_KEY = 1 << 26, -(1 << 62)
#: Words whose hashes a worker remembers: two workers have to fit beside an executor.
WORDS = 60_000
#: Fragments of the order by frequency, and how many of them are counted before pairs are dropped.
FRAGMENTS, EARLY = 8, 3


def lacking(n: int, percent: int) -> int:
    """N-grams of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def fragment_of(x: np.ndarray, percent: int, fragments: int) -> np.ndarray:
    """The fragment of hashes: nine tenths of the fragments for the range that first parts lie in, the rest above it."""
    u, cut = x.astype(np.float64) / 2.0**64, min(0.9, 2 * (1 - percent / 100) + 0.05)
    return np.minimum(np.where(u < cut, u / cut * 0.9, 0.9 + (u - cut) / (1 - cut) * 0.1) * fragments, fragments - 1).astype(np.int64)


def drafted(docs: DataFrame, key: str, text: str, width: int, percent: int, fragments: int) -> DataFrame:
    """Rows of documents (key, n, content, met, load, place) and of fragments (load, fragment, places, hashes).

    ``met`` counts a document's n-grams that another one of its load has too. Such an n-gram is dealt
    once, without a place: a very common one costs an entry per load. The others go with their document's
    place in the load. Hashes are cut to 32 bits within a fragment; equal ones are taken for the same, so
    counts are never too small.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        hashed, part, seq = worker_cache("fewer_words", lambda: WordHash(WORDS)), TaskContext.get().partitionId(), 0

        def dealt(rows: list[tuple], firsts: list[np.ndarray]) -> pd.DataFrame:
            nonlocal seq
            load, seq = (part << 24) + seq, seq + 1
            x = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
            place = np.repeat(np.arange(len(firsts), dtype=np.uint16), [len(f) for f in firsts])
            order = np.argsort(x, kind="stable")
            x, place = x[order], place[order]
            start = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
            many = np.diff(np.r_[np.flatnonzero(start), len(x)]) > 1
            met = np.bincount(place[np.repeat(many, np.diff(np.r_[np.flatnonzero(start), len(x)]))], minlength=len(rows))
            x, place = x[start], np.where(many, np.uint16(65535), place[start])
            of = fragment_of(x, percent, fragments)
            cut = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)
            low = (x & np.uint64(0xFFFFFFFF)).astype("<u4")
            frame = pd.DataFrame(rows, columns=["key", "n", "content"]).assign(met=met, load=load, place=range(len(rows)))
            parts = [(load, of[a], place[a:z].astype("<u2").tobytes(), low[a:z].tobytes()) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            return pd.concat([frame, pd.DataFrame(parts, columns=["load", "fragment", "places", "hashes"])], ignore_index=True).astype({c: "Int64" for c in ("key", "n", "met", "load", "place", "fragment")})

        rows, firsts, held = [], [], 0
        for batch in batches:
            for k, t in zip(batch["k"], batch["t"], strict=True):
                w = hashed(word_split(t))
                s = np.sort(_mix(shingle_hashes(w, width)))
                first = s[: 2 * lacking(len(s), percent) + 1]
                rows.append((None if k == NO_KEY else k, len(s), xxhash.xxh3_128_digest(w.tobytes()) if len(w) else b""))
                firsts.append(first)
                held += len(first)
                if held > HELD or len(rows) >= DOCS:
                    yield dealt(rows, firsts)[SKETCH]
                    rows, firsts, held = [], [], 0
        if rows:
            yield dealt(rows, firsts)[SKETCH]

    source = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    return source.mapInPandas(run, "key long, n long, content binary, met long, load long, place long, fragment long, places binary, hashes binary")


SKETCH = ["key", "n", "content", "met", "load", "place", "fragment", "places", "hashes"]


def met_elsewhere(parts: DataFrame) -> DataFrame:
    """(load, place, met): how many n-grams of a document a document of another load has, added up over the fragments.

    A fragment's counts leave it as one row for each load.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["hashes"]), "<u4")
        place = np.frombuffer(b"".join(pdf["places"]), "<u2").astype(np.int64)
        row = np.repeat(np.arange(len(pdf)), [len(h) // 4 for h in pdf["hashes"]])
        order = np.argsort(x, kind="stable")
        start = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
        size = np.diff(np.r_[start, len(x)])
        shared = order[np.repeat(size > 1, size)]
        shared = shared[place[shared] != 65535]
        which, n = np.unique(row[shared] * 65536 + place[shared], return_counts=True)
        cut = np.flatnonzero(np.r_[True, which[1:] // 65536 != which[:-1] // 65536]) if len(which) else np.zeros(0, np.int64)
        at, ends = which // 65536, np.r_[cut[1:], len(which)][: len(cut)]
        low, n = (which % 65536).astype("<u2"), n.astype("<u4")
        return pd.DataFrame({"load": pdf["load"].to_numpy()[at[cut]], "places": [low[a:z].tobytes() for a, z in zip(cut, ends, strict=True)], "counts": [n[a:z].tobytes() for a, z in zip(cut, ends, strict=True)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.bincount(np.frombuffer(b"".join(pdf["places"]), "<u2"), np.frombuffer(b"".join(pdf["counts"]), "<u4"))
        place = np.flatnonzero(total)
        return pd.DataFrame({"load": pdf["load"].iloc[0], "place": place, "met": total[place].astype(np.int64)})

    counts = parts.groupBy("fragment").applyInPandas(count, "load long, places binary, counts binary")
    return counts.groupBy("load").applyInPandas(add, "load long, place long, met long")


def full_sets(docs: DataFrame, live: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, set): the n-grams of the rows of ``live`` (id, key, content, n), read from their whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashed = worker_cache("fewer_words", lambda: WordHash(WORDS))
        for batch in batches:
            words = [hashed(word_split(t)) for t in batch["t"]]
            yield pd.DataFrame({"key": batch["k"], "content": [xxhash.xxh3_128_digest(w.tobytes()) for w in words], "set": [_mix(shingle_hashes(w, width)).view(np.int64) for w in words]})

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).where("k IS NOT NULL")
    # A bitmap of hashed keys, BITS / 8 bytes whatever their number, lets few other texts through; none is shuffled.
    h = F.pmod(F.xxhash64("k"), F.lit(BITS))
    placed = lambda d: d.withColumn("b_", F.floor(h / 32768).cast("long")).withColumn("p_", (h % 32768).cast("long"))
    bitmap = placed(live.select(F.col("key").alias("k"))).groupBy("b_").agg(F.expr("bitmap_construct_agg(p_)").alias("bits_"))
    byte = F.expr("cast(conv(hex(substring(bits_, cast(p_ div 8 as int) + 1, 1)), 16, 10) as int)")
    near = placed(rows).join(F.broadcast(bitmap), "b_").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(p_ % 8 as int))")) != 0)
    read = near.select("k", "t").mapInPandas(run, "key long, content binary, set array<long>")
    return read.join(live, ["key", "content"]).groupBy("id").agg(F.first("n").alias("n"), F.first("set").alias("set"))


def ranked(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, lone, grams): sets that may be linked, n-grams that others have in the global order with their fragments."""
    gram = sets.select("id", "n", F.explode("set").alias("x"))
    df = materialize(gram.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    # Fragments of equal numbers of entries: by frequency, and by hash among n-grams of one frequency.
    by = df.groupBy("df").agg((F.count("*") * F.col("df")).alias("entries"))
    total = by.agg(F.coalesce(F.sum("entries"), F.lit(1)).alias("total"))
    # Frequencies that differ are few: k of them take k * k / 2 entries at least.
    before = by.withColumn("before", F.coalesce(F.sum("entries").over(Window.orderBy("df").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = (F.col("before") + F.col("entries") * (F.col("x") / 2.0**64 + 0.5)) / F.col("total") * FRAGMENTS
    cut = df.join(before, "df").crossJoin(F.broadcast(total)).select("x", "df", F.least(F.floor(place), F.lit(FRAGMENTS - 1)).cast("int").alias("f"))
    held = gram.join(materialize(cut, "fragments"), "x").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "x", "f"))).alias("g"))
    kept = held.where(F.size("g") * 100 >= percent * F.col("n"))
    grams = F.transform("g", lambda g: F.struct(g["x"].alias("x"), g["f"].alias("f")))
    return materialize(kept.select("id", "n", (F.col("n") - F.size("g")).alias("lone"), grams.alias("grams")), "ranked")


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / (100 + percent))


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by overlaps counted in each fragment and added up."""
    size = segments.groupBy("id").agg(F.first("n").alias("n"), F.sum(F.when(F.col("f") >= EARLY, F.size("xs")).otherwise(0)).alias("rest"))
    size = materialize(size, "sizes")
    side = lambda c: size.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("rest").alias(f"rest{c}"))

    def counted(todo: DataFrame, which: Column) -> DataFrame:
        part = segments.where(which)
        one = todo.select("a", "b").join(part.select(F.col("id").alias("a"), "f", F.col("xs").alias("xa")), "a")
        both = one.join(part.select(F.col("id").alias("b"), "f", F.col("xs").alias("xb")), ["b", "f"])
        return both.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("xa", "xb"))).alias("o"))

    early = todo = pairs.select("a", "b")
    early = todo.join(counted(todo, F.col("f") < EARLY), ["a", "b"], "left").select("a", "b", F.coalesce("o", F.lit(0)).alias("early"))
    early = early.join(side("a"), "a").join(side("b"), "b").where(F.col("early") + F.least("resta", "restb") >= least_overlap(F.col("na"), F.col("nb"), percent))
    early = materialize(early, "early")
    late = early.join(counted(early, F.col("f") >= EARLY), ["a", "b"], "left").withColumn("both", F.col("early") + F.coalesce("o", F.lit(0)))
    out = materialize(late.where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "linked")
    forget(early, size)
    return out


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between ids, enough to give every component whole."""
    table = ranked(sets, percent)
    segment = table.select("id", "n", F.explode("grams").alias("g")).groupBy("id", "n", F.col("g.f").alias("f")).agg(F.collect_list("g.x").alias("xs"))
    segments = materialize(segment, "segments")
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("lone")
    heads = table.where(most > 0).select("id", "n", "lone", F.posexplode(F.slice("grams", F.lit(1), most.cast("int"))).alias("p", "g"))
    heads = heads.select(F.col("g.x").alias("x"), "id", "n", "lone", (F.col("lone") + F.col("p") + 1).alias("place"))
    shared = heads.groupBy("x").agg(F.count("*").alias("df"), F.min(F.struct("id", "n", "place")).alias("least")).where("df > 1")
    shared = materialize(shared, "shared")
    heads = materialize(heads.join(shared.select("x"), "x"), "heads")

    def fitting(met: DataFrame) -> DataFrame:
        """Of rows (a, na, pa, b, nb, pb) the pairs that may be linked if this is the first n-gram that both have."""
        need = least_overlap(F.col("na"), F.col("nb"), percent)
        fit = (F.least("na", "nb") >= need) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 >= need)
        return met.where(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    other = [F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb")]
    found = tried = comp = None
    for turn in range(3):
        if turn == 0:
            met = heads.join(shared.select("x", "least"), "x").where(F.col("id") != F.col("least.id")).select(F.col("least.id").alias("a"), F.col("least.n").alias("na"), F.col("least.place").alias("pa"), *other)
        else:
            now = heads.join(comp, heads["id"] == comp["node"], "left").select(*[heads[c] for c in heads.columns], F.coalesce("component", "id").alias("c"))
            now = materialize(now, "members")
            sizes = materialize(now.groupBy("x", "c").agg(F.count("*").alias("m"), F.min(F.struct(F.col("lone") / F.col("n"), "id", "n", "place")).alias("best")), "group-sizes")
            open_ = sizes.groupBy("x").agg(F.max_by(F.struct("c", "best"), F.struct("m", "c")).alias("top"), F.min("best").alias("best"), F.count("*").alias("held")).where("held > 1")
            open_ = materialize(open_.select("x", F.col("top.c").alias("top"), F.col("best.id").alias("a"), F.col("best.n").alias("na"), F.col("best.place").alias("pa")), "open")
            if turn == 1:
                central = open_.join(comp, open_["a"] == comp["node"], "left").withColumn("ca", F.coalesce("component", "a"))
                met = now.join(materialize(central.select("x", "a", "na", "pa", "ca"), "central"), "x").where("c <> ca").select("a", "na", "pa", *other)
            else:
                group = now.join(open_.select("x", "top"), "x")
                rest = group.where("c <> top").select("x", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("c").alias("ca"))
                met = rest.join(group.select("x", "c", *other), "x").where("c <> ca")
        pairs = fitting(met)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        fresh = linked(pairs, segments, percent)
        found = fresh if found is None else found.union(fresh)
        tried = pairs if tried is None else tried.union(pairs)
        if turn < 2:
            comp = materialize(components(found), "comp")
        release(sets.sparkSession)
    out = materialize(found, "links")
    forget(table, segments, heads)
    return out


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links)."""
    spark = docs.sparkSession
    tune(spark)
    drawn = materialize(drafted(docs, key, text, width, percent, SPREAD * shuffle_width(spark)), "drafts")
    rows = drawn.where("fragment IS NULL").select("key", "n", "content", "met", "load", "place")
    met = met_elsewhere(drawn.where("fragment IS NOT NULL").select("load", "fragment", "places", "hashes"))
    rows = materialize(rows.join(met.withColumnRenamed("met", "more"), ["load", "place"], "left").select("key", "n", "content", (F.col("met") + F.coalesce("more", F.lit(0))).alias("met")), "rows")
    keyed = rows.where("n > 0 AND key IS NOT NULL")
    # One row for each set of equal word sequences that may be linked with another.
    classes = materialize(keyed.groupBy("content").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.max("met").alias("met")), "classes")
    least = F.ceil(F.col("n") * percent / 100)
    live = classes.where(F.col("met") > least - F.ceil(least * percent / 100)).select(F.col("rep").alias("key"), "content", "n")
    live = materialize(live.withColumn("id", F.monotonically_increasing_id()), "live")
    sets = materialize(full_sets(docs, live, key, text, width), "sets")
    release(spark)
    found = links(sets, percent)
    rep = lambda c: live.select(F.col("id").alias(c), F.col("key").alias(f"k{c}"))
    edges = found.join(rep("a"), "a").join(rep("b"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    # A key with several texts ties their classes together.
    split = keyed.groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi").select("key")
    tied = keyed.join(split, "key").join(classes.select("content", "rep"), "content").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    comp = materialize(components(edges.union(tied)), "comp")
    by_class = classes.join(comp, classes["rep"] == comp["node"], "left").select("content", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("key", "n", "content").join(materialize(by_class, "components"), "content", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
