"""Conversation prefix trie: every distinct sequence of first turns is a node.

Steps: (1) turns are sorted by ranges of (conversation, order), so a conversation of any length
is spread over tasks; numpy scans each range's rows into polynomial fingerprints of all prefixes,
and what a conversation left behind in earlier ranges is carried in; (2) prefixes of equal depth
and fingerprint are candidates of one node, its smallest conversation the representative;
(3) each member's turn at that depth is held against the representative's, and so is the
fingerprint that the prefix without it has; members that differ are split off, with all their
deeper prefixes, and are grouped again until no group has a differing one. As that holds for
every depth, members of a node agree turn by turn; (4) a node is owned by its representative,
which is a member of all the node's ancestors: so what an owner has at and below a depth, summed
over the members of the node at that depth, is the node's whole subtree.

Defined cases: a null role or text is empty; turns without an order come first, turns of equal
order by role, then text; repeated turns all count; rows without a conversation belong to none and
are left out; conversations without turns are given in ``convs`` and are members of the root; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import forget, materialize, shuffle_width, tune

#: Two primes below 2 ** 31 and the bases of their polynomials; a fingerprint has 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (1481765933, 987654361)
#: Turns of a conversation summed in one window, and ids hashed in one chunk.
BLOCK, CHUNK = 1024, 4096
#: The SHA-256 of no conversations.
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Powers:
    """Powers of a base, kept up to the largest exponent asked for."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.held = np.uint64(base), np.uint64(prime), np.ones(1, np.uint64)

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        while len(exponents) and len(self.held) <= exponents.max():
            step = np.uint64(pow(int(self.base), len(self.held), int(self.prime)))
            self.held = np.concatenate([self.held, self.held * step % self.prime])
        return self.held[exponents]


def scanned(turns: DataFrame, bits: int) -> DataFrame:
    """(part, c, j, role, text, size, f0, f1, g0, g1): prefix sums within a range, with the turn (f) and before it (g)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        part, powers = TaskContext.get().partitionId(), [Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
        last, count, sums = None, 0, [0, 0]
        for batch in batches:
            if not len(batch):
                continue
            c = batch["c"].to_numpy()
            first = np.r_[c[0] != last, c[1:] != c[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(c)), -1))
            # Rows of the conversation that the last batch ended in go on from its count and sums.
            open_ = start < 0
            j = np.where(open_, np.arange(len(c)) + count, np.arange(len(c)) - start)
            h = np.fromiter((xxhash.xxh3_64_intdigest(f"{len(r)}:{r}{t}") & ((1 << bits) - 1) for r, t in zip(batch["role"], batch["text"], strict=True)), np.uint64, len(c))
            out = {"part": part, "c": c, "j": j, "role": batch["role"], "text": batch["text"], "size": batch["text"].str.len()}
            for m, (power, prime) in enumerate(zip(powers, PRIMES, strict=True)):
                p = np.uint64(prime)
                term = (h % p + np.uint64(1)) % p * power(j) % p
                total = np.cumsum(term)
                base = np.where(open_, np.uint64(0), np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0)))
                f = (total - base + np.where(open_, np.uint64(sums[m]), np.uint64(0))) % p
                out[f"f{m}"], out[f"g{m}"] = f.astype(np.int64), ((f + p - term) % p).astype(np.int64)
                sums[m] = int(f[-1])
            last, count = c[-1], int(j[-1]) + 1
            yield pd.DataFrame(out)

    by = [F.col(x).asc_nulls_first() for x in turns.columns]
    ranged = turns.repartitionByRange(shuffle_width(turns.sparkSession), *by).sortWithinPartitions(*by)
    return ranged.select("c", "role", "text").mapInPandas(run, "part long, c long, j long, role string, text string, size long, f0 long, f1 long, g0 long, g1 long")


def carried(scan: DataFrame) -> DataFrame:
    """(c, part, off, b0, b1, m0, m1) for conversations in several ranges: turns and sums before the range, and the bases to the power off.

    A range has two such conversations at most, its first and its last one, so this table is as small as the number of ranges.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, off, sums = [], 0, [0, 0]
        for r in pdf.sort_values("part").itertuples():
            up = [pow(b, off, p) for b, p in zip(BASES, PRIMES, strict=True)]
            out.append((r.c, r.part, off, *sums, *up))
            sums = [(s + f * u) % p for s, f, u, p in zip(sums, (r.f0, r.f1), up, PRIMES, strict=True)]
            off += r.j + 1
        return pd.DataFrame(out, columns=["c", "part", "off", "b0", "b1", "m0", "m1"])

    spread = scan.groupBy("c").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("c")
    parts = scan.join(spread, "c", "left_semi").groupBy("c", "part").agg(F.max_by(F.struct("j", "f0", "f1"), "j").alias("s")).select("c", "part", "s.*")
    return materialize(parts.groupBy("c").applyInPandas(run, "c long, part long, off long, b0 long, b1 long, m0 long, m1 long"), "carried")


def fingerprinted(turns: DataFrame, bits: int) -> DataFrame:
    """(c, d, f, pf, role, text, size): every prefix, its fingerprint and that of the prefix without its last turn."""
    scan = materialize(scanned(turns, bits), "scan")
    more = F.broadcast(carried(scan))
    off = F.coalesce("off", F.lit(0))
    whole = lambda x, m: (F.coalesce(f"b{m}", F.lit(0)) + F.col(f"{x}{m}") * F.coalesce(f"m{m}", F.lit(1))) % PRIMES[m]
    both = lambda x: F.shiftleft(whole(x, 0), 31) + whole(x, 1)
    return scan.join(more, ["c", "part"], "left").select("c", (off + F.col("j") + 1).alias("d"), both("f").alias("f"), both("g").alias("pf"), "role", "text", "size")


def grouped(entries: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(c, d, f, pf, s, ps, size): s and ps tell apart groups of equal fingerprint whose turns differ, here and one depth above."""
    keys, turn = entries.select("c", "d", "f", "pf", F.lit(0).alias("s"), F.lit(0).alias("ps"), "size"), entries.select("c", "d", "role", "text")
    for turns_taken in range(1, max_rounds):
        shared = keys.groupBy("d", "f", "s").agg(F.min("c").alias("c"), F.count("*").alias("n")).where("n > 1").drop("n")
        full = keys.join(turn, ["c", "d"]) if turns_taken > 1 else entries.withColumns({"s": F.lit(0), "ps": F.lit(0)})
        rep = full.join(shared, ["c", "d", "f", "s"]).select("d", "f", "s", F.col("pf").alias("rpf"), F.col("ps").alias("rps"), F.col("role").alias("rrole"), F.col("text").alias("rtext"))
        rep = materialize(rep, "representatives")
        bad = full.join(rep, ["d", "f", "s"]).where("role <> rrole OR text <> rtext OR pf <> rpf OR ps <> rps")
        bad = materialize(bad.groupBy("c").agg(F.min("d").alias("from_")), "differing")
        forget(rep)
        if bad.isEmpty():
            return keys
        moved = keys.join(bad, "c", "left")
        after = lambda depth, old: F.when(F.col("from_") <= depth, F.lit(turns_taken)).otherwise(F.col(old))
        keys = materialize(moved.select("c", "d", "f", "pf", after(F.col("d"), "s").alias("s"), after(F.col("d") - 1, "ps").alias("ps"), "size"), "keys")
    raise RuntimeError("groups of equal fingerprint did not settle")


def suffix_sums(entries: DataFrame, values: list[str], name: str) -> DataFrame:
    """``entries`` (c, d and others) with each of ``values`` summed over the conversation from d on.

    Conversations are cut into blocks of depths: sums within a block, then over the blocks, which are ``BLOCK`` times fewer.
    """
    cut = entries.withColumn("b_", F.expr(f"d div {BLOCK}"))
    within = Window.partitionBy("c", "b_").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("c").orderBy(F.col("b_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumns({v: F.sum(v).over(within) for v in values})
    totals = cut.groupBy("c", "b_").agg(*[F.sum(v).alias(v) for v in values]).select("c", "b_", *[F.sum(v).over(later).alias(f"{v}_later") for v in values])
    # Only conversations of several blocks have anything below one.
    totals = materialize(totals.where(" OR ".join(f"{v}_later IS NOT NULL" for v in values)), name)
    return inside.join(totals, ["c", "b_"], "left").select(*[c for c in entries.columns if c not in values], *[(F.col(v) + F.coalesce(f"{v}_later", F.lit(0))).alias(v) for v in values])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(rep, d, ends_sha256): the SHA-256 of a node's ids, ascending, decimal, joined by commas.

    Ids are sorted by ranges and joined to chunks there, so that a node of many ends is read as few long rows, one after another.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if len(batch):
                rep, d = batch["rep"].to_numpy(), batch["d"].to_numpy()
                cut = np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (d[1:] != d[:-1])])
                spans = [(a, min(a + CHUNK, z)) for lo, z in zip(cut, [*cut[1:], len(rep)], strict=True) for a in range(lo, z, CHUNK)]
                ids = batch["c"].astype(str).to_numpy()
                yield pd.DataFrame({"rep": [rep[a] for a, _ in spans], "d": [d[a] for a, _ in spans], "part": part, "seq": range(seq, seq + len(spans)), "ids": [",".join(ids[a:z]) for a, z in spans]})
                seq += len(spans)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if node != (r.rep, r.d):
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (r.rep, r.d), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(r.ids.encode())
            yield pd.DataFrame(out, columns=["rep", "d", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["rep", "d", "ends_sha256"])

    width = shuffle_width(ends.sparkSession)
    ranged = ends.repartitionByRange(width, "rep", "d", "c").sortWithinPartitions("rep", "d", "c").select("rep", "d", "c")
    parts = ranged.mapInPandas(chunks, "rep long, d long, part long, seq long, ids string")
    return parts.repartition(width, "rep", "d").sortWithinPartitions("rep", "d", "part", "seq").mapInPandas(hashes, "rep long, d long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame | None = None, conv: str = "conv_id", order: tuple[str, ...] = ("turn",), role: str = "role", text: str = "text", bits: int = 64) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``saved_tokens``: over the node's subtree, (members - 1) times the code points of a node's last
    text. ``ends_sha256``: of the members with no further turn. ``bits`` of a turn's hash are used
    (fewer give collisions, for tests).
    """
    tune(turns.sparkSession, 4096)
    named = {"c": F.col(f"`{conv}`").cast("long"), **{f"o{k}": F.col(f"`{o}`") for k, o in enumerate(order)}, "role": F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), "text": F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))}
    plain = materialize(turns.select(*[v.alias(k) for k, v in named.items()]).where("c IS NOT NULL"), "turns")
    entries = materialize(fingerprinted(plain, bits), "prefixes")
    keys = grouped(entries)
    every = keys.select("c")
    if convs is not None:
        every = every.union(convs.select(F.col(f"`{conv}`").cast("long").alias("c")).where("c IS NOT NULL"))
    zero, none = F.lit(0).cast("long"), F.lit(0)
    keys = keys.union(every.distinct().select("c", zero.alias("d"), zero.alias("f"), F.lit(-1).cast("long").alias("pf"), none.alias("s"), none.alias("ps"), zero.alias("size")))
    length = materialize(keys.groupBy("c").agg(F.max("d").alias("length")), "lengths")
    keys = materialize(keys.join(length, "c"), "keys")
    nodes = keys.groupBy("d", "f", "s").agg(F.min("c").alias("rep"), F.count("*").alias("n_convs"), F.max("length").alias("deepest"), F.min("size").alias("size"), F.min("pf").alias("pf"), F.min("ps").alias("ps"))
    nodes = materialize(nodes, "nodes")
    own = nodes.select("d", "f", "s", "rep", (F.col("deepest") == F.col("d")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    owned = keys.select("c", "d", "f", "s", "length").join(own, ["d", "f", "s"])
    mine = F.col("c") == F.col("rep")
    valued = materialize(owned.select("c", "d", "rep", "length", *[F.when(mine, F.col(v)).otherwise(F.lit(0)).alias(v) for v in ("leaf", "saved")]), "valued")
    sums = suffix_sums(valued.select("c", "d", "rep", "leaf", "saved"), ["leaf", "saved"], "later")
    totals = sums.groupBy("rep", "d").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = materialize(valued.where("d = length").select("rep", "d", "c"), "ends")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pf").alias("f"), F.col("ps").alias("s")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("f").alias("pf"), F.col("s").alias("ps"), F.col("rep").alias("parent"))
    out = nodes.join(above, ["d", "pf", "ps"], "left").join(children, ["d", "f", "s"], "left").join(totals, ["rep", "d"]).join(ends_digest(ends), ["rep", "d"], "left")
    return out.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
