"""Exact repeated substrings of at least L bytes, over a whole corpus, by suffix arrays.

Every L-byte window of a text belongs to one anchor: the leftmost least hash of the short
k-byte strings inside it. The anchor depends on the window's bytes alone, so equal windows
have equal anchors at equal offsets, wherever they stand. The windows of one anchor in one
text are consecutive and make a segment. This deals all windows of the corpus into groups that
can be searched apart from each other:

1. segments are counted by (anchor, length, 128-bit hash of the bytes); a segment that occurs
   twice is repeated as a whole, whatever the group's size, and needs no text;
2. an anchor with a single segment is unique;
3. what is left, anchors with several different segments (the edges of passages, and edited
   places), goes with its bytes to shards. Each shard sorts its suffixes by Larsson-Sadakane
   refinement in numpy up to depth L, takes common prefixes by Kasai's walk over the bytes, and marks
   windows that have an equal neighbour;
4. an anchor with more segments than a shard may hold is split over shards. Each publishes its
   distinct windows as sorted runs of 128-bit hashes, cut by hash range; a range's runs are merged
   in pairs by binary search, which finds those that have an equal one in another shard.

Anchors are chosen by a rolling hash, which decides only where a window is searched. Equality of
segments and published windows is that of XXH3's 128 bits over their bytes.

Then repeated windows become byte runs per text, and the texts are cut.

Defined cases: a null text is an empty one; a text shorter than L has no window; equal rows
repeat each other, also when their keys are equal; repetition inside a text counts; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, materialize, release, tune

#: Bytes of the strings that compete for anchor.
K = 48
#: Segments that one shard holds of one anchor, and bytes of text that a shard holds on average.
PER_ANCHOR, SHARD_BYTES = 1000, 1 << 20

_rng = np.random.default_rng(20)
#: Random odd multipliers and byte values of the rolling hashes (two, for 128 bits), with the multipliers' inverses modulo 2 ** 64.
BASES = [int(x) | 5 for x in _rng.integers(1 << 60, 1 << 62, 2)]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]
VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the multipliers and their inverses, grown as texts need them."""

    def __init__(self):
        self.n, self.up, self.down = 0, [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.uint64)] * 2

    def need(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            for i in (0, 1):
                for kind, base in ((self.up, BASES[i]), (self.down, INVERSES[i])):
                    out = np.empty(self.n, np.uint64)
                    out[0] = 1
                    have = 1
                    while have < self.n:
                        step = min(have, self.n - have)
                        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
                        have += step
                    kind[i] = out


def prefix_hashes(data: np.ndarray, powers: _Powers, which: int) -> np.ndarray:
    """h with h[j] - h[i] = sum of value[data[t]] * base ** t over i <= t < j."""
    powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[which][data] * powers.up[which][: len(data)], out=out[1:])
    return out


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, powers: _Powers, which: int) -> np.ndarray:
    """Hash of data[lo:hi], whatever the place."""
    return _mix((h[hi] - h[lo]) * powers.down[which][lo])


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``w``, by block-wise running minima."""
    n = len(x)
    m = -(-n // w) * w
    order = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    order[:n] = x
    blocks = order.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - w + 1)
    least = np.minimum(right[starts], left[starts + w - 1])
    # The leftmost place that holds the minimum: the next place >= start with that value.
    hit = np.flatnonzero(least != np.concatenate([[~least[0]], least[:-1]])) if len(least) else np.zeros(0, np.int64)
    place = np.empty(len(least), np.int64)
    for a, b in zip(hit, [*hit[1:], len(least)], strict=True):
        at = a + np.flatnonzero(x[a : b + w - 1] == least[a])
        if len(at) == 1:
            place[a:b] = at[0]
        else:
            place[a:b] = at[np.searchsorted(at, np.arange(a, b))]
    return place


def digests(text: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of text[first:end], as two columns; equal bytes are known by these, wherever they stand."""
    from xxhash import xxh3_128_digest

    view = memoryview(text)
    return np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def segments(data: np.ndarray, length: int, powers: _Powers) -> dict[str, np.ndarray] | None:
    """The segments of one text: first window, windows, anchor's offset from the first window, anchor hash, segment hashes."""
    if len(data) < length:
        return None
    h0 = prefix_hashes(data, powers, 0)
    at = np.arange(len(data) - K + 1)
    anchors = range_hash(h0, at, at + K, powers, 0)
    place = sliding_argmin(anchors, length - K + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [len(place)]]))
    anchor = place[first]
    h = digests(data.tobytes(), first, first + count - 1 + length)
    return {"first": first, "count": count, "offset": anchor - first, "anchor": anchors[anchor], "h0": h[:, 0], "h1": h[:, 1]}


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of a byte array by their first ``depth`` bytes, by Larsson-Sadakane refinement.

    Ranks double the compared length in each round; only suffixes in groups that are still
    unsorted are sorted again. Suffixes equal to that depth keep one rank.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    h = 8
    bounds = np.flatnonzero(np.concatenate([fresh, [True]]))
    size = np.diff(bounds)
    open_ = bounds[:-1][size > 1]
    open_n = size[size > 1]
    while h < depth and len(open_):
        total = int(open_n.sum())
        slot = np.repeat(open_ - np.concatenate([[0], np.cumsum(open_n)[:-1]]), open_n) + np.arange(total)
        suffix = order[slot]
        # Group and second rank in one number: both are at most n.
        nxt = suffix + h
        both = np.repeat(np.arange(len(open_)), open_n) * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        new = np.argsort(both)
        suffix, both = suffix[new], both[new]
        order[slot] = suffix
        cut = np.concatenate([[True], both[1:] != both[:-1]])
        at = np.flatnonzero(cut)
        head = slot[at]
        rank[suffix] = head[np.cumsum(cut) - 1]
        size = np.diff(np.concatenate([at, [total]]))
        open_, open_n = head[size > 1], size[size > 1]
        h *= 2
    return order, rank


def kasai(data: np.ndarray, order: np.ndarray, most: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix of the order with the one before it, up to ``most``; 0 where either isn't ``wanted``.

    Kasai's walk in text order, on bytes: if the next suffix's predecessor is the next one too, it shares one
    byte less. Such suffixes make a chain; only the bytes of a chain's head are compared, eight at a
    time, as far as the chain needs, and for all chains together. Where a chain runs over
    a difference, its next suffix becomes a head.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    ok = before >= 0
    if wanted is not None:
        ok &= wanted
        ok[ok] = wanted[before[ok]]
    at = np.flatnonzero(ok)
    out = np.zeros(n, np.int64)
    if not len(at):
        return out
    you = before[at]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (you[1:] != you[:-1] + 1)]))
    last = np.concatenate([head[1:], [len(at)]]) - 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    got = np.zeros(len(at), np.int64)
    while len(head):
        a, b = at[head], you[head]
        room = np.minimum(last - head + most, n - np.maximum(a, b))
        same = np.zeros(len(head), np.int64)
        open_ = np.flatnonzero(room > 0)
        while len(open_):
            x, y = a[open_] + same[open_], b[open_] + same[open_]
            differ = word[x] != word[y]
            step = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            same[open_] = np.minimum(same[open_] + step, room[open_])
            open_ = open_[(step == 8) & (same[open_] < room[open_])]
        # Those of a chain up to the difference follow from the head; the one there shares nothing.
        reach = np.minimum(np.minimum(last, head + same), head + np.maximum(same, 0))
        size = reach - head + 1
        slot = np.repeat(head - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        got[slot] = np.repeat(same + head, size) - slot
        more = reach < last
        head, last = reach[more] + 1, last[more]
    out_at = np.empty(n, np.int64)
    out_at[order] = np.arange(n)
    out[out_at[at]] = np.minimum(got, most)
    return out


def repeated_windows(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For segments of one shard: per segment a mask of its windows that occur at least twice in the shard."""
    # A window lies inside one segment, so the separator may be any byte; UTF-8 has no 255.
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    window = np.zeros(len(data), bool)
    for s, c in zip(start, counts, strict=True):
        window[s : s + c] = True
    order, _ = suffix_array(data, length)
    equal = kasai(data, order, length, window) >= length
    mark = np.zeros(len(data), bool)
    mark[order[equal]] = True
    mark[order[:-1][equal[1:]]] = True
    return [mark[s : s + c] for s, c in zip(start, counts, strict=True)]


#: A window of a split anchor as it is published: its hash, its text, its place, 1 if it has no partner at home.
WINDOW = np.dtype([("h0", "<u8"), ("h1", "<u8"), ("c0", "<u8"), ("c1", "<u8"), ("first", "<i4"), ("alone", "u1")])
#: Windows of a merging task on average.
MERGE_WINDOWS = 400_000


SEGMENT = "content binary, doc long, first int, count int, offset int, anchor long, h0 long, h1 long"


def _cut(docs: DataFrame, length: int) -> DataFrame:
    names = {"first": np.int32, "count": np.int32, "offset": np.int32, "anchor": np.int64, "h0": np.int64, "h1": np.int64}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for batch in batches:
            who: list[int] = []
            out: dict[str, list[np.ndarray]] = {k: [] for k in names}
            for i, t in enumerate(batch["t"]):
                s = segments(np.frombuffer(t, np.uint8), length, powers)
                if s is not None:
                    who += [i] * len(s["first"])
                    for k in names:
                        out[k].append(s[k])
            if who:
                table = pd.DataFrame({"content": batch["content"].to_numpy()[who], "doc": batch["doc"].to_numpy()[who]})
                for k, kind in names.items():
                    x = np.concatenate(out[k])
                    table[k] = x.view(np.int64) if x.dtype == np.uint64 else x.astype(kind)
                yield table

    return docs.select("content", "doc", "t").mapInPandas(run, SEGMENT)


def _texts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Segments with their bytes, read from one text that has them."""

    listed = wanted.groupBy("content", "doc").agg(F.collect_list(F.struct("anchor", "part", "first", "count", "offset", "h0", "h1")).alias("s"))
    joined = docs.join(listed, ["content", "doc"])
    flat = joined.select("content", F.explode("s").alias("s"), "t")
    flat = flat.select("content", "s.*", F.expr("substring(t, first + 1, count - 1 + %d)" % length).alias("bytes"))
    return flat.select("anchor", "part", "content", "first", "count", "offset", "h0", "h1", "bytes")


def _search(shards: DataFrame, length: int, ranges: int) -> DataFrame:
    """(content, first, count) of repeated windows of each shard, and (range, data): its sorted runs of published windows."""
    names = ["content", "first", "count", "range", "data"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["content", "first"])
        rows: list[tuple] = []
        told: list[np.ndarray] = []
        texts, counts = [bytes(b) for b in group["bytes"]], group["count"].tolist()
        masks = repeated_windows(texts, counts, length)
        split = group["parts"].to_numpy() > 1
        for i, (content, first, mask) in enumerate(zip(group["content"], group["first"], masks, strict=True)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                rows.append((content, first + int(a), int(b - a), 0, None))
            if split[i]:
                at = np.arange(len(mask))
                out = np.empty(len(mask), WINDOW)
                out["h0"], out["h1"] = digests(texts[i], at, at + length).T
                out["c0"], out["c1"] = np.frombuffer(content, "<u8")
                out["first"], out["alone"] = first + at, ~mask
                told.append(out)
        if told:
            every = np.concatenate(told)
            # Of windows that are equal at home one speaks for all.
            every = every[np.lexsort((every["alone"], every["h1"], every["h0"]))]
            every = every[np.concatenate([[True], (every["h0"][1:] != every["h0"][:-1]) | (every["h1"][1:] != every["h1"][:-1])])]
            part = (every["h0"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            bounds = np.searchsorted(part, np.arange(ranges + 1))
            rows += [(None, None, None, r, every[bounds[r] : bounds[r + 1]].tobytes()) for r in range(ranges) if bounds[r] < bounds[r + 1]]
        out_ = pd.DataFrame(rows, columns=names)
        return out_.astype({"first": "Int32", "count": "Int32", "range": "Int32"})

    return shards.groupBy("shard").applyInPandas(run, "content binary, first int, count int, range int, data binary")


def meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted runs into one by binary search of the second's windows in the first: (run, hits in a, hits in b).

    Each run has a window once. Of a window in both the merged run keeps both, next to each other.
    """
    lo, hi = np.searchsorted(a["h0"], b["h0"], "left"), np.searchsorted(a["h0"], b["h0"], "right")
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    at = lo.copy()
    some = np.flatnonzero(hi > lo)
    while len(some):
        # Windows with one first half are told apart by the second.
        same = a["h1"][at[some]] == b["h1"][some]
        in_a[at[some[same]]] = in_b[some[same]] = True
        # A run of several shards has a window as often as it met it.
        at[some] += 1
        some = some[at[some] < hi[some]]
    out = np.empty(len(a) + len(b), a.dtype)
    place = hi + np.arange(len(b))
    free = np.ones(len(out), bool)
    free[place] = False
    out[free], out[place] = a, b
    return out, in_a, in_b


def _merge(published: DataFrame) -> DataFrame:
    """Windows of split anchors that have an equal one in another shard: the sorted runs of a range are merged in pairs, by binary search."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(d, WINDOW).copy() for d in group["data"]]
        while len(runs) > 1:
            merged = []
            for x, y in zip(runs[::2], runs[1::2], strict=False):
                both, in_x, in_y = meet(x, y)
                if in_y.any():
                    # Equal windows were marked at both places; ``alone`` of 2 is a window that was met.
                    x["alone"][in_x & (x["alone"] == 1)] = 2
                    y["alone"][in_y & (y["alone"] == 1)] = 2
                    both, _, _ = meet(x, y)
                merged.append(both)
            runs = merged + ([runs[-1]] if len(runs) % 2 else [])
        found = runs[0][runs[0]["alone"] == 2]
        found = np.sort(found, order=["c0", "c1", "first"])
        # Neighbouring windows of one text make a run.
        head = np.flatnonzero(np.concatenate([[True], (found["c0"][1:] != found["c0"][:-1]) | (found["c1"][1:] != found["c1"][:-1]) | (found["first"][1:] != found["first"][:-1] + 1)])) if len(found) else np.zeros(0, int)
        size = np.diff(np.concatenate([head, [len(found)]])).astype(int)
        content = [bytes(x) for x in np.stack([found["c0"][head], found["c1"][head]], 1)] if len(head) else []
        return pd.DataFrame({"content": content, "first": found["first"][head].astype(np.int32), "count": size.astype(np.int32)})

    return published.groupBy("range").applyInPandas(run, "content binary, first int, count int")


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """(content, first, count): windows first .. first + count of the text that occur elsewhere.

    ``docs`` has (content, doc, t): 128-bit hash of the text, key, bytes.
    """
    spark = docs.sparkSession
    cut = _cut(docs, length)
    cut = materialize(cut, "segments")
    by_text = cut.groupBy("anchor", "h0", "h1", "count", "offset").agg(F.count("*").alias("n"), F.min(F.struct("content", "first", "doc")).alias("one"))
    by_text = materialize(by_text, "distinct-segments")
    several = by_text.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = by_text.join(several, "anchor").withColumn("parts", F.ceil(F.col("kinds") / PER_ANCHOR).cast("int"))
    wanted = wanted.withColumn("part", F.pmod(F.col("h1"), F.col("parts")).cast("int"))
    wanted = wanted.select("anchor", "h0", "h1", "count", "offset", "part", "parts", "kinds", "one.content", "one.first", "one.doc")
    wanted = materialize(wanted, "open-segments")
    release(spark)
    total, split = wanted.agg(F.sum(F.col("count") + length), F.sum(F.when(F.col("parts") > 1, F.col("count")))).first()
    shards = max(1, -(-int(total or 0) // SHARD_BYTES))
    parts = wanted.select("anchor", "parts").distinct()
    texts = _texts(wanted, docs, length).join(parts, "anchor")
    texts = texts.withColumn("shard", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(-F.abs(F.xxhash64("anchor", "part") % (1 << 40)) - 1))
    looked = _search(texts, length, max(1, -(-int(split or 0) // MERGE_WINDOWS)))
    looked = materialize(looked, "searched")
    release(spark)
    alone = looked.where("data IS NULL").select("content", "first", "count")
    merged = _merge(looked.where("data IS NOT NULL").select("range", "data"))
    whole = cut.join(by_text.where("n > 1").select("anchor", "h0", "h1", "count", "offset"), ["anchor", "h0", "h1", "count", "offset"]).select("content", "first", "count")
    out = materialize(whole.union(alone).union(merged), "runs")
    forget(cut, by_text, wanted, looked)
    release(spark)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept (bytes), spans (start, end of each removed run)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    rows = rows.withColumn("content", F.unhex(F.md5("t")))
    runs = repeated_runs(rows.select("content", F.coalesce("doc", F.lit(-(1 << 62))).alias("doc"), "t"), length)
    spans = runs.groupBy("content").agg(F.array_sort(F.collect_set(F.struct("first", "count"))).alias("runs"))
    spans = spans.select("content", F.flatten(F.transform("runs", lambda x: F.array(x["first"], x["count"]))).alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_removed, n_spans, kept, spans = [], [], [], []
            for t, r in zip(batch["t"], batch["runs"], strict=True):
                out: list[list[int]] = []
                for first, count in np.reshape(r if r is not None else [], (-1, 2)).astype(int).tolist():
                    a, b = first, first + count - 1 + length
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                at, parts = 0, []
                for a, b in out:
                    parts.append(t[at:a])
                    at = b
                parts.append(t[at:])
                kept.append(b"".join(parts))
                n_removed.append(sum(b - a for a, b in out))
                n_spans.append(len(out))
                spans.append([x for p in out for x in p])
            yield pd.DataFrame({"doc": [d or None for d in batch["doc"]], "n_bytes": [len(t) for t in batch["t"]], "n_removed": n_removed, "n_spans": n_spans, "kept": kept, "spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})

    joined = rows.join(spans, "content", "left").select(F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("doc"), "t", "runs")
    made = joined.mapInPandas(cut, "doc string, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>, kept_sha256 string")
    return made.select(F.col("doc").cast("long").alias(key), "n_bytes", "n_removed", "n_spans", "kept", "spans", "kept_sha256")
