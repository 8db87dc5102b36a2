"""Copies of images by local descriptors: cropped, scaled, rotated, dimmed or edited ones.

1. Corners: the Harris response on several scales of the grey image, local maxima.
2. Descriptors: ``BITS`` brightness comparisons at fixed places around a corner, turned by the
   direction of the corner's centroid of brightness, so that turning the image doesn't change them.
3. Hamming tables: each of ``TABLES`` tables takes ``CHUNK`` bits of a descriptor, in a few orders of
   the bits. Images that agree in a table at enough corners are candidates. Of 332 edited copies
   (odd turns, scales, noise, fewer grey levels) that consensus accepts, 98 % are candidates.
4. Consensus: corners of a candidate pair are matched by Hamming distance, both ways, and the
   pair is linked if one similarity transform (shift, turn, scale) carries enough of them over.
5. Components over the links.

Images with equal pixels form a class first, and only one of each class goes on, so a picture
that a third of all rows show costs no more than one. Candidates are met in two steps. First every image of a bucket
meets the one with the smallest key; links that hold make components, so that a large group of copies, whose
pictures share their buckets, becomes one component at a cost in proportion to its size. Then images of a
bucket that are still in different components meet, and the votes of such a pair are those of all buckets together. So no
link between components is lost. For this the images are dealt into blocks; a task has two blocks, counts
the votes of their pairs, and only candidates leave it. Each image is sent to as many tasks as there are blocks, with the chunks whose buckets they have. What
can still grow with the square of a bucket are the agreements counted there, of pictures that share corners and are no copies.

The corners kept per image and scale are the detector's parameter: in every ``TILE`` x ``TILE`` pixels the ``CORNERS``
strongest, by place where equal, so a crop of a large picture has the corners that its source has there.

Defined cases: a null or undecodable image, one without pixels or without corners has no
descriptors and is linked with equal ones only (null ones with nothing); repeated rows are in one
class; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import components
from .store import forget, materialize, tune

MAGIC = b"GRY1"
BITS, TABLES, CHUNK, CORNERS, TILE, SCALES = 256, 10, 48, 24, 96, (1.0, 0.7)
RADIUS, MARGIN = 9, 13
#: Corners that must agree in a table, largest Hamming distance of a match, corners that must follow one transform, and by how many pixels they may miss.
VOTES, NEAR, CONSENSUS, MISS = 3, 48, 8, 3.0
#: Chunks in shared buckets that a block of images has on average, the fewest blocks; agreeing corners that a task holds at a time, and slots that its pairs are counted in.
BLOCK_CHUNKS, BLOCKS, AT_ONCE, SLOTS = 1 << 21, 6, 1 << 17, 262_147
#: Distances, in the order of matches, of those that name transforms together where there are many.
STRIDES = (1, 2, 3, 5, 8, 13, 21, 34)
#: Fixed places of the comparisons.
_rng = np.random.default_rng(5)
PLACES = np.clip(_rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS, RADIUS)
TURNS = 32
#: The places turned by each of the directions: turns x bits x ends x (row, column).
_angle = -2 * np.pi * np.arange(TURNS) / TURNS
_turn = np.stack([np.stack([np.cos(_angle), np.sin(_angle)], -1), np.stack([-np.sin(_angle), np.cos(_angle)], -1)], 1)
TURNED = np.rint(np.einsum("tij,bej->tbei", _turn, PLACES)).astype(np.int64)
#: The bits of each table: an order of all bits serves as many tables as it has whole chunks, the first in the order of the places.
_whole = BITS // CHUNK
_orders = [np.arange(BITS), *[np.random.default_rng(99 + i).permutation(BITS) for i in range(1, -(-TABLES // _whole))]]
CHUNKS = np.stack([_orders[t // _whole][t % _whole * CHUNK : (t % _whole + 1) * CHUNK] for t in range(TABLES)])
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(grey: np.ndarray) -> bytes:
    """A grey image (rows x columns of 0 .. 255) as bytes: magic, height, width, pixels."""
    g = np.ascontiguousarray(grey, np.uint8)
    return MAGIC + struct.pack("<II", *g.shape) + g.tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """The grey image of :func:`encode`, or of a binary grey or colour netpbm file (P5, P6); None for other bytes."""
    if not data:
        return None
    if data[:4] == MAGIC and len(data) >= 12:
        h, w = struct.unpack_from("<II", data, 4)
        return np.frombuffer(data, np.uint8, h * w, 12).reshape(h, w) if len(data) >= 12 + h * w else None
    if data[:2] in (b"P5", b"P6"):
        parts = data.split(None, 4)
        if len(parts) == 5 and all(p.isdigit() for p in parts[1:4]):
            w, h, n = int(parts[1]), int(parts[2]), 1 if data[:2] == b"P5" else 3
            body = data[len(data) - w * h * n :]
            if len(body) == w * h * n:
                return np.rint(np.frombuffer(body, np.uint8).reshape(h, w, n).mean(axis=2)).astype(np.uint8)
    return None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) x (2r + 1), the borders repeated."""
    for axis in (0, 1):
        pad = [(r + 1, r) if a == axis else (0, 0) for a in (0, 1)]
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        n = x.shape[axis]
        hi, lo = (c[2 * r + 1 :], c[:n]) if axis == 0 else (c[:, 2 * r + 1 :], c[:, :n])
        x = (hi[:n] - lo if axis == 0 else hi[:, :n] - lo) / (2 * r + 1)
    return x


def _scaled(x: np.ndarray, s: float) -> np.ndarray:
    if s == 1.0:
        return x
    h, w = int(x.shape[0] * s), int(x.shape[1] * s)
    if not h or not w:
        return np.zeros((0, 0))
    r, c = (np.arange(h) + 0.5) / s - 0.5, (np.arange(w) + 0.5) / s - 0.5
    r0, c0 = np.clip(r.astype(int), 0, x.shape[0] - 2), np.clip(c.astype(int), 0, x.shape[1] - 2)
    fr, fc = np.clip(r - r0, 0, 1)[:, None], np.clip(c - c0, 0, 1)[None, :]
    a, b = x[r0][:, c0], x[r0][:, c0 + 1]
    d, e = x[r0 + 1][:, c0], x[r0 + 1][:, c0 + 1]
    return (a * (1 - fc) + b * fc) * (1 - fr) + (d * (1 - fc) + e * fc) * fr


_dy, _dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_disc = (_dy**2 + _dx**2 <= RADIUS**2).astype(float)


def features(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, descriptors): row and column of each corner in the full image; BITS / 8 bytes each."""
    places, found = [], []
    for s in SCALES:
        x = _scaled(grey.astype(float), s)
        if min(x.shape) < 2 * MARGIN + 3:
            continue
        smooth = _box(x, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[MARGIN:-MARGIN, MARGIN:-MARGIN]
        top = np.ones(inner.shape, bool)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if (i, j) != (0, 0):
                    near = r[MARGIN + i : r.shape[0] - MARGIN + i, MARGIN + j : r.shape[1] - MARGIN + j]
                    top &= (inner > near) if (i, j) > (0, 0) else (inner >= near)
        at = np.flatnonzero(top & (inner > 1.0))
        if not len(at):
            continue
        y, z = at // inner.shape[1] + MARGIN, at % inner.shape[1] + MARGIN
        tile = y // TILE * (x.shape[1] // TILE + 1) + z // TILE
        order = np.lexsort((at, -inner.ravel()[at], tile))
        head = np.flatnonzero(np.concatenate([[True], np.diff(tile[order]) != 0]))
        rank = np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate([head, [len(at)]])))
        keep = order[rank < CORNERS]
        y, z = y[keep], z[keep]
        soft = _box(x, 2)
        patch = x[y[:, None, None] + _dy, z[:, None, None] + _dx] * _disc
        turn = np.arctan2((patch * _dy).sum((1, 2)), (patch * _dx).sum((1, 2)))
        # Brightness turned by t: the places turn by t as well (rows are y, columns x).
        k = np.rint(turn / (2 * np.pi) * TURNS).astype(int) % TURNS
        ends = TURNED[k]
        bits = soft[np.clip(y[:, None] + ends[:, :, 0, 1], 0, x.shape[0] - 1), np.clip(z[:, None] + ends[:, :, 0, 0], 0, x.shape[1] - 1)] < soft[np.clip(y[:, None] + ends[:, :, 1, 1], 0, x.shape[0] - 1), np.clip(z[:, None] + ends[:, :, 1, 0], 0, x.shape[1] - 1)]
        places.append(np.stack([(y + 0.5) / s, (z + 0.5) / s], 1))
        found.append(np.packbits(bits, axis=1))
    if not places:
        return np.zeros((0, 2), np.float32), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places).astype(np.float32), np.concatenate(found)


def consensus(pa: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray) -> int:
    """Most matched corners that one shift, turn and scale carries from a to b; no corner counts twice."""
    if not len(pa) or not len(pb):
        return 0
    dist = np.concatenate([_POP[da[i : i + 256, None, :] ^ db[None, :, :]].sum(axis=2, dtype=np.int32) for i in range(0, len(da), 256)])
    to = dist.argmin(axis=1)
    i = np.flatnonzero((dist[np.arange(len(pa)), to] <= NEAR) & (dist.argmin(axis=0)[to] == np.arange(len(pa))))
    if len(i) < CONSENSUS:
        return 0
    a, b = pa[i] @ np.array([1j, 1]), pb[to[i]] @ np.array([1j, 1])
    # Each pair of matches names a transform z -> m * z + t; every one is tried, of many matches those with a few others each.
    if len(i) <= 64:
        u, v = np.triu_indices(len(i), 1)
    else:
        u = np.repeat(np.arange(len(i)), len(STRIDES))
        v = (u + np.tile(STRIDES, len(i))) % len(i)
    da_, db_ = a[v] - a[u], b[v] - b[u]
    ok = (np.abs(da_) > 8) & (np.abs(db_) > 8)
    u, m = u[ok], db_[ok] / da_[ok]
    fine = (np.abs(m) > 0.4) & (np.abs(m) < 2.5)
    u, m = u[fine], m[fine]
    if not len(u):
        return 0
    t = b[u] - m * a[u]
    hit = np.abs(m[:, None] * a[None, :] + t[:, None] - b[None, :]) <= MISS
    best = hit[hit.sum(axis=1).argmax()]
    # Corners of two scales may stand at one place.
    return len(np.unique(np.rint(a[best] / 3)))


def described(images: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """(key, content, n_corners, places, descriptors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for k, data in zip(batch["k"], batch["image"], strict=True):
                data = bytes(data) if data is not None else b""
                grey = decode(data)
                p, d = features(grey) if grey is not None and grey.size else features(np.zeros((0, 0)))
                out.append((k, xxhash.xxh3_128_digest(data) if data else b"", len(p), p.tobytes(), d.tobytes()))
            yield pd.DataFrame(out, columns=["key", "content", "n_corners", "places", "descriptors"])

    return images.select(F.col(key).cast("long").alias("k"), F.col(image).alias("image")).mapInPandas(run, "key long, content binary, n_corners long, places binary, descriptors binary")


def _tables(reps: DataFrame) -> DataFrame:
    """(bucket, corner, key): one row per chunk of each descriptor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buckets, corners, keys = [], [], []
            for k, d in zip(batch["key"], batch["descriptors"], strict=True):
                bits = np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, BITS // 8), axis=1)
                chunks = np.zeros((len(bits), TABLES, 8), np.uint8)
                chunks[:, :, : CHUNK // 8] = np.packbits(bits[:, CHUNKS], axis=2)
                buckets.append((chunks.view("<i8")[:, :, 0] * TABLES + np.arange(TABLES)).ravel())
                corners.append(np.repeat(np.arange(len(chunks), dtype=np.int32), TABLES))
                keys.append(np.full(len(chunks) * TABLES, k))
            if keys:
                yield pd.DataFrame({"bucket": np.concatenate(buckets), "corner": np.concatenate(corners), "key": np.concatenate(keys)})

    return reps.select("key", "descriptors").mapInPandas(run, "bucket long, corner int, key long")


def _linked(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [consensus(*[np.frombuffer(x, np.float32 if i % 2 == 0 else np.uint8).reshape(-1, 2 if i % 2 == 0 else BITS // 8) for i, x in enumerate(row)]) for row in zip(batch["pa"], batch["da"], batch["pb"], batch["db"], strict=True)]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "together": out}).query(f"together >= {CONSENSUS}")

    joined = pairs.join(reps.select(F.col("key").alias("a"), F.col("places").alias("pa"), F.col("descriptors").alias("da")), "a")
    joined = joined.join(reps.select(F.col("key").alias("b"), F.col("places").alias("pb"), F.col("descriptors").alias("db")), "b")
    return joined.select("a", "b", "pa", "da", "pb", "db").mapInPandas(run, "a long, b long, together int")


def _voted(met: DataFrame, most_corners: int) -> DataFrame:
    """Pairs (a, b) with enough different corners of b among (a, b, corner)."""
    n = -(-most_corners // 64)
    if n <= 16:
        # The corners as bits of as many longs as it takes, so that they are combined before they are shuffled.
        masks = [F.bit_or(F.when(F.floor(F.col("corner") / 64) == i, F.expr("shiftleft(1L, corner % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(max(n, 1))]
        votes = sum((F.bit_count(f"m{i}") for i in range(len(masks))), F.lit(0))
        return met.groupBy("a", "b").agg(*masks).where(votes >= VOTES).select("a", "b")
    return met.distinct().groupBy("a", "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= VOTES).select("a", "b")


def _met(images: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of a task's images in different components with enough different corners of b, the larger key, in shared buckets.

    The images are those of two blocks, met across, or of one, met among themselves. They meet ``AT_ONCE`` agreeing corners at a time.
    """
    key, comp = images["key"].to_numpy(), np.unique(images["comp"], return_inverse=True)[1]
    image = np.repeat(np.arange(len(images)), images["buckets"].map(len))
    bucket, corner = np.concatenate(images["buckets"].to_numpy()), np.concatenate(images["corners"].to_numpy())
    one = bool(images["low"].iloc[0] == images["high"].iloc[0])
    left, right = (np.flatnonzero((images["block"] == images[side]).to_numpy()[image]) for side in ("low", "high"))
    found = [np.zeros(0, np.int64)]
    if len(left):
        # By bucket and component: a right entry's partners are its bucket's range without its own component's.
        left = left[np.lexsort((comp[image[left]], bucket[left]))]
        head = np.flatnonzero(np.concatenate([[True], bucket[left][1:] != bucket[left][:-1]]))
        end = np.append(head[1:], len(left))
        at = np.minimum(np.searchsorted(bucket[left[head]], bucket[right]), len(head) - 1)
        hit = bucket[left[head[at]]] == bucket[right]
        at, right = at[hit], right[hit]
        code, own = np.repeat(np.arange(len(head)), end - head) * len(images) + comp[image[left]], at * len(images) + comp[image[right]]
        starts = np.stack([head[at], np.searchsorted(code, own, "right")], 1)
        counts = np.stack([np.searchsorted(code, own, "left"), end[at]], 1) - starts
        total = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
        bounds = np.append(np.flatnonzero(np.diff(image[right], prepend=-1)), len(right))
        width, i = int(corner.max()) + 1, 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(total[bounds], total[bounds[i]] + AT_ONCE, "right")) - 1)
            lo, hi, i = bounds[i], bounds[j], j
            n = counts[lo:hi].ravel()
            x = left[np.repeat(starts[lo:hi].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            y = np.repeat(np.repeat(right[lo:hi], 2), n)
            up = key[image[x]] < key[image[y]]
            if one:
                x, y, up = x[up], y[up], up[up]
            pair = image[x] * len(images) + image[y]
            # Most pairs agree once: where a slot has fewer agreements than VOTES, no pair in it has enough.
            many = np.bincount(slot := pair % SLOTS)[slot] >= VOTES
            x, y, up, pair = x[many], y[many], up[many], pair[many]
            pair, votes = np.unique(np.unique(pair * width + np.where(up, corner[y], corner[x])) // width, return_counts=True)
            found.append(pair[votes >= VOTES])
    pair = np.concatenate(found)
    both = np.stack([key[pair // len(images)], key[pair % len(images)]], 1)
    return pd.DataFrame({"a": both.min(axis=1), "b": both.max(axis=1)})


def _between(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b) of images in different components with enough different corners of b, the larger key, in shared buckets.

    The images are dealt into blocks, and each two blocks meet in a task that counts the votes, so only candidates become rows.
    A chunk goes only to tasks with a block that has its bucket too.
    """
    marked = shared.join(comp.withColumnRenamed("node", "key"), "key", "left").select("bucket", "corner", "key", F.coalesce("component", "key").alias("comp"))
    marked = materialize(marked, "marked")
    n = max(BLOCKS, -(-marked.count() // BLOCK_CHUNKS))
    block = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("block")
    # Of more than 64 blocks some share a bit, so that a chunk may go to a task without need.
    blocks = marked.select("bucket", "comp", block).groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.bit_or(F.expr("shiftleft(1L, block % 64)")).alias("blocks"))
    open_ = marked.join(blocks.where("least < most").select("bucket", "blocks"), "bucket")
    images = open_.groupBy("key", "comp").agg(F.collect_list(F.struct("bucket", "corner", "blocks")).alias("chunks"))
    dealt = images.select("key", "comp", "chunks", block, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    dealt = dealt.select("*", F.expr("filter(chunks, c -> (shiftright(c.blocks, other % 64) & 1L) = 1L)").alias("met"))
    dealt = dealt.select("key", "comp", F.col("met.bucket").alias("buckets"), F.col("met.corner").alias("corners"), "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    pairs = materialize(dealt.groupBy("low", "high").applyInPandas(_met, "a long, b long"), "candidates")
    forget(marked)
    return pairs


def copies(images: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """Per row: key, n_corners, component_id (smallest key reachable), kept."""
    tune(images.sparkSession, 64)
    drawn = materialize(described(images, key, image), "corners")
    classes = drawn.where("octet_length(content) > 0 AND key IS NOT NULL").groupBy("content").agg(F.min("key").alias("rep"))
    reps = drawn.join(classes, "content").where("key = rep AND n_corners > 0").dropDuplicates(["key", "content"]).select("key", "places", "descriptors")
    reps = materialize(reps, "reps")
    most = drawn.agg(F.max("n_corners")).first()[0] or 1
    tables = _tables(reps)
    busy = tables.groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("bucket", "least")
    # A bucket has one row on the right, so a bucket of many images is a skewed partition of the left side, which is split.
    shared = materialize(tables.join(busy, "bucket"), "tables")
    star = shared.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"), "corner")
    first = materialize(_linked(_voted(star, most), reps).select("a", "b"), "star-links")
    second = materialize(_linked(_between(shared.drop("least"), components(first, "media")), reps).select("a", "b"), "links")
    forget(shared)
    comp = components(first.union(second), "media")
    by_class = classes.join(comp, classes["rep"] == comp["node"], "left").select("content", F.coalesce("component", "rep").alias("component_id"))
    by_class = materialize(by_class, "classes")
    out = drawn.join(by_class, "content", "left").withColumn("component_id", F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), "n_corners", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def rendered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cell: int = 6, border: int = 2) -> DataFrame:
    """(key, image): each vector as a grey picture of square cells, for tables that have no pictures of their own.

    The cells go round at the edges for ``border`` cells, so that corners near them have whole surroundings.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["v"]:
                v = np.nan_to_num(np.array(v if v is not None else [], float))
                n = int(np.ceil(len(v) ** 0.5))
                if not n:
                    out.append(None)
                    continue
                grid = np.zeros(n * n)
                grid[: len(v)] = v
                size = np.abs(grid).max() or 1.0
                grey = np.pad(np.clip(128 + 127 * grid.reshape(n, n) / size, 0, 255).astype(np.uint8), border, mode="wrap")
                out.append(encode(np.kron(grey, np.ones((cell, cell), np.uint8))))
            yield pd.DataFrame({"key": batch["k"], "image": out})

    tune(vectors.sparkSession, 64)
    return vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(run, "key long, image binary").select(F.col("key").alias(key), "image")
