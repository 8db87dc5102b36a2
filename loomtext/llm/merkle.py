"""Merkle dataset manifest: a hash tree per group of rows, one over the groups, and a proof per row.

Superblock reduction: a row's position in its tree gives the bucket ``i div fanout ** levels``;
``applyInPandas`` collapses ``levels`` levels of a bucket at once, giving the bucket's top and each
member's part of its proof; the tops are the nodes of the next round, so a tree of any height takes
a few rounds and no task holds more than ``fanout ** levels`` nodes. Proofs are put together from
the top: each round's lower parts are joined with the upper part of their bucket, of which there is
one row, ``fanout ** levels`` times fewer than members.

H is the lowercase hex SHA-256 of its inputs, digests as hex text. A run of ``fanout`` consecutive
nodes, the last one perhaps shorter, becomes the H of its digests while more than one node is left;
a lone leaf is its own subroot. A proof is binary: for each level one byte each for the digests to
the left and to the right in the run, then those digests.

Defined cases: a null column is ``-``; an empty text is ``0:``; rows without a key come first in
their tree, in the order of their leaves, and so do rows with equal keys; repeated rows are leaves
each; a null group is a tree, ordered before the others; an empty table gives an empty result. Only
the named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ordinal import numbered
from .store import materialize, tune

#: Nodes of a run, and levels collapsed in one round: 1024 nodes a bucket.
FANOUT, LEVELS = 2, 10


def encoded(value: Column | str) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers as decimals."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column | str) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def run_digest(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(n: int, fanout: int) -> int:
    """Levels of a tree above its ``n`` nodes."""
    up = 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def collapsed(nodes: list[bytes], levels: int, fanout: int) -> tuple[bytes, list[bytes]]:
    """The top of a bucket and the proof of each of its nodes up to it."""
    proofs, at, row = [bytearray() for _ in nodes], list(range(len(nodes))), nodes
    for _ in range(levels):
        for p, i in zip(proofs, at, strict=True):
            lo = i - i % fanout
            left, right = row[lo:i], row[i + 1 : lo + fanout]
            p += bytes((len(left), len(right)))
            p += b"".join(left + right)
        row = [run_digest(row[lo : lo + fanout]) for lo in range(0, len(row), fanout)]
        at = [i // fanout for i in at]
    return row[0], [bytes(p) for p in proofs]


def _steps(proof: bytes):
    """(digests to the left, digests to the right) for each level."""
    at = 0
    while at < len(proof):
        left, right = proof[at], proof[at + 1]
        mid, end = at + 2 + 32 * left, at + 2 + 32 * (left + right)
        yield proof[at + 2 : mid], proof[mid:end]
        at = end


@F.pandas_udf(StringType())
def folded(leaf: pd.Series, proof: pd.Series) -> pd.Series:
    """The root that a leaf and its proof lead to."""
    out = []
    for node, path in zip(leaf, proof, strict=True):
        text = bytes(node).hex()
        for left, right in _steps(bytes(path)):
            text = hashlib.sha256((left.hex() + text + right.hex()).encode()).hexdigest()
        out.append(text)
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def proof_digest(proof: pd.Series) -> pd.Series:
    """H of a proof's siblings, level by level, left to right."""
    return pd.Series([hashlib.sha256(b"".join(a + b for a, b in _steps(bytes(p))).hex().encode()).hexdigest() for p in proof], dtype=object)


def reduced(nodes: DataFrame, fanout: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of the trees of ``nodes`` (tree, i, n, digest and others), and their tops (tree, digest, level: rounds taken).

    A round has its nodes with their block and proof up to the block's top; the first one keeps all columns.
    """
    width = fanout**levels

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        up = min(levels, height(int(pdf["n"].iloc[0]), fanout))
        top, proofs = collapsed([bytes(d) for d in pdf["digest"]], up, fanout)
        return pdf.assign(proof=proofs, top=[top] + [None] * (len(pdf) - 1))

    most = nodes.agg(F.max("n")).first()[0] or 0
    top_of = lambda df, level: df.where("n = 1").select("tree", "digest", F.lit(level).alias("level"))
    rounds, tops, now = [], top_of(nodes, 0), nodes
    while most > 1:
        many = now.where("n > 1").withColumn("block", F.expr(f"i div {width}"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in many.schema)
        block = materialize(many.groupBy("tree", "block").applyInPandas(collapse, f"{fields}, proof binary, top binary"), f"{name}-round")
        rounds.append(block)
        most = -(-most // width)
        now = block.where("top IS NOT NULL").select("tree", F.col("block").alias("i"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("top").alias("digest"))
        tops = tops.union(top_of(now, len(rounds)))
    return rounds, tops


def _under(block: DataFrame, above: DataFrame) -> DataFrame:
    """A round's rows under the rows (tree, i, subroot, root, upper) of the next one, with their whole proofs."""
    above = above.select(F.col("tree").alias("t_"), F.col("i").alias("i_"), "subroot", "root", "upper")
    met = block.join(above, block["tree"].eqNullSafe(F.col("t_")) & (block["block"] == F.col("i_")))
    return met.withColumn("proof", F.concat("proof", "upper"))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = FANOUT, levels: int = LEVELS, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: key, tree, position, leaf, subroot, root (32 bytes each) and proof.

    ``extra`` names further expressions over ``docs`` to carry along.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("a run has 2 to 255 nodes")
    tune(docs.sparkSession, 4096)
    extra = extra or {}
    leaves = materialize(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("tree"), leaf_of(*[F.col(f"`{c}`") for c in fields]).alias("digest"), *[c.alias(k) for k, c in extra.items()]), "leaves")
    placed = materialize(numbered(leaves, "tree", ["key", "digest"], "leaves-placed"), "leaves-numbered")
    rounds, tops = reduced(placed, fanout, levels, "trees")
    # The subroots, in the order of their groups, are the leaves of one more tree.
    tops = materialize(tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", "level"), "subroots")
    upper_rounds, root = reduced(materialize(numbered(tops, "tree", ["group"], "subroots-placed"), "subroots-numbered"), fanout, levels, "root")
    above = root.select("tree", F.lit(0).cast("long").alias("i"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"), F.lit(b"").alias("upper"))
    whole = [F.col("group").alias("tree"), F.lit(0).cast("long").alias("i"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("upper"), "level"]
    for block in reversed(upper_rounds[1:]):
        above = _under(block, above).select("tree", "i", "subroot", "root", F.col("proof").alias("upper"))
    if upper_rounds:
        above = _under(upper_rounds[0], above).select(*whole)
    else:
        above = tops.withColumns({"root": F.col("digest"), "proof": F.lit(b"")}).select(*whole)
    trees = materialize(above, "above")
    # A tree that took k rounds has its top among the nodes of round k.
    ended = lambda k: trees.where(F.col("level") == k).drop("level")
    above = ended(len(rounds))
    for k in range(len(rounds) - 1, 0, -1):
        lower = _under(rounds[k], above).select("tree", "i", "subroot", "root", F.col("proof").alias("upper"))
        above = materialize(lower.union(ended(k)), "above")
    out = ["key", "tree", "i", "digest", *extra]
    lone = ended(0).select(F.col("tree").alias("t_"), "subroot", "root", "upper")
    done = placed.where("n = 1").join(lone, F.col("tree").eqNullSafe(F.col("t_"))).select(*out, "subroot", "root", F.col("upper").alias("proof"))
    if rounds:
        done = _under(rounds[0], above).select(*out, "subroot", "root", "proof").union(done)
    return done.withColumnsRenamed({"i": "position", "digest": "leaf"})
