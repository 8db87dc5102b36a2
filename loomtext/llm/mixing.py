"""Mixing sources to target weights: iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked in turn to the target shares
of each of the three marginals until no marginal misses its target by more than ``TOLERANCE`` of it, or
``MOST`` rounds are over; targets that contradict each other are never met, and then a warning says by how
much they are missed. Documents are drawn with the calibrated probability of their cell. A target may be named per value; the others of a
marginal share what is left in proportion to their observed shares to the power ``ALPHA``,
which lifts small sources and holds a source with a third of all tokens in check.

The draw compares a hash of the key and the seed with the probability, so it doesn't depend
on partitioning, order or size, and a larger budget keeps what a smaller one kept. Cells are
pre-aggregated before the shuffle, and all iterations work on one row per cell.

How much is drawn doesn't hang on one cell: the scale is solved for a budget of tokens, or for
``SHARE`` of all tokens where no budget is given, with the cells that would need repeats at
probability 1. Targets that are named go before size: without a budget, as much is drawn as
leaves at most ``LOST`` of the target weight to such cells. ``largest=True`` is the largest draw
in which no cell at all falls short, which one rare cell can make arbitrarily small.

Defined cases: a null source, language or topic is the value ``''``; a null or empty text has
no tokens and lies in its cell with weight 0; rows without a key are drawn as key ``''``;
repeated rows are drawn alike; a cell without tokens keeps its documents with probability 1
(they cost nothing); an empty table gives an empty result. Input columns are kept, whatever
their names; the columns this operator adds are named by the caller.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize

ALPHA, SEED = 0.7, 17
#: Largest miss of a marginal that ends the raking, and rounds after which it ends in any case.
TOLERANCE, MOST = 1e-6, 60
#: Share of the tokens that is drawn without a budget, and of the target weight that named targets may lose to cells at probability 1.
SHARE, LOST = 0.5, 0.005
#: Shares of a text's characters from which it counts as figures or marked, and characters below which it is short.
FIGURES, MARKED, BRIEF = 0.1, 0.08, 600
SPACES = " \t\n\x0b\x0c\r"
DIGITS, SIGNS = "0123456789", "|<>{}[]/\\#%&+=~`^_*$@"
#: Rounds between two written tables.
CUT = 4


def tokens_of(text: str):
    """White-space tokens of a text, as a column."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # A letter for each token; what may be left is white space at the end.
    return F.length(F.btrim(F.regexp_replace(t, f"[{SPACES}]*+[^{SPACES}]++", "a"), F.lit(SPACES))).cast("long")


def topic_of(text: str):
    """The kind of text as a topic, by what its characters are: figures, marked (tables, code, noise), short or prose."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Digits and signs alone are a small part of most texts, so they are counted there.
    counted = F.regexp_replace(t, f"[^{re.escape(DIGITS + SIGNS)}]++", "")
    signs = F.length(F.translate(counted, DIGITS, ""))
    return F.when(F.length(counted) - signs > FIGURES * F.length(t), "figures").when(signs > MARKED * F.length(t), "marked").when(F.length(t) < BRIEF, "short").otherwise("prose")


def _cells(docs: DataFrame, cols: list[str], tokens: str) -> DataFrame:
    return docs.groupBy(*cols).agg(F.sum(F.col(tokens).cast("double")).alias("mass")).where("mass > 0")


def _targets(cells: DataFrame, col: str, named: dict[str, float], alpha: float) -> DataFrame:
    """(value, share): the target shares of one marginal, which add up to 1 over the values that occur."""
    seen = cells.groupBy(col).agg(F.sum("mass").alias("m"))
    over = Window.partitionBy(F.lit(1))
    if named:
        said = F.coalesce(*[F.when(F.col(col) == k, F.lit(float(v))) for k, v in sorted(named.items())])
        seen = seen.withColumn("said", said)
        rest = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("said").over(over), F.lit(0.0)))
        free = F.when(F.col("said").isNull(), F.pow("m", F.lit(alpha)))
        seen = seen.withColumn("w", F.coalesce("said", rest * free / F.sum(free).over(over)))
    else:
        seen = seen.withColumn("w", F.pow("m", F.lit(alpha)))
    return seen.select(col, (F.col("w") / F.sum("w").over(over)).alias("share"))


def misfit(now: DataFrame, cols: list[str]) -> float:
    """Largest relative miss of any target share by the weights."""
    miss = [F.abs(F.sum("weight").over(Window.partitionBy(c)) / F.col(f"share_{c}") - 1) for c in cols]
    return now.select(F.greatest(*miss).alias("miss")).agg(F.max("miss")).first()[0] or 0.0


def rake(cells: DataFrame, cols: list[str], targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = MOST, tolerance: float | None = TOLERANCE) -> DataFrame:
    """Cells with ``weight``: the mass share of each cell after raking; without a ``tolerance`` after exactly ``rounds`` rounds."""
    targets = targets or {}
    now = cells
    for c in cols:
        now = now.join(_targets(cells, c, targets.get(c, {}), alpha).withColumnRenamed("share", f"share_{c}"), c)
    now = materialize(now.withColumn("weight", F.col("mass") / F.sum("mass").over(Window.partitionBy(F.lit(1)))), "rake", 1)
    for k in range(rounds):
        for c in cols:
            now = now.withColumn("weight", F.col("weight") * F.col(f"share_{c}") / F.sum("weight").over(Window.partitionBy(c)))
        if k % CUT == CUT - 1:
            now = materialize(now, "rake", 1)
            if tolerance is not None and misfit(now, cols) <= tolerance:
                break
    else:
        if tolerance is not None and (miss := misfit(now, cols)) > tolerance:
            warnings.warn(f"after {rounds} rounds a marginal misses its target by {miss:.3g} of it", stacklevel=2)
    return now.select(*cols, "mass", "weight")


def probabilities(raked: DataFrame, cols: list[str], budget: float | None = None, share: float | None = SHARE, lost: float | None = None) -> DataFrame:
    """Cells with ``probability``: the raked mass over the observed one, scaled, and 1 at most.

    The scale is solved for ``budget`` tokens, else for at most ``lost`` of the weight in what cells at 1
    fall short by, else for ``share`` of all tokens; with none of them it is the largest draw without repeats.
    """
    everything = Window.partitionBy(F.lit(1))
    ratio = raked.withColumn("ratio", F.col("weight") / F.col("mass"))
    if budget is None and share is None and lost is None:
        return ratio.select(*cols, F.least(F.lit(1.0), F.col("ratio") / F.max("ratio").over(everything)).alias("probability"))
    # By falling ratio: with the cells before a row at 1, the others have to give what is left of the draw.
    order = everything.orderBy(F.desc("ratio"), *cols)
    full = F.coalesce(F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    if budget is None and lost is not None:
        # Tokens are scale * (1 - lost), so full + scale * rest = scale * (1 - lost).
        short = F.sum("weight").over(everything) * (1 - lost) - rest
        scale = F.when(short > 0, full / short)
    else:
        wanted = F.lit(float(budget)) if budget is not None else float(share) * F.sum("mass").over(everything)
        scale = (wanted - full) / rest
    ratio = ratio.withColumn("scale", scale).withColumn("place", F.row_number().over(order))
    # The first row that the scale leaves at 1 or below; where there is none, everything is drawn.
    fits = F.when(F.col("scale") * F.col("ratio") <= 1 + 1e-12, F.struct("place", "scale"))
    ratio = ratio.withColumn("scale", F.min(fits).over(everything)["scale"])
    return ratio.select(*cols, F.coalesce(F.least(F.lit(1.0), F.col("ratio") * F.col("scale")), F.lit(1.0)).alias("probability"))


def uniform(key: str, seed: int = SEED):
    """A number in [0, 1) from md5 of the key and the seed."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic=None, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = MOST, tolerance: float | None = TOLERANCE, budget: float | None = None, share: float = SHARE, largest: bool = False, seed: int = SEED) -> DataFrame:
    """(k, source, lang, topic, n_tokens, probability, kept) per row of ``docs``, and its columns in the struct ``row``.

    ``targets`` has shares by marginal (source, lang, topic) and value; ``topic`` is a column,
    by default :func:`topic_of`. ``budget`` is in tokens, ``share`` of all tokens; ``largest`` goes without either.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("k"), blank(source).alias("source"), blank(lang).alias("lang"), F.coalesce(topic if topic is not None else topic_of(text), F.lit("")).alias("topic"), tokens_of(text).alias("n_tokens"))
    cols = ["source", "lang", "topic"]
    cells = materialize(_cells(rows.select(*cols, "n_tokens"), cols, "n_tokens"), "cells", 1)
    size = {"share": None} if largest else {"budget": budget, "share": share, "lost": LOST if targets else None}
    drawn = materialize(probabilities(rake(cells, cols, targets, alpha, rounds, tolerance), cols, **size), "probabilities", 1)
    out = rows.join(drawn, cols, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.withColumn("kept", uniform("k", seed) < F.col("probability")).select("k", *cols, "n_tokens", "probability", "kept", "row")


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The documents drawn, with the columns of ``docs``."""
    return mix(docs, **how).where("kept").select("row.*")
