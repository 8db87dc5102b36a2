"""Evaluation: retrieval ranks, agreement, AUC, effect sizes, resampling tests, gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Distribution function of a Poisson variable of mean 1 at 0, 1, 2 and so on.
POISSON_CUTS = [round(float(c), 12) for c in np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(8)])]


def derangement(df: DataFrame, key: str, shift: int) -> DataFrame:
    """(key, other): every key with another one, by a cyclic shift of the sorted keys. The keys are a small label set."""
    w = Window.partitionBy(F.lit(1)).orderBy(key)
    r = df.select(key).distinct().withColumn("i_", F.row_number().over(w) - 1).withColumn("n_", F.count("*").over(Window.partitionBy(F.lit(1))))
    other = r.select(F.col(key).alias("other"), F.col("i_").alias("j_"))
    return r.withColumn("j_", (F.col("i_") + shift) % F.col("n_")).join(other, "j_").select(key, "other")


def retrieval(ranks: DataFrame, rank: str = "rank", pool: str | None = None) -> DataFrame:
    """p1, p5, mrr, median_rank (and chance, with the pool's size) over one row per query."""
    out = [F.avg(F.when(F.col(rank) == 1, 1.0).otherwise(0.0)).alias("p1"), F.avg(F.when(F.col(rank) <= 5, 1.0).otherwise(0.0)).alias("p5"), F.avg(1 / F.col(rank)).alias("mrr"), F.median(rank).alias("median_rank")]
    return ranks.agg(*out, *([F.avg(1 / F.col(pool)).alias("chance")] if pool else []))


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by, n_pos, n_neg, auc): Mann-Whitney with ties as halves; null where a class is empty.

    From counts per distinct score, so ties cost nothing.
    """
    per = df.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p_"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n_"))
    part = Window.partitionBy(*(by or [F.lit(1)])).orderBy(score)
    per = per.withColumn("below_", F.coalesce(F.sum("n_").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = per.groupBy(*by).agg(F.sum("p_").alias("n_pos"), F.sum("n_").alias("n_neg"), F.sum(F.col("p_") * (F.col("below_") + F.col("n_") / 2)).alias("u_"))
    return g.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u_") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def macro_auc(df: DataFrame, by: str, score: str, label: str, least: int = 3) -> DataFrame:
    a = auc(df, [by], score, label).where((F.col("n_pos") >= least) & (F.col("n_neg") >= least))
    return a.agg(F.avg("auc").alias("macro_auc"), F.count("*").alias("n_labels"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    m = df.agg(F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("po"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def f1(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    s = df.agg(F.sum(F.col(predicted) * F.col(gold)).alias("tp"), F.sum(predicted).alias("p"), F.sum(gold).alias("g"))
    return s.select(F.when(F.col("p") + F.col("g") > 0, 2 * F.col("tp") / (F.col("p") + F.col("g"))).otherwise(0.0).alias("f1"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information with the arithmetic mean, from the contingency counts."""
    c = df.groupBy(a, b).agg(F.count("*").alias("c"))
    total = df.agg(F.count("*").alias("n"))
    pa, pb = c.groupBy(a).agg(F.sum("c").alias("ca")), c.groupBy(b).agg(F.sum("c").alias("cb"))
    j = c.join(pa, a).join(pb, b).crossJoin(F.broadcast(total))  # one row
    mi = j.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))).alias("mi"))
    h = lambda d, x, name: d.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(x) / F.col("n") * F.log(F.col(x) / F.col("n")))).alias(name))
    return mi.crossJoin(h(pa, "ca", "ha")).crossJoin(h(pb, "cb", "hb")).select(F.when(F.col("ha") + F.col("hb") > 0, F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).otherwise(1.0).alias("nmi"))  # one row each


def band(p: Column) -> Column:
    return F.when(p.isNull(), "not judged").when(p < 0.01, "supported").when(p <= 0.10, "weak").otherwise("not supported")


def gate(value: Column, threshold: float, higher: bool = True) -> Column:
    """Null where there is nothing to judge."""
    return value >= threshold if higher else value <= threshold


def _draw(key: str, seed: int) -> Column:
    """A hash of key, round and seed that every engine has."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("r").cast("string"), F.lit(str(seed))))


def permutation_p(df: DataFrame, x: str, group: str, key: str, rounds: int = 5000, seed: int = 0) -> DataFrame:
    """(seen, p): permutation test of the difference of two groups' means (1 against 0) over units with a unique ``key``.

    In each round the units are put in the order of a hash and the first get the label 1, as many as have
    it, so group sizes never change. Rounds are dealt over tasks. Units are the unit of independence, such as books:
    rows that belong together are averaged before. p is (extreme + 1) / (rounds + 1).
    """
    rows = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(group).cast("int").alias("g")).where("x IS NOT NULL AND g IS NOT NULL")
    n = rows.agg(F.sum("g").alias("ones"), (F.avg(F.when(F.col("g") == 1, F.col("x"))) - F.avg(F.when(F.col("g") == 0, F.col("x")))).alias("seen"))
    each = rows.select("k", "x", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy(_draw("k", seed), "k")))
    s = each.crossJoin(F.broadcast(n)).withColumn("one", F.col("place") <= F.col("ones")).groupBy("r", "seen").agg((F.avg(F.when(F.col("one"), F.col("x"))) - F.avg(F.when(~F.col("one"), F.col("x")))).alias("d"))  # one row
    return s.agg(F.first("seen").alias("seen"), ((F.count_if(F.abs("d") >= F.abs("seen")) + 1) / (F.lit(rounds) + 1)).alias("p"))


def permutation_two_valued(df: DataFrame, x: str, group: str, rounds: int = 5000, seed: int = 0) -> DataFrame:
    """(seen, p, exact): permutation test of the difference of two groups' shares for an ``x`` of 0 and 1.

    Under a permutation, how many ones fall into the first group follows from four counts alone: it is
    hypergeometric. So rounds are draws of that number, whatever the number of rows; ``exact`` is the share of all
    permutations that are as extreme as what is seen. Null if a group is empty.
    """
    import hashlib
    import math

    rows = df.select(F.col(x).cast("long").alias("x"), F.col(group).cast("long").alias("g")).where("x IS NOT NULL AND g IS NOT NULL")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("k"), F.coalesce(F.sum("g"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.col("x") * F.col("g")), F.lit(0)).alias("h"))

    def run(batches):
        import numpy as np
        import pandas as pd

        lg = np.frompyfunc(lambda v: math.lgamma(v + 1), 1, 1)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                n, k, m = int(r.n), int(r.k), int(r.m)
                if not 0 < m < n:
                    out.append((None, None, None))
                    continue
                j = np.arange(max(0, m + k - n), min(m, k) + 1)
                logs = sum(s * lg(v).astype(float) for s, v in ((1, np.full(len(j), k)), (-1, j), (-1, k - j), (1, np.full(len(j), n - k)), (-1, m - j), (-1, n - k - m + j), (-1, np.full(len(j), n)), (1, np.full(len(j), m)), (1, np.full(len(j), n - m))))
                share = np.exp(logs)
                seen = r.h / m - (k - r.h) / (n - m)
                far = np.abs(j / m - (k - j) / (n - m)) >= abs(seen) - 1e-12
                u = np.array([int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(1, rounds + 1)])
                drawn = np.minimum(np.searchsorted(np.cumsum(share), u), len(j) - 1)
                out.append((seen, (far[drawn].sum() + 1) / (rounds + 1), min(1.0, share[far].sum())))
            yield pd.DataFrame(out, columns=["seen", "p", "exact"])

    return counts.mapInPandas(run, "seen double, p double, exact double")


def bootstrap_auc_difference(df: DataFrame, one: str, two: str, label: str, rounds: int = 2000, seed: int = 0, deal: int = 50) -> DataFrame:
    """(difference, low, high): AUC of ``one`` less that of ``two`` on the same rows, with a 95 % interval of the paired bootstrap.

    Rows of equal scores and label are one cell with a count. A round draws new counts for all cells from
    a multinomial distribution, so its cost follows the number of distinct scores, never that of rows times rounds. Rounds without both labels are left out.
    """

    def run(g):
        import numpy as np
        import pandas as pd

        g = g.sort_values(["a", "b", "y"])
        y, n, total = g["y"].to_numpy() == 1, g["n"].to_numpy(), int(g["n"].sum())

        def auc(score, w):
            values, at = np.unique(score, return_inverse=True)
            good, bad = np.bincount(at, w * y, len(values)), np.bincount(at, w * ~y, len(values))
            below = np.cumsum(bad) - bad
            both = good.sum() * bad.sum()
            return ((below + bad / 2) * good).sum() / both if both else np.nan

        part, rng = int(g["part"].iloc[0]), np.random.default_rng([seed, int(g["part"].iloc[0]) + 1])
        a, b = g["a"].to_numpy(), g["b"].to_numpy()
        draws = [n] if part < 0 else rng.multinomial(total, n / total, deal)
        return pd.DataFrame({"part": part, "d": [auc(a, w) - auc(b, w) for w in draws]})

    cells = df.select(F.col(one).cast("double").alias("a"), F.col(two).cast("double").alias("b"), F.col(label).cast("int").alias("y")).where("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "y").agg(F.count("*").alias("n"))
    # Part -1 is the rows as they are; each other part has all cells and ``deal`` rounds.
    spread = cells.withColumn("part", F.explode(F.sequence(F.lit(-1), F.lit(-(-rounds // deal) - 1))))
    d = spread.groupBy("part").applyInPandas(run, "part int, d double").where("NOT isnan(d)")
    ci = F.percentile(F.when(F.col("part") >= 0, F.col("d")), F.array(F.lit(0.025), F.lit(0.975)))
    return d.agg(F.max(F.when(F.col("part") < 0, F.col("d"))).alias("difference"), ci.alias("ci")).select("difference", F.get("ci", F.lit(0)).alias("low"), F.get("ci", F.lit(1)).alias("high"))


def permutation_hits(df: DataFrame, best: str, target: str, rounds: int = 5000, seed: int = 0, deal: int = 50) -> DataFrame:
    """(seen, p): share of queries whose best answer is their target, against targets permuted among the queries.

    Only how often each answer is best and how often it is a target counts; a query whose best answer is
    nobody's target can't hit. Rounds are dealt over tasks, which draw who gets which target.
    """

    def run(g):
        import numpy as np
        import pandas as pd

        part = int(g["part"].iloc[0])
        rng = np.random.default_rng([seed, part])
        # Answers in one order; those who would like one, and the targets there are.
        likes, wanted = np.repeat(np.arange(len(g)), g["liked"]), np.repeat(np.arange(len(g)), g["asked"])
        n = len(wanted)
        likes = np.r_[likes, np.full(n - len(likes), -1)]
        return pd.DataFrame({"hits": [int((rng.permutation(wanted) == likes).sum()) for _ in range(deal)]})

    rows = df.where(F.col(target).isNotNull()).select(F.col(best).alias("b"), F.col(target).alias("t"))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("b") == F.col("t")).alias("hit"))
    liked = rows.where("b IS NOT NULL").groupBy(F.col("b").alias("v")).agg(F.count("*").alias("liked"))
    asked = rows.groupBy(F.col("t").alias("v")).agg(F.count("*").alias("asked"))
    cells = asked.join(liked, "v", "left").select("v", "asked", F.coalesce("liked", F.lit(0)).alias("liked"))
    spread = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // deal) - 1)))).withColumn("r_", F.xxhash64("v"))
    hits = spread.groupBy("part").applyInPandas(lambda g: run(g.sort_values("r_")), "hits long")
    out = hits.crossJoin(F.broadcast(seen))  # one row
    return out.groupBy("n", "hit").agg(((F.count_if(F.col("hits") >= F.col("hit")) + 1) / (F.count("*") + 1)).alias("p")).select((F.col("hit") / F.col("n")).alias("seen"), "p")


def bootstrap_ci(df: DataFrame, x: str, key: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """(mean, low, high): mean with a 95 % interval by the Poisson bootstrap over units with a unique ``key``.

    Each unit's weight in each round comes from a hash, so rounds add up in partial sums.
    """
    rows = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x")).where("x IS NOT NULL")
    each = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.conv(F.substring(_draw("k", seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON_CUTS), F.lit(0))
    means = each.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).crossJoin(F.broadcast(rows.agg(F.avg("x").alias("mean")))).select("mean", F.get("ci", F.lit(0)).alias("low"), F.get("ci", F.lit(1)).alias("high"))  # one row


def leave_one_out_corr(df: DataFrame, x: str, y: str, a: str, b: str) -> DataFrame:
    """(left, r): correlation over pairs that don't touch a group, for every group; from sums per group, so no pair is repeated."""
    s = lambda d: d.agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    whole = s(df).select(*[F.col(c).alias(f"t_{c}") for c in names])
    touched = df.withColumn("left", F.explode(F.array_distinct(F.array(a, b))))
    d = s(touched.groupBy("left")).crossJoin(F.broadcast(whole))  # one row
    v = {c: F.col(f"t_{c}") - F.col(c) for c in names}
    r = (v["n"] * v["sxy"] - v["sx"] * v["sy"]) / F.sqrt((v["n"] * v["sxx"] - v["sx"] * v["sx"]) * (v["n"] * v["syy"] - v["sy"] * v["sy"]))
    return d.select("left", r.alias("r"))


def rank_variants(rows: DataFrame, query: str, owner: str, book: str, score: str, top: int = 3) -> DataFrame:
    """(variant, query, owner, score) in four ways: an owner's best window or the mean of its best ``top``, as it is or as a z-score among its book's owners.

    Books of two owners or fewer keep their scores as they are. Moments are grouped sums joined back, one row for each query and book.
    """
    w = Window.partitionBy(query, owner).orderBy(F.desc(score))
    best = rows.where(F.col(score).isNotNull()).withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= top)
    own = best.groupBy(query, owner, book).agg(F.max(score).alias("best"), F.avg(score).alias("mean"))
    kinds = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("s")) for n in ("best", "mean")])
    plain = own.select(query, owner, book, F.explode(kinds).alias("v")).select("v.variant", query, owner, book, F.col("v.s").alias("score"))
    moments = plain.groupBy("variant", query, book).agg(F.count("*").alias("n_"), F.avg("score").alias("m_"), F.stddev_pop("score").alias("d_"))
    z = F.when(F.col("n_") > 2, (F.col("score") - F.col("m_")) / F.greatest(F.lit(1e-9), "d_")).otherwise(F.col("score"))
    by_book = plain.join(moments, ["variant", query, book]).select(F.concat("variant", F.lit(" by book")).alias("variant"), query, owner, z.alias("score"))
    return plain.select("variant", query, owner, "score").union(by_book)


def median_gaps(variants: DataFrame, query: str, owner: str, wide: float) -> DataFrame:
    """(variant, gap, wide): the median over queries of what lies between the first and the second owner."""
    w = Window.partitionBy("variant", query).orderBy(F.desc("score"), owner)
    two = variants.withColumn("k_", F.row_number().over(w)).where("k_ <= 2").groupBy("variant", query).agg(F.max("score").alias("a"), F.min("score").alias("b"), F.count("*").alias("n"))
    gap = F.median(F.when(F.col("n") == 2, F.col("a") - F.col("b")))
    return two.groupBy("variant").agg(gap.alias("gap")).withColumn("wide", F.col("gap") >= wide)
