"""Resampling from counts against resampling of rows."""

from itertools import combinations

import numpy as np

from loomtext.operators import evaluation as E


def test_two_valued_permutations_are_all_of_them(spark):
    rows = [(1, 1)] * 4 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(0, 0)] * 4 + [(None, 1), (1, None)]
    got = E.permutation_two_valued(spark.createDataFrame(rows, "x int, g int"), "x", "g").first()
    x = [a for a, b in rows if a is not None and b is not None]
    seen = 4 / 5 - 2 / 6
    far = [abs(sum(x[i] for i in c) / 5 - (sum(x) - sum(x[i] for i in c)) / 6) >= abs(seen) - 1e-12 for c in combinations(range(11), 5)]
    assert abs(got.seen - seen) < 1e-12 and abs(got.exact - np.mean(far)) < 1e-9
    assert abs(got.p - got.exact) < 0.02
    assert E.permutation_two_valued(spark.createDataFrame([(1, 1)], "x int, g int"), "x", "g").first().p is None
    assert E.permutation_two_valued(spark.createDataFrame([], "x int, g int"), "x", "g").first().seen is None


def auc(score, y):
    d = score[y == 1][:, None] - score[y == 0][None]
    return ((d > 0) + (d == 0) / 2).mean()


def test_paired_bootstrap_equals_resampled_rows(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 150)
    a, b = (y + rng.normal(0, 1, 150)).round(1), (0.3 * y + rng.normal(0, 1, 150)).round(1)
    rows = [(float(p), float(q), int(r)) for p, q, r in zip(a, b, y, strict=True)] + [(None, 1.0, 1)]
    got = E.bootstrap_auc_difference(spark.createDataFrame(rows, "a double, b double, y int"), "a", "b", "y", rounds=1000).first()
    assert abs(got.difference - (auc(a, y) - auc(b, y))) < 1e-9
    plain = []
    for _ in range(1000):
        i = rng.integers(0, 150, 150)
        plain.append(auc(a[i], y[i]) - auc(b[i], y[i]))
    low, high = np.percentile(plain, [2.5, 97.5])
    assert abs(got.low - low) < 0.03 and abs(got.high - high) < 0.03


def test_permuted_targets(spark):
    rows = [(i, i if i < 6 else 0) for i in range(20)] + [(3, 40), (None, 41)]
    got = E.permutation_hits(spark.createDataFrame(rows, "best int, target int"), "best", "target", rounds=3000).first()
    rng, best, target = np.random.default_rng(1), np.array([-1 if b is None else b for b, _ in rows]), np.array([t for _, t in rows])
    plain = [(best == rng.permutation(target)).sum() >= 6 for _ in range(4000)]
    assert abs(got.seen - 6 / 22) < 1e-12 and abs(got.p - (sum(plain) + 1) / 4001) < 0.01
