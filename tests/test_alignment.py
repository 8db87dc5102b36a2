"""The residual map: gradients, learning beside the linear maps, and the cache of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import alignment as A
from loomtext.operators import models as M


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    w = [rng.normal(0, 0.3, s) for s in ((4, 6), 6, (6, 4), 4)]
    x, y = rng.normal(size=(9, 4)), rng.normal(size=(9, 4))
    _, got = A.gradients(w, x, y, 0.2)
    for k, g in enumerate(got):
        for at in np.ndindex(g.shape):
            up, down = [[v.copy() for v in w] for _ in range(2)]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (A.gradients(up, x, y, 0.2)[0] - A.gradients(down, x, y, 0.2)[0]) / 2e-5
            assert abs(slope - g[at]) < 1e-4


def pairs(n=700, dims=8, seed=3):
    """A bent and turned copy: no linear map undoes it."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    y = np.abs(x) @ turn + 0.3 * x + rng.normal(0, 0.05, (n, dims))
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    return unit(x), unit(y)


def hits(a, b):
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    return (np.argmax(a @ b.T, axis=1) == np.arange(len(a))).mean()


def test_the_loss_falls_and_held_out_pairs_are_found(spark):
    x, y = pairs()
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x[:600], y[:600], strict=True))] + [(900, None, [0.0] * 8)], "k long, x array<double>, y array<double>")
    model = A.fit_residual(df, "k", "x", "y", hidden=32, epochs=12, batch=100, rate=1e-2)
    assert len(model.losses) == 12 and model.losses[-1] < 0.7 * model.losses[0]
    good = df.where("x IS NOT NULL")
    turned, ridge = M.fit_procrustes(good, "x", "y"), M.fit_ridge(good, "x", "y")
    told = {name: hits(v, y[600:]) for name, v in (("none", x[600:]), ("procrustes", x[600:] @ turned), ("ridge", x[600:] @ ridge), ("residual", model(x[600:])))}
    assert told["residual"] > max(told["none"], told["procrustes"], told["ridge"]), told
    got = A.apply_residual(df.where("k IN (0, 900)"), "x", model).orderBy("k").collect()
    assert np.allclose(got[0].x, model(x[:1])[0]) and got[1].x is None


def test_too_few_pairs_and_unlike_dimensions(spark):
    with pytest.raises(ValueError):
        A.fit_residual(spark.createDataFrame([(1, [1.0], [1.0])], "k long, x array<double>, y array<double>"), "k", "x", "y")
    with pytest.raises(ValueError):
        A.fit_residual(spark.createDataFrame([(1, [1.0], [1.0, 2.0])] * 3, "k long, x array<double>, y array<double>"), "k", "x", "y")


def test_only_changed_regions_are_computed_and_replaced(spark, tmp_path):
    seen = []

    def embed(df):
        seen.append(sorted(r.region for r in df.select("region").distinct().collect()))
        return df.withColumn("v", F.length("text"))

    path = f"{tmp_path}/cache"
    rows = [("a", 1, "xx"), ("a", 2, "yyy"), ("b", 1, "z"), ("c", 1, "w")]
    table = lambda r: spark.createDataFrame(r, "region string, i int, text string")
    assert sorted(A.refresh_pairs(table(rows), "region", path, embed)) == ["a", "b", "c"]
    before = {f.name: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if "region=b" not in str(f)}
    changed = [r if r[0] != "b" else ("b", 1, "zzzz") for r in rows] + [("b", 2, "new")]
    assert A.refresh_pairs(table(changed), "region", path, embed) == ["b"]
    assert A.refresh_pairs(table(changed), "region", path, embed) == []
    assert seen == [["a", "b", "c"], ["b"]]
    assert before == {f.name: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if "region=b" not in str(f)}
    assert {(r.i, r.v) for r in A.cached_pairs(spark, path, "region", "b", 2).collect()} == {(1, 4), (2, 3)}
    with pytest.raises(ValueError):
        A.cached_pairs(spark, path, "region", "b", 3)
