"""The neighbour index against all pairs."""

import numpy as np

from loomtext.operators import ivf, vectors


def table(spark, n=1500, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dims))[rng.integers(0, 20, n)] * 2 + rng.normal(0, 0.5, (n, dims))
    x[50:80] = x[50]
    keys = rng.permutation(n) - 100
    return spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x, strict=True)] + [(9999, None), (None, [0.0] * dims)], "id long, v array<double>")


def test_exact_search_gives_what_all_pairs_give_and_probes_most_of_it(spark, monkeypatch):
    df = table(spark)
    index = ivf.build(df, "id", "v", lists=25)
    assert index.lists.agg({"n": "sum"}).first()[0] == 1500
    want = vectors.knn(df.where("id IS NOT NULL AND v IS NOT NULL"), df.where("id IS NOT NULL AND v IS NOT NULL"), "id", "id", "v", 10).selectExpr("id AS q", "neighbour AS key", "score", "rank")
    told = lambda d: {(r.q, r.key, r.rank, round(r.score, 6)) for r in d.collect()}
    whole = told(want)
    assert len(whole) == 15000
    monkeypatch.setattr(ivf, "BLOCK", 30)
    monkeypatch.setattr(ivf, "QUERIES", 40)
    assert told(ivf.search(index, df, "id", "v", 10, probes=1, exact=True)) == whole
    few = ivf.search(index, df, "id", "v", 10, probes=5)
    assert ivf.recall(few, want).first().recall >= 0.95
    assert ivf.rows_read(index, df, 5) < 600


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<float>")
    index = ivf.build(df, "id", "v", lists=50)
    got = {(r.q, r.key, r.rank) for r in ivf.search(index, df, "id", "v", 5, exact=True).collect()}
    assert got == {(1, 3, 1), (1, 2, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2)}
    none = ivf.build(df.limit(0), "id", "v", lists=4)
    assert ivf.search(none, df, "id", "v", 5, exact=True).count() == 0


def test_queries_and_blocks_are_sent_once_to_each_other(spark, monkeypatch):
    """Small lists share a block and large ones have several; what a search moves is a query once a block, as floats if they were floats."""
    monkeypatch.setattr(ivf, "BLOCK", 100)
    assert ivf._blocks({0: 40, 1: 50, 3: 20, 4: 250, 5: 10, 6: 90}, 7) == ([0, 0, None, 1, 2, 5, 5], [0, 0, None, 1, 4, 5, 5])
    rows = table(spark, 400).where("id IS NOT NULL AND v IS NOT NULL").selectExpr("id", "cast(v AS array<float>) AS v")
    index = ivf.build(rows, "id", "v", lists=8)
    monkeypatch.setattr(ivf, "BLOCK", 1000)
    asked = rows.selectExpr("id AS q", "v", "array(0, 1, 2, 3, 4, 5, 6, 7) AS lists", "double('-inf') AS least")
    scan = ivf._scan(asked, index, 5, True)
    assert index.kind == "array<float>" and scan.count() >= 2000 and scan.count() < 2000 + 5 * 30
    want = vectors.knn(rows, rows, "id", "id", "v", 5).selectExpr("id AS q", "neighbour AS key", "score", "rank")
    told = lambda d: {(r.q, r.key, r.rank, round(r.score, 6)) for r in d.collect()}
    assert told(ivf.search(index, rows, "id", "v", 5, probes=2, exact=True)) == told(want)
