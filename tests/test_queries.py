"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomtext import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the provided tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(6)
        else:
            df[c] = df[c].map(lambda x: "" if x is None or x is pd.NaT or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = rows(plans.QUERIES[name](spark, FOLDER).toPandas()), rows(duck.execute(plans.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert ((got[c] - want[c].astype(float)).abs().fillna(0) <= 2e-6 * (1 + got[c].abs().fillna(0))).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_keeps_its_rules(spark, name):
    got = plans.QUERIES[name](spark, FOLDER).toPandas()
    again = got if name in LONG else plans.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0 or name in MAY_BE_EMPTY
    assert sorted(got.columns) == sorted(again.columns) and len(got) == len(again)
    for c in got.columns:
        assert got[c].notna().any() or not len(got), c
        if pd.api.types.is_float_dtype(got[c]):
            assert not np.isinf(got[c]).any(), c
    if name in WHOLE:
        table, key = WHOLE[name]
        want = set(spark.read.parquet(f"{FOLDER}/{table}.parquet").toPandas()[key])
        assert set(got[key]) == want, "a row of the table has no answer"
    if name in CHECKS:
        assert CHECKS[name](got), name


#: Queries whose answer has every row of a table, those that may find nothing in the provided tables, and what else has to hold.
WHOLE = {"ve01_encode": ("documents", "doc_id"), "st06_backmatter": ("documents", "doc_id"), "st07_catalogue": ("documents", "doc_id"), "st08_trailing_nonprose": ("documents", "doc_id"), "ml01_layout": ("embeddings", "vec_id"), "ml02_clusters": ("embeddings", "vec_id"), "ir13_rank_preservation": ("embeddings", "vec_id"), "ml13_correspondence": ("documents", "source")}
#: Queries of many rounds, which run once here; their modules have tests of their own.
LONG = {"ir04_lsa", "ml01_layout", "ml02_clusters"}
MAY_BE_EMPTY = {"pf15_suspicious_edges", "st25_candidate_names"}
CHECKS = {
    "ir04_lsa": lambda d: d["held"].between(0, 1 + 1e-6).all() and d["held"].mean() > 0.5 and (d["first_axis"] <= d["held"] + 1e-6).all(),
    "ve01_encode": lambda d: ((d["norm"] - 1).abs() < 1e-3).mean() > 0.9,
    "ir13_rank_preservation": lambda d: d["overlap"].between(0.5, 1).all(),
    "ml06_ml09_hmm": lambda d: d["state"].between(0, 4).all() and d["state"].nunique() > 1 and not d.duplicated(["conv_id", "turn"]).any(),
    "ml04_ag25_topics": lambda d: d["topic"].between(0, 11).all() and (d["mass"] >= 0).all(),
    "ml02_clusters": lambda d: d["cluster"].min() >= -1 and (d.groupby("cluster")["size"].first() == d["cluster"].value_counts()).all(),
    "ve13_residual_map": lambda d: d.sort_values("epoch")["loss"].iloc[-1] < 0.9 * d.sort_values("epoch")["loss"].iloc[0],
    "ml13_correspondence": lambda d: sorted(d["axis"].unique()) == [0, 1],
    "ml14_correspondence_without": lambda d: "src0" not in set(d["source"]),
}


def test_books_of_one_or_two_documents_are_split(spark, tmp_path):
    """Every long document is a section, also where its book has few or no source."""
    places = [(1, "one"), (2, "two"), (3, "two"), (1501, "two"), *[(i, "many") for i in range(4, 10)], (10, None), (2000, None), (11, "short")]
    docs = [(i, s, ("Word " * 10 if s == "short" else f"Say{i} and\nword. " * 60)) for i, s in places]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "wn15_st18_split_by_contents"
    got, want = rows(plans.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.execute(plans.SQL[name]).df())
    assert len(want) == len(docs) - 1 and got.astype(str).equals(want.astype(str))


def test_authors_of_repeated_lone_and_unnamed_documents(spark, tmp_path, monkeypatch):
    """Repeated keys count repeatedly, and documents meet authors in blocks."""
    from loomtext.operators import models

    monkeypatch.setattr(models, "DOCUMENTS", 7)
    monkeypatch.setattr(models, "AUTHORS", 2)
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefg"), 2))
    docs = [(i, "lone" if i == 3 else ["a", "b", "c"][i % 3], " ".join(word() for _ in range(5 + i % 40))) for i in range(60)]
    docs += [docs[5], docs[5], (7, "c", "ab ab cd"), (100, "b", ""), (101, "a", None), (102, None, "ab cd ef ab"), (None, "a", "ab ab")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("ml10_delta_profile", "ml11_ml12_attribution"):
        got, want = rows(plans.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.execute(plans.SQL[name]).df())
        assert len(got) == len(want) and got.astype(str).compare(want.astype(str)).empty, name


def test_pairs_of_repeated_keys_and_unknown_nations(spark, tmp_path):
    """Counts and gaps of pairs come from sums, without a join of suppliers with suppliers."""
    rng = np.random.default_rng(3)
    one = lambda i: (None if i % 31 == 0 else i // 2 if i % 5 == 0 else i, None if i % 11 == 0 else int(rng.integers(0, 4)), None if i % 13 == 0 else round(float(rng.normal(0, 1)) * 100, rng.integers(0, 3)))
    spark.createDataFrame([one(i) for i in range(300)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    found = plans.QUERIES["jn07_triangle"](spark, str(tmp_path))
    told = lambda d: {(r["same"], r["pairs"], round(r["gap"], 4)) for r in d}
    want = told(dict(zip(("same", "pairs", "gap"), r, strict=True)) for r in con.execute(plans.SQL["jn07_triangle"]).fetchall())
    assert told(found.collect()) == want and {w[0] for w in want} == {True, False, None}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_entries_and_headings_that_begin_each_other(spark, tmp_path):
    """All begin with the same twelve letters; no join holds all entries against all headings of such a beginning."""
    name = "st16_prefix_match"
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("ab"), n))
    docs = [(i, " ".join(["Collectively"] + [word(int(rng.integers(1, 5))) for _ in range(int(rng.integers(0, 8)))])) for i in range(400)]
    docs += [(400 + i, f"Institutional {word(6)}{i} {word(3)} {word(3)} more of it") for i in range(50)]
    docs += [docs[401], docs[402], (900, None), (901, ""), (None, docs[403][1]), (902, "Shortwords a"), (903, "Extraordinarilylong"), (904, "Extraordinarilylongest of")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = plans.QUERIES[name](spark, str(tmp_path))
    got, want = rows(found.toPandas()), rows(con.execute(plans.SQL[name]).df())
    assert len(want) > 3 and got.astype(str).equals(want.astype(str))
    assert "substring(key" not in plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().replace("xxhash64(substring(key", "")


def test_ranks_of_gold_documents_that_are_not_first(spark, tmp_path, monkeypatch):
    """Ranks are counted in blocks of documents and queries, ties go by key, and no plan ranks all documents of a query."""
    from loomtext.operators import search

    monkeypatch.setattr(search, "DOCUMENTS", 9)
    monkeypatch.setattr(search, "QUERIES", 3)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abc"), 2))
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(5, 60))))) for i in range(80)]
    items = [(i, docs[i * 3][1][2 : 2 + int(rng.integers(4, 20))]) for i in range(20)]
    docs += [(200 + i, items[i][1] + " " + items[i][1]) for i in range(0, 20, 3)] + [(300 + i, docs[i][1]) for i in range(0, 60, 4)] + [(400, None), (401, "")]
    items += [(50, "123"), (51, ""), (52, None), (53, "nowhere at all"), (54, "a"), (55, "ab. cb")]
    for name, table, kind in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(table, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = plans.QUERIES["ir07_gold_retrieval"](spark, str(tmp_path))
    got, want = rows(found.toPandas()), rows(con.execute(plans.SQL["ir07_gold_retrieval"]).df())
    assert got.astype(str).equals(want.astype(str)) and want["mrr"].iloc[0] < 0.9 and want["n"].iloc[0] >= 15
    assert "Window" not in found._jdf.queryExecution().toString()
    benchmark, documents = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("benchmark", "documents"))
    told = lambda most: {(r.item_id, r.doc_id) for r in search.containing(benchmark, documents, "item_id", "doc_id", most=most).collect()}
    assert told(10_000) == told(1)


def test_all_pairs_meet_in_blocks(spark, duck, monkeypatch):
    from loomtext.plans import relational

    monkeypatch.setattr(relational, "PAIRED", 3)
    found = plans.QUERIES["jn06_theta_self"](spark, FOLDER)
    assert rows(found.toPandas()).equals(rows(duck.execute(plans.SQL["jn06_theta_self"]).df()))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
