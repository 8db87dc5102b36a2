"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from loomtext.llm import minhash, ngramjoin

from .conftest import prose
from .test_duplicates import brute_components, family


def told(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("width,percent", [(5, 80), (4, 60)])
def test_components_are_those_of_all_pairs(spark, width, percent):
    rnd = random.Random(width * percent)
    texts = family(rnd, 120, 90, 4) + family(rnd, 60, 40, 2) + family(rnd, 40, 300, 14) + [prose(rnd, 60) for _ in range(40)]
    # A passage that unlike documents share, and documents that are little else.
    passage = prose(rnd, 60)
    texts += [f"{prose(rnd, rnd.randint(5, 80))} {passage} {prose(rnd, rnd.randint(5, 80))}" for _ in range(60)]
    texts += ["Same Words\there", "same words here", "one", "One", "", None, "  ", "a b c d e f", "A b c d e F g"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    want = brute_components(rows, width, percent)
    assert told(ngramjoin.jaccard_join(frame(spark, rows), width=width, percent=percent)) == want
    assert len({c for _, _, c in want}) < len(rows) - 100


def test_loads_and_fragments_don_t_change_results(spark, monkeypatch):
    rnd = random.Random(3)
    rows = list(enumerate(family(rnd, 60, 80, 8) + family(rnd, 60, 60, 6) + [prose(rnd, 50) for _ in range(30)]))
    want = brute_components(rows, 5, 80)
    for held, docs, spread, fragments, early in ((150, 7, 1, 2, 1), (10**6, 11, 40, 16, 15)):
        for name, value in (("HELD", held), ("DOCS", docs), ("SPREAD", spread), ("FRAGMENTS", fragments), ("EARLY", early)):
            monkeypatch.setattr(ngramjoin, name, value)
        assert told(ngramjoin.jaccard_join(frame(spark, rows, 9))) == want


def test_every_pair_that_is_linked_passes_the_first_count():
    rnd, seen = random.Random(5), 0
    for _ in range(3000):
        n, percent = rnd.randint(1, 120), rnd.choice([50, 70, 80, 95])
        both = [rnd.getrandbits(64) for _ in range(rnd.randint(-(-percent * n // 100), n))]
        a, b = (sorted(both + [rnd.getrandbits(64) for _ in range(k)]) for k in (n - len(both), rnd.randint(0, n // 3)))
        if 100 * len(both) < percent * (len(a) + len(b) - len(both)):
            continue
        seen += 1
        x, y = (set(s[: 2 * ngramjoin.lacking(len(s), percent) + 1]) for s in (a, b))
        for s in (a, b):
            assert len(x & y) > ngramjoin.lacking(-(-percent * len(s) // 100), percent)
    assert seen > 500
    of = ngramjoin.fragment_of(np.sort(np.array([rnd.getrandbits(64) for _ in range(9999)], np.uint64)), 80, 37)
    assert of.min() == 0 and of.max() == 36 and (np.diff(of) >= 0).all()


def test_odd_rows(spark, odd_docs, no_docs):
    got = ngramjoin.jaccard_join(odd_docs).collect()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert len(got) == odd_docs.count()
    assert by[0, 0] == 0 and by[1, 0] == 1 and by[2, 0] == 2
    assert by[3, 1] == 3 and by[None, 1] == 3, "a row without a key takes part through its equal row"
    long_ = [r for r in got if r.doc_id in (7, 100)]
    assert {r.component_id for r in long_} == {7} and {r.n_shingles for r in long_} == {5}
    assert ngramjoin.jaccard_join(no_docs).count() == 0
    assert {(r.doc_id, r.n_shingles) for r in got} == {(r.doc_id, r.n_shingles) for r in minhash.near_duplicates(odd_docs, width=5).collect()}


def test_one_key_with_several_texts_is_one_node(spark):
    rnd = random.Random(8)
    a, b = prose(rnd, 50), prose(rnd, 50)
    rows = [(5, a), (5, b), (1, a), (2, b + " end"), (9, prose(rnd, 50)), (9, prose(rnd, 50))]
    got = {(r.doc_id, r.component_id) for r in ngramjoin.jaccard_join(frame(spark, rows)).collect()}
    assert got == {(5, 1), (1, 1), (2, 1), (9, 9)}
