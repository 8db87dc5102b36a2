"""Near duplicates and repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from loomtext.llm import minhash, suffix

from .conftest import prose


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(len(w), width)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    ids = [k for k, _ in rows]
    best = {i: i for i in ids}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(ids[a]), root(ids[b])))
                best[y] = x
    return {(k, len(s), root(k)) for k, s in zip(ids, sets, strict=True)}


def family(rnd, n, words, edits):
    base = prose(rnd, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_components_are_those_of_all_pairs(spark, width):
    rnd = random.Random(width)
    texts = family(rnd, 120, 90, 9) + family(rnd, 30, 40, 3) + [prose(rnd, 60) for _ in range(30)] + ["Same Words\there", "same words here", "one", "One", "", None, "  "]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_odd_documents(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs, width=5)
    assert got.count() == odd_docs.count() and minhash.near_duplicates(no_docs).count() == 0
    by = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    assert by[100, 5].component_id == 7 and by[None, 1].component_id == 3 and by[0, 0].kept


def brute_repeats(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.view(np.int8)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("per_anchor", [2, 1000])
def test_repeats_are_those_of_all_windows(spark, monkeypatch, per_anchor):
    monkeypatch.setattr(suffix, "PER_ANCHOR", per_anchor)
    rnd = random.Random(5)
    passage, other = prose(rnd, 60), prose(rnd, 45)
    texts = [prose(rnd, 30) + " " + passage + " " + prose(rnd, rnd.randint(5, 40)) for _ in range(12)]
    texts += [prose(rnd, 90), passage[:150] + other, other[20:] + passage, "ab" * 400, "ab" * 300 + "c", "x" * 900, "é" * 300, "same " * 90, "same " * 90, "short", "", passage + passage]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 120).collect()
    want = brute_repeats([t.encode() for _, t in rows], 120)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((k, *w) for (k, _), w in zip(rows, want, strict=True))


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    order, _ = suffix.suffix_array(data, 512)
    text = data.tobytes()
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    lcp = suffix.kasai(data, order, 512)
    for k in range(1, len(order)):
        a, b = text[order[k] :], text[order[k - 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_repeats_in_odd_documents(odd_docs, no_docs):
    got = suffix.remove_repeats(odd_docs, 400).collect()
    assert len(got) == odd_docs.count() and suffix.remove_repeats(no_docs, 400).count() == 0
    assert {r.n_removed for r in got if r.doc_id in (7, 100)} == {20000}
    assert next(r for r in got if r.doc_id == 6).n_removed == 5000
