"""The whole pipeline against a version that works row by row."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomtext.llm import decontam, minhash, mixing, toxicity

from .conftest import ODD, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    bench = [(i, prose(rnd, 40, 5000)) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        w = prose(rnd, rnd.randint(30, 200), 2000).split()
        toxic = i % 4 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["worthless", "disgusting"])
        rows.append((i, " ".join(w), rnd.choice(["en", "fr"]), rnd.choice(["hot", "hot", "s1", "s2"])))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + k, rows[k][1] + " end", "en", "s1") for k in (1, 2, 3)]
    rows += [(400 + k, f"{prose(rnd, 60, 2000)} {bench[k][1]} {prose(rnd, 30, 2000)}", "fr", "s2") for k in range(3)]
    rows += [(500 + i, t, None, None) for i, t in enumerate(ODD)] + [(503, "word", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before = docs
        out = stage(spark, docs, folder)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = (before, docs)
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    before, after = seen["toxicity"]
    scorer = toxicity.Scorer(toxicity.fit(before, labels))
    assert ids(after) == sorted(r.doc_id for r in before.collect() if scorer(r.text or "") < 0.5)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(set(ids(after)) & toxic) <= 2 and len(set(ids(before)) - toxic - set(ids(after))) <= 8

    before, after = seen["minhash_near_dedup"]
    sets = {}
    for r in before.collect():
        w = (r.text or "").encode().lower().split()
        k = min(len(w), 5)
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    kept = ids(after)
    for a in sets:
        twins = [b for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert (a in kept) == (not twins)
    assert len(kept) == len(set(kept))

    before, after = seen["benchmark_decontamination"]
    items = [decontam.Item(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = lambda t: any(x.held_by(decontam.words_of(t or "")[max(0, p - len(x.words)) : p + 64 + len(x.words)])[0] for x in items for p in range(0, max(1, len(decontam.words_of(t or "")) - 32), 32))
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not held(r.text)) and not {400, 401, 402} & set(ids(after))

    before, after = seen["mixing"]
    assert ids(after) == sorted(r.k for r in mixing.mix(before).where("kept").collect())

    before, after = seen["token_output"]
    from tokenizers import Tokenizer

    tk, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in after.collect()}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        x = [*tk.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)


def test_run_gives_what_the_stages_give(spark, folder):
    last = spark.read.parquet(f"{folder}/{P.STAGES[-1][0]}")
    assert sorted(map(tuple, P.run(spark, folder).collect())) == sorted(map(tuple, last.collect()))


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_its_documents_columns(spark):
    names = "doc_id long, text string, hash_ int, kept_ int, key_ string, row_ string, `a.b` int, node int, component long"
    row = lambda k, t, h: (k, t, h, 1, "k", "r", 2, 3, 4)
    d = spark.createDataFrame([row(1, "a b c", 5), row(1, "a b c", 5), row(2, "a b c", 6), row(None, "z", 7)], names)
    out = P.one_of_each_group(spark, d, "")
    assert out.columns == d.columns and sorted(((r.doc_id or 0), r.hash_) for r in out.collect()) == [(0, 7), (1, 5)]
    assert minhash.near_duplicates(d.drop("key_")).count() == 4


def test_every_stage_keeps_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    for c in ("k", "h", "t", "row_", "row", "hash_", "kept", "n", "score", "topic", "probability", "key", "text_"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.where("hash_ <> 'hash_' OR k <> 'k' OR kept <> 'kept' OR topic <> 'topic'").count() == 0, name
    assert P.STAGES[-1][1](spark, docs, folder).count() == docs.count()
