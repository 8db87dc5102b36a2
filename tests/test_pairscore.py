"""The pair scorer: packing, best chunks, resuming, a trained model."""

import random

import numpy as np
import pytest

from loomtext.operators import pairscore as P

LABELS = {"birth": "a child is born", "death": "somebody dies", "road": "they leave home"}


def by_words():
    """Share of a hypothesis' words that the premise has."""
    return lambda pairs: np.array([np.mean([w in p.split() for w in h.split()]) for p, h in pairs])


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_only_premises_are_cut():
    assert P.packed(list("abcdef"), ["h"] * 4, 12) == (list("abcde"), True)
    assert P.packed(list("abcde"), ["h"] * 4, 12) == (list("abcde"), False)
    assert P.packed(list("ab"), ["h"] * 40, 12) == ([], True)


def test_a_document_has_its_best_chunk(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [(1, f"{filler} a child is born {filler}"), (2, "somebody dies"), (3, None), (4, "")]
    s = P.chunk_scores(docs(spark, rows), "id", "text", LABELS, by_words, "v1", most=100)
    assert {(r.id, r.chunk) for r in s.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0)}
    got = {(r.id, r.label): r for r in P.document_scores(s, LABELS).collect()}
    assert len(got) == 12
    assert (got[1, "birth"].score, got[1, "birth"].position, got[1, "birth"].assigned) == (1.0, 1, True)
    assert (got[1, "death"].score, got[1, "death"].position, got[1, "death"].assigned) == (0.0, 0, False)
    assert got[2, "death"].assigned and not got[3, "death"].assigned and got[4, "road"].score == 0.0
    assert {r.truncated for r in s.where("id = 1 AND chunk < 2").collect()} == {True}


def test_a_run_resumes(spark, tmp_path):
    store, calls = f"{tmp_path}/scores", f"{tmp_path}/calls"

    def counting():
        import os
        import uuid

        def score(pairs):
            os.makedirs(calls, exist_ok=True)
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(pairs)))
            return np.zeros(len(pairs))

        return score

    def asked():
        n = sum(int(f.read_text()) for f in (tmp_path / "calls").iterdir()) if (tmp_path / "calls").exists() else 0
        return n

    run = lambda rows, name, labels=LABELS, load=counting: P.score_missing(docs(spark, rows), store, name, "id", "text", labels, load, "v1")
    rows = [(i, f"text {i}") for i in range(10)]
    assert run(rows, "one") == 10 and asked() == 30
    assert run(rows, "two") == 0 and run(rows, "one") == 0 and asked() == 30, "nothing that is stored is scored again"
    changed = [(i, f"text {i}" if i else "another") for i in range(12)] + [(11, "text 11"), (None, "x")]
    assert run(changed, "three") == 3 and asked() == 39

    def broken():
        def score(pairs):
            raise RuntimeError("the worker is gone")

        return score

    more = [(i, f"text {i}") for i in range(12, 15)]
    with pytest.raises(Exception, match="the worker is gone"):
        run(more, "four", load=broken)
    assert P.stored_scores(spark, store).select("id", "fingerprint").distinct().count() == 13
    assert run(changed + more, "four") == 3 and asked() == 48
    assert run(rows, "five", labels={"road": LABELS["road"]}) == 10, "other hypotheses, other fingerprints"


def test_a_stream_scores_new_documents_once(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    store = f"{tmp_path}/scores"

    def drain(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "text": t}) for i, t in rows))
        q = spark.readStream.schema("id long, text string").json(f"{tmp_path}/in").writeStream.foreachBatch(P.scoring_batches(store, "id", "text", LABELS, by_words, "v1")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    drain("a.json", [(1, "a child is born"), (2, "no")])
    drain("b.json", [(1, "a child is born"), (2, "they leave home"), (3, "x")])
    got = P.stored_scores(spark, store)
    assert got.groupBy("id").count().orderBy("id").collect() == [(1, 1), (2, 2), (3, 1)]


def test_a_trained_model_tells_held_out_pairs(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    hyps = {f"about {w}": w for w in words[:6]}
    rows = []
    for i in range(900):
        h, w = rnd.choice(list(hyps.items()))
        yes = rnd.random() < 0.5
        text = rnd.sample([x for x in words if x != w], 12) + ([w] if yes else [])
        rnd.shuffle(text)
        rows.append((i, " ".join(text), h, int(yes)))
    df = spark.createDataFrame(rows, "i int, p string, h string, y int")
    model = P.fit_pairs(df.where("i < 700"), "p", "h", "y", size=1 << 14, rounds=150)
    held = [r for r in rows if r[0] >= 700]
    right = np.mean((model([(p, h) for _, p, h, _ in held]) >= 0.5) == np.array([y for *_, y in held]))
    assert right > 0.9
    assert P.fit_pairs(df.limit(0), "p", "h", "y", size=64)([("a", "b")]).tolist() == [0.5]
