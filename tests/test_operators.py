"""Operators against small brute-force versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import aggregates as A
from loomtext.operators import evaluation as E
from loomtext.operators import eventlog as G
from loomtext.operators import models as M
from loomtext.operators import relational as R
from loomtext.operators import search as S
from loomtext.operators import vectors as K
from loomtext.operators.splitting import without_closing
from loomtext.operators.translations import merge_parts
from loomtext.sources import readers, sinks


def test_five_numbers(spark):
    d = spark.createDataFrame([("a", float(x)) for x in [*range(1, 10), 100]] + [("b", 42.0)], "g string, x double")
    got = {r.g: r for r in A.five_numbers(d, ["g"], "x").collect()}
    assert got["a"].whisker_high == 9 and got["a"].outliers == [100.0]
    assert (got["b"].min, got["b"].q1, got["b"].max, got["b"].sd) == (42, 42, 42, 0)


def test_knn_in_blocks_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    got = {(r.id, r["rank"]): r.neighbour for r in K.knn(d, d, "id", "id", "v", 3, block=17).collect()}
    s = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1)[:, :3]
    assert got == {(i, k + 1): best[i, k] for i in range(60) for k in range(3)}


def test_auc_counts_ties_as_halves(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 5) / 2.0, rnd.randint(0, 1)) for _ in range(80)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert E.auc(spark.createDataFrame(rows, "s double, y int"), [], "s", "y").first().auc == pytest.approx(want)
    assert E.auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), [], "s", "y").first().auc is None


@pytest.mark.parametrize(("a", "b", "k"), [([1, 0, 1, 0], [1, 0, 1, 0], 1.0), ([1, 1, 0, 0], [1, 0, 1, 0], 0.0)])
def test_kappa(spark, a, b, k):
    assert E.kappa(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"), "a", "b").first().kappa == pytest.approx(k)


def test_permutation_and_bootstrap(spark):
    far = spark.createDataFrame([(i, float(i % 2 * 10 + i / 100), i % 2) for i in range(60)], "i int, x double, g int")
    assert E.permutation_p(far, "x", "g", "i", 99).first().p < 0.05
    # Equal rows move apart, and group sizes stay: with three values there are three ways to pick one.
    flat = spark.createDataFrame([(0, 1.0, 1), (1, 1.0, 0), (2, 4.0, 0)], "i int, x double, g int")
    assert E.permutation_p(flat, "x", "g", "i", 3000).first().p == pytest.approx(2 / 3 + 1 / 3, abs=1e-9)
    near = spark.createDataFrame([(0, 4.0, 1), (1, 1.0, 0), (2, 1.0, 0)], "i int, x double, g int")
    assert E.permutation_p(near, "x", "g", "i", 3000).first().p == pytest.approx(1 / 3, abs=0.03)
    got = E.bootstrap_ci(far, "x", "i", 400).first()
    assert got.low < got.mean < got.high and got.high - got.low == pytest.approx(4 * 4.99 / 60**0.5, rel=0.2)


def test_corrections(spark):
    rows = [("f", 1, "a", None), ("f", 2, "b", None), ("f", 3, "correction", 1), ("f", 4, "correction", 3), ("f", 5, "correction", 9), ("f", 6, "correction", 1)]
    d = spark.createDataFrame(rows, "file string, line int, event string, supersedes int")
    c = F.col("event") == "correction"
    assert [r.line for r in G.without_voided(d, "file", "line", "supersedes", c).collect()] == [2]
    assert {r.line: r.why for r in G.bad_corrections(d, "file", "line", "supersedes", c).collect()} == {4: "corrects a correction", 5: "no such line", 6: "voided before"}


def test_parts_join_in_numeric_order(spark):
    d = spark.createDataFrame([("a#2", ["c"]), ("a#10", ["z"]), ("a#1", ["a", "b"]), ("b", ["x"])], "id string, paragraphs array<string>")
    got = {r.key: r for r in merge_parts(d).collect()}
    assert got["a"].paragraphs == ["a", "b", "c", "z"] and not got["a"].complete and got["b"].complete


def test_latest_wins(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k int, v string, n int")
    assert {r.k: r.v for r in R.latest_wins(old, new, ["k"], "n").collect()} == {1: "a", 2: "c", 3: "d"}


def test_search_without_long_terms_gives_all(spark):
    d = spark.createDataFrame([(1, "the old king"), (2, "a young king")], "id int, t string")
    assert {r.id for r in S.search_all(d, ["of"], "id", "t").collect()} == {1, 2}
    assert {r.id for r in S.search_all(d, ["king", "old"], "id", "t").collect()} == {1}
    assert S.search_all(d, ["dragon"], "id", "t").count() == 0


def test_procrustes_finds_a_rotation(spark):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    x = rng.normal(size=(50, 4))
    d = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, x @ q, strict=True)], "x array<double>, y array<double>")
    assert np.allclose(M.fit_procrustes(d, "x", "y"), q, atol=1e-8)
    assert np.allclose(M.fit_ridge(d, "x", "y", 1e-9), q, atol=1e-6)


def test_viterbi_separates_two_levels(spark):
    rows = [(d, t, (0.0 if t < 5 else 10.0) + 0.1 * ((t * 7 + d) % 3)) for d in range(4) for t in range(10)]
    f = spark.createDataFrame(rows, "d int, t int, x double")
    m = M.hmm_fit(f, "d", "t", ["x"], k=2, rounds=6)
    got = {(r.d, r.t): r.state for r in M.viterbi(f, "d", "t", ["x"], m).collect()}
    assert len({got[0, t] for t in range(5)}) == 1 and got[0, 0] != got[0, 9]


def test_models_of_sequences_are_those_of_each_sequence_alone(spark):
    """Sequences of all lengths are worked on together, by batches and not by a group each; one round gives the sums of plain recursions."""
    rng = np.random.default_rng(4)
    seqs = {d: rng.normal(d % 3, 1, (n, 2)) for d, n in enumerate([1, 7, 2, 30, 7, 1, 12, 3])}
    rows = [(d, t, float(x[0]), float(x[1])) for d, s in seqs.items() for t, x in enumerate(s)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "d long, t long, x double, y double")
    start = M.hmm_fit(df, "d", "t", ["x", "y"], k=3, rounds=2)
    total = logl = 0.0
    for s in seqs.values():
        e = np.exp(M._log_gauss(s, start["mu"], start["var"]))
        a, f, b = np.exp(start["A"]), [], [np.ones(3)]
        for t in range(len(s)):
            f.append(e[t] * (np.exp(start["pi"]) if t == 0 else f[-1] @ a))
        for t in range(len(s) - 1, 0, -1):
            b.insert(0, a @ (e[t] * b[0]))
        p = f[-1].sum()
        moved = sum((np.outer(f[t], e[t + 1] * b[t + 1]) * a / p for t in range(len(s) - 1)), np.zeros((3, 3)))
        total, logl = total + moved, logl + np.log(p)
    after = M.hmm_fit(df, "d", "t", ["x", "y"], k=3, rounds=3)
    assert np.allclose(np.exp(after["A"]), (total + 1e-6) / (total + 1e-6).sum(1, keepdims=True)) and np.isclose(after["logl"], logl)
    found = M.viterbi(df, "d", "t", ["x", "y"], after)
    got = {(r.d, r.t): r.state for r in found.collect()}
    for d, s in seqs.items():
        ll = M._log_gauss(s, after["mu"], after["var"])
        best, back = after["pi"] + ll[0], []
        for x in ll[1:]:
            step = best[:, None] + after["A"]
            back.append(step.argmax(0))
            best = step.max(0) + x
        path = [int(best.argmax())]
        for b in reversed(back):
            path.insert(0, int(b[path[0]]))
        assert [got[d, t] for t in range(len(s))] == path
    assert len(got) == len(rows) and "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert M.viterbi(df.limit(0), "d", "t", ["x", "y"], after).count() == 0


def test_closing_blocks():
    assert without_closing("A tale.\n\nThe end of it.\n\nTHE END\n\nTom  12\nJack  15") == "A tale.\n\nThe end of it."


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"v":"1","ts":"2026-01-01","project":"p","loop_id":"l","event":"start","data":{"k":"x"}}\n\nbroken\n{"event":"end","data":{}}\n')
    log = readers.event_log(spark, str(tmp_path / "log.jsonl"))
    assert [r.line for r in log.orderBy("line").collect()] == [1, 4]
    assert readers.envelope(log).where("line = 1").first().data == {"k": "x"}
    (tmp_path / "b.json").write_text(json.dumps({"a#1": ["x"], "a#2": ["y"]}))
    assert readers.batches(spark, str(tmp_path / "b.json")).count() == 2
    geo = {"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0]]], [[[2, 2]]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    assert readers.polygons(spark, str(tmp_path / "g.json")).count() == 3
    d = spark.createDataFrame([(1, [0.5, -1.0])], "id long, v array<double>")
    assert sinks.write_pack(d, "id", "v", str(tmp_path / "pack")) == 1.0
    assert readers.pack(spark, str(tmp_path / "pack"), "id", "v", 1).first().v[1] == -1.0
    with pytest.raises(ValueError, match="expected"):
        readers.pack(spark, str(tmp_path / "pack"), "id", "v", 2)
    sinks.write_stamp(d, ["id"], "id", str(tmp_path / "stamp"), True)
    sinks.require_fresh(d, ["id"], "id", str(tmp_path / "stamp"))
    with pytest.raises(RuntimeError):
        sinks.require_fresh(spark.createDataFrame([(2, [0.0])], "id long, v array<double>"), ["id"], "id", str(tmp_path / "stamp"))
    (tmp_path / "latin.txt").write_bytes("é".encode("latin-1"))
    assert readers.raw_texts(spark, str(tmp_path / "latin.txt")).first().text == "é"


def test_streaming(spark, tmp_path):
    from loomtext.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":"x","paragraphs":["p"],"version":1}\n{"id":"y","paragraphs":[],"version":1}\n')
    stream = ingest.incoming(spark, str(tmp_path / "in"))
    bad = F.array_compact(F.array(F.when(F.size("paragraphs") == 0, "empty")))
    q = stream.writeStream.foreachBatch(ingest.upsert_to(str(tmp_path / "store"), str(tmp_path / "bad"), ["id"], "version", bad)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "store/v0")).collect()] == ["x"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


BODY = "word " * 130


def test_trailing_notes():
    from loomtext.operators.splitting import trailing_notes

    text, notes = trailing_notes("A tale.\nIt ends.\n\n[1] A note.\n[2] Another\nthat is folded.")
    assert text == "A tale.\nIt ends." and notes.startswith("[1]")
    assert trailing_notes("A tale.\n[1] one mark alone")[1] == ""


def test_window_packs(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(20, 6)) + 3
    d = spark.createDataFrame([(i // 4, i % 4, x.tolist()) for i, x in enumerate(v)], "owner int, at int, v array<double>")
    said = sinks.write_windows(d, "owner", "at", "v", str(tmp_path / "w"), budget=120)
    assert said["n"] == 20 and said["bytes"] == 120
    back = {(r.owner, r["at"]): r.v for r in readers.windows(spark, str(tmp_path / "w"), "owner", "at", "v", 20).collect()}
    mean = readers.window_mean(spark, str(tmp_path / "w")).first()["mean"]
    assert np.allclose(mean, v.mean(0)) and all(np.abs(np.array(back[i // 4, i % 4]) - (v[i] - v.mean(0))).max() <= said["scale"] / 254 + 1e-9 for i in range(20))
    assert spark.read.json(str(tmp_path / "w/meta")).first().min_cosine > 0.99
    with pytest.raises(ValueError, match="allowed"):
        sinks.write_windows(d, "owner", "at", "v", str(tmp_path / "x"), budget=119)
    with pytest.raises(ValueError, match="expected"):
        readers.windows(spark, str(tmp_path / "w"), "owner", "at", "v", 19)


def test_fingerprints_tell_nulls_and_separators_apart(spark):
    rows = [("a", None), (None, "a"), ("a|", ""), ("a", "|"), ("", ""), (None, None), ("\\n", None)]
    seen = {sinks.fingerprint(spark.createDataFrame([(1, *r)], "k int, x string, y string"), ["x", "y"], "k").first()[0] for r in rows}
    assert len(seen) == len(rows)


def test_catalogue_answers_and_documents(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/7.json").write_text('{"id": 7, "title": "x", "formats": {"text/plain": "http://u/7.txt"}}')
    assert readers.catalogue(spark, str(tmp_path / "c")).first().formats["text/plain"].endswith("7.txt")
    (tmp_path / "c/8.json").write_text('{"id": 9}')
    with pytest.raises(Exception, match="another id"):
        readers.catalogue(spark, str(tmp_path / "c")).collect()
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert readers.documents(spark, str(tmp_path), ["one"])["one"].first().a == 1 and spark.sql("SELECT a FROM one").first().a == 1
    assert sinks.publish({"b": spark.range(2), "a": spark.range(1)}, str(tmp_path / "out")) == ["a", "b"]


BOOK = "By A\n\nCONTENTS.\n\nPREFACE  1\nThe Fox .... 3\nThe Very Long Tale of the Crow and\nthe Well  9\nWhom the King Honors  11\nThe Sun  12\nThe Moon and the Sea  13\n\nILLUSTRATIONS\n\nThe Fox 3\n\n\n\n\n\n"


def test_books_by_contents(spark):
    from loomtext.operators import books as B

    parts = [("PREFACE", 130), ("“THE FOX”", 1), ("THE FOX", 140), ("THE VERY LONG TALE OF THE CROW AND THE WELL", 130), ("WHOM THE KING HONOURS", 125), ("The Sun [12]", 130), ("THE MOON AND THE SEA\nA STORY OF OLD", 122), ("INDEX OF NAMES", 500)]
    text = BOOK + "\n\n\n".join(f"{h}\n\n{'w ' * n}".strip() for h, n in parts)
    d = spark.createDataFrame([("b", text), ("none", "no contents"), ("null", None)], "id string, text string")
    got = B.by_contents(d, "id", "text", alias={"Whom the King Honors": "Whom the King Honours"}, stop_at="^INDEX OF NAMES$").orderBy("start").collect()
    assert [(r.book, r.pos, r.title, len(r.body.split())) for r in got] == [("b", 0, "The Fox", 140), ("b", 1, "The Very Long Tale of the Crow and the Well", 130), ("b", 2, "Whom the King Honors", 125), ("b", 3, "The Sun", 130), ("b", 4, "The Moon and the Sea", 122)]


def test_books_by_numbers(spark):
    from loomtext.operators import books as B

    body = "w " * 125
    text = f"I.\n\n[Illustration]\n\nTHE DEATH OF MAUI\n\n{body}\n\nII.\n\nSECOND\n\n{body}\nIII. is no heading\n\nIV. Fourth\n\n{body}"
    d = spark.createDataFrame([("b", text)], "id string, text string")
    got, problems = B.by_numbers(d, "id", "text", r"^([IVXLC]+)\.(?:\s+(\S.*))?$")
    assert [(r.title, len(r.body.split())) for r in got.orderBy("start").collect()] == [("THE DEATH OF MAUI", 125), ("SECOND", 129), ("Fourth", 125)]
    assert [tuple(r) for r in problems.collect()] == [("b", "not consecutive at 4")]


def test_csv_files_start_with_a_mark(spark, tmp_path):
    from loomtext.sources import sinks

    one, two = spark.createDataFrame([(1, "ä")], "a int, b string"), spark.createDataFrame([(2, 3)], "a int, c int")
    sinks.write_csv([one, two], f"{tmp_path}/out")
    files = [f.read_bytes() for f in (tmp_path / "out").glob("*.csv")]
    assert files and all(f.startswith(b"\xef\xbb\xbfa,b,c\n") for f in files)
    assert sorted(x for f in files for x in f.decode("utf-8-sig").splitlines()[1:]) == ["1,ä,", "2,,3"]
    sinks.write_csv([one], f"{tmp_path}/plain", mark=False)
    assert all(f.read_bytes().startswith(b"a,b\n") for f in (tmp_path / "plain").glob("*.csv"))
