"""Byte packs read back, and answers that are kept."""

import json

import numpy as np
import pytest

from loomtext.sources import bytepacks as P


@pytest.mark.parametrize("parts,task", [(1, 10**6), (4, 70), (1, 1)])
def test_round_trip(spark, tmp_path, parts, task):
    x = np.random.default_rng(1).normal(size=(300, 7))
    df = spark.createDataFrame([(299 - i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 7), (1000, None)], "id long, v array<float>")
    meta = P.write_pack(df, "id", "v", f"{tmp_path}/pack", parts)
    assert meta["n"] == 300 and meta["dims"] == 7 and 0.999 < meta["min_cosine"] < 1
    got = P.read_pack(spark, f"{tmp_path}/pack", 300, task)
    rows = {r.key: r.vec for r in got.collect()}
    assert sorted(rows) == list(range(300)) and got.rdd.getNumPartitions() >= (300 if task == 1 else parts)
    back = np.array([rows[299 - i] for i in range(300)])
    assert np.abs(back - x).max() <= meta["scale"] / 254 + 1e-6
    blob = b"".join((tmp_path / "pack" / f"{p['name']}.bin").read_bytes() for p in meta["parts"])
    assert np.array_equal(np.frombuffer(blob, np.int8).reshape(-1, 7), np.rint(back / meta["scale"] * 127).astype(np.int8)[::-1])


def test_what_doesn_t_fit_fails(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    meta = P.write_pack(df, "id", "v", f"{tmp_path}/pack")
    with pytest.raises(ValueError):
        P.read_pack(spark, f"{tmp_path}/pack", 6)
    blob = tmp_path / "pack" / f"{meta['parts'][0]['name']}.bin"
    blob.write_bytes(blob.read_bytes()[:-1])
    with pytest.raises(Exception, match="expected"):
        P.read_pack(spark, f"{tmp_path}/pack").collect()
    with pytest.raises(ValueError):
        P.write_pack(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v", f"{tmp_path}/uneven")


def test_an_empty_pack(spark, tmp_path):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert P.write_pack(df, "id", "v", f"{tmp_path}/pack")["n"] == 0
    assert P.read_pack(spark, f"{tmp_path}/pack", 0).count() == 0


def test_kept_answers_make_no_request(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(i):
        (asked / f"{i}-{len(list(asked.glob(f'{i}-*')))}").touch()
        return json.dumps({"id": i if i != 13 else 14, "title": f"book {i}", "turn": len(list(asked.glob(f"{i}-*")))})

    path, ids = f"{tmp_path}/catalogue", lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    got = {r.id: json.loads(r.answer)["title"] for r in P.fetched(ids(1, 2, 2, None), "id", path, fetch).collect()}
    assert got == {1: "book 1", 2: "book 2"} and len(list(asked.iterdir())) == 2
    assert P.fetched(ids(1, 2), "id", path, fetch).count() == 2 and len(list(asked.iterdir())) == 2
    assert P.fetched(ids(2, 3), "id", path, fetch).count() == 2 and len(list(asked.iterdir())) == 3
    again = {r.id: json.loads(r.answer)["turn"] for r in P.fetched(ids(2), "id", path, fetch, refresh=True).collect()}
    assert again == {2: 2} and len(list(asked.iterdir())) == 4
    with pytest.raises(Exception, match="asked for 13"):
        P.fetched(ids(13), "id", path, fetch).count()
