"""The stream of changes against the batch operators."""

import json
import random
import time

from pyspark.sql import functions as F

from loomtext.operators import eventlog as G
from loomtext.streaming import corrections as C

SCHEMA = "log string, line long, supersedes long, kind string, payload string"


def records(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for log in ("a", "b", None):
        for line in range(1, n):
            fix = rnd.random() < 0.35
            out.append((log, line, rnd.choice([rnd.randint(1, n + 5), rnd.randint(1, line), None]) if fix else None, "correction" if fix else "step", f"{log}{line}"))
    return out


def run(spark, tmp_path, batches, wait_ms=3_600_000, after=0.0):
    rows = []
    source = tmp_path / "in"
    source.mkdir()
    for i, batch in enumerate(batches):
        (source / f"{i:04d}.json").write_text("\n".join(json.dumps(dict(zip(("log", "line", "supersedes", "kind", "payload"), r, strict=True))) for r in batch))

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    out = C.changes(stream, "log", "line", "supersedes", F.col("kind") == "correction", "payload", wait_ms)
    q = out.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="0 seconds").start()
    # Timers keep such a query going, so it is stopped when all rows are in.
    until = time.time() + 90
    while sum(p["numInputRows"] for p in q.recentProgress) < sum(map(len, batches)) and time.time() < until:
        assert q.exception() is None
        time.sleep(0.2)
    time.sleep(after)
    q.stop()
    return rows


def test_shuffled_batches_add_up_to_the_batch_result(spark, tmp_path):
    rows = records(1)
    shuffled = rows + rows[::9]
    random.Random(2).shuffle(shuffled)
    told = run(spark, tmp_path, [shuffled[i::5] for i in range(5)])
    is_fix = F.col("kind") == "correction"
    table = spark.createDataFrame(rows, SCHEMA)
    want = {(r.log, r.line, r.payload) for r in G.without_voided(table.where("log IS NOT NULL"), "log", "line", "supersedes", is_fix).collect()}
    added, back = [(r.log, r.line, r.payload) for r in told if r.change == "add"], [(r.log, r.line, r.payload) for r in told if r.change == "retract"]
    assert len(added) == len(set(added)) and len(back) == len(set(back)) and set(back) <= set(added)
    assert {r for r in set(added) - set(back) if r[0] is not None} == want and back
    bad = {(r.log, r.line, r.why) for r in G.bad_corrections(table.where("log IS NOT NULL"), "log", "line", "supersedes", is_fix).collect()}
    assert {(r.log, r.by, r.why) for r in told if r.change == "bad" and r.log is not None} == {b for b in bad if b[2] != "no such line"}


def test_a_correction_waits_for_its_line_and_no_longer(spark, tmp_path):
    batches = [[("a", 5, 2, "correction", "c")], [("a", 2, None, "step", "late")], [("a", 9, 4, "correction", "c")]]
    told = run(spark, tmp_path, batches, wait_ms=3000, after=4.0)
    assert {(r.line, r.change, r.by, r.why) for r in told if r.log == "a"} == {(4, "bad", 9, "no such line")}


def test_parts_are_held_until_all_are_there(spark, tmp_path):
    from loomtext.streaming import ingest

    source, rows = tmp_path / "in", []
    source.mkdir()
    parts = [("m", 2, 3, ["c", "d"]), ("n", 1, 1, ["x"]), ("m", 1, 3, ["a", "b"]), ("o", 2, 2, ["lone"]), ("m", 3, 3, []), ("n", 1, 1, ["y"])]
    for i, p in enumerate(parts):
        (source / f"{i}.json").write_text(json.dumps(dict(zip(("key", "part", "parts", "paragraphs"), p, strict=True))))
    stream = spark.readStream.schema("key string, part int, parts int, paragraphs array<string>").option("maxFilesPerTrigger", 2).json(str(source))
    q = ingest.assemble(stream, wait_ms=12_000).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="0 seconds").start()
    until = time.time() + 60
    while len(rows) < 4 and time.time() < until:
        assert q.exception() is None
        time.sleep(0.2)
    q.stop()
    assert sorted((r.key, list(r.paragraphs), r.complete) for r in rows) == [("m", ["a", "b", "c", "d"], True), ("n", ["x"], True), ("n", ["y"], True), ("o", ["lone"], False)]
