"""Sinks: fingerprints and stamps, JSON lines, byte packs, CSV with a union header, checked upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK, LEVELS = 4096, 3


def _told(c: str):
    """A value as text in which nulls and separators can't be taken for anything else."""
    t = F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
    return F.coalesce(t, F.lit("\\n"))


def fingerprint(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """First 16 hex digits of a SHA-256 tree over all rows in the order of an integer key, one row.

    Blocks of 4096 neighbouring keys are hashed, then blocks of 4096 blocks, and so on, so no task
    holds more than a block; whatever changes in a row changes the root.
    """
    now = df.select(F.col(order).cast("long").alias("o_"), F.concat_ws("|", *[_told(c) for c in cols]).alias("row_"))
    for _ in range(LEVELS):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_", "row_"))), lambda s: s["row_"]), "\n")
        now = now.groupBy(F.floor(F.col("o_") / BLOCK).cast("long").alias("b_")).agg(F.sha2(joined, 256).alias("row_")).withColumnRenamed("b_", "o_")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_", "row_"))), lambda s: s["row_"]), "\n")
    return now.agg(F.substring(F.sha2(top, 256), 1, 16).alias("fingerprint"))


def write_stamp(df: DataFrame, cols: list[str], order: str, path: str, strict: bool) -> None:
    n = df.agg(F.count("*").alias("n_rows"))
    fingerprint(df, cols, order).crossJoin(n).withColumn("strict", F.lit(strict)).write.mode("overwrite").json(path)  # one row each


def require_fresh(df: DataFrame, cols: list[str], order: str, path: str) -> None:
    """Stop unless the stamp at ``path`` fits the rows."""
    said = df.sparkSession.read.json(path).first()
    now = fingerprint(df, cols, order).first()[0]
    if said is None or said["fingerprint"] != now:
        raise RuntimeError(f"the stamp at {path} isn't of these rows")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, key: str, path: str) -> None:
    """One JSON file per key, in a folder per key; null fields are left out."""
    df.withColumn("key_", F.col(key)).write.mode("overwrite").partitionBy("key_").option("ignoreNullFields", "true").json(path)


def write_csv(frames: list[DataFrame], path: str, mark: bool = True) -> None:
    """Rows of all frames under the union of their columns, with a header; files start with a byte order mark unless ``mark`` is off."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    # A mark before the first name of the header is the file's byte order mark.
    out = out.withColumnRenamed(out.columns[0], f"\ufeff{out.columns[0]}") if mark else out
    out.write.mode("overwrite").option("header", True).csv(path)


def write_pack(df: DataFrame, key: str, vec: str, path: str) -> float:
    """Vectors as bytes under one scale, which is returned and written beside them."""
    from ..functions.arrays import quantise

    scale = df.select(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double")))).alias("m")).agg(F.max("m")).first()[0] or 1.0
    packed = df.select(F.col(key), F.transform(quantise(F.col(vec), F.lit(scale)), lambda x: x.cast("tinyint")).alias(vec), F.lit(scale).alias("scale"))
    packed.write.mode("overwrite").parquet(path)
    return float(scale)


def write_windows(df: DataFrame, owner: str, offset: str, vec: str, path: str, budget: int | None = None) -> dict:
    """Windows as bytes under one scale after the mean vector is taken off, by owner and offset; returns what the pack's ``meta`` says.

    The mean, the scale and the smallest cosine of a window with what is read back are written beside the rows. A
    pack over ``budget`` bytes (one per coordinate) isn't written.
    """
    from ..functions import arrays as V
    from ..operators.aggregates import vector_mean

    one = vector_mean(df.withColumn("all_", F.lit(1)), ["all_"], vec).select("mean")
    rows = df.select(owner, offset, vec).crossJoin(F.broadcast(one)).withColumn("c_", V.minus(F.transform(vec, lambda x: x.cast("double")), F.col("mean")))  # one row
    said = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.array_max(F.transform("c_", F.abs))), F.lit(0.0)).alias("scale"), F.coalesce(F.sum(F.size("c_")), F.lit(0)).alias("bytes")).first()
    if budget is not None and said["bytes"] > budget:
        raise ValueError(f"{said['bytes']} bytes of windows where {budget} are allowed")
    scale = said["scale"] or 1.0
    packed = rows.select(owner, offset, F.transform(V.quantise(F.col("c_"), F.lit(scale)), lambda x: x.cast("tinyint")).alias(vec))
    packed.write.mode("overwrite").parquet(f"{path}/windows")
    back = F.transform(V.quantise(F.col("c_"), F.lit(scale)), lambda x: x.cast("double") * scale / 127)
    cosine = V.dot(F.col("c_"), back) / F.greatest(V.norm(F.col("c_")) * V.norm(back), F.lit(1e-12))
    meta = one.crossJoin(F.broadcast(rows.agg(F.min(cosine).alias("min_cosine")))).select("mean", F.lit(scale).alias("scale"), F.lit(said["n"]).alias("n"), "min_cosine")  # one row each
    meta.write.mode("overwrite").json(f"{path}/meta")
    return {"n": said["n"], "scale": scale, "bytes": said["bytes"]}


def write_report(sections: DataFrame, expected: DataFrame, key: str, path: str) -> DataFrame:
    """(key, found, expected, ok) of a split: written as JSON lines and returned; ``expected`` has (key, expected)."""
    found = sections.groupBy(F.col("book").alias(key)).agg(F.count("*").alias("found"))
    report = expected.join(found, key, "left").select(key, F.coalesce("found", F.lit(0)).alias("found"), "expected").withColumn("ok", F.col("found") == F.col("expected"))
    report.write.mode("overwrite").json(path)
    return report


def publish(frames: dict[str, DataFrame], path: str) -> list[str]:
    """Named artefacts as JSON documents, a folder each; returns the names in order."""
    for name, df in sorted(frames.items()):
        df.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/{name}")
    return sorted(frames)


def export_star(events: DataFrame, key: list[str], kind: str, path: str) -> None:
    """fact_events, fact_keys and dim_kind as tables below ``path``."""
    events.write.mode("overwrite").parquet(f"{path}/fact_events")
    events.groupBy(*key).agg(F.count("*").alias("n"), F.collect_set(kind).alias("kinds")).write.mode("overwrite").parquet(f"{path}/fact_keys")
    events.groupBy(kind).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/dim_kind")


def append_valid(batch: DataFrame, bad, path: str, rejects: str) -> None:
    """Rows without violations are appended; the others go to ``rejects`` with their reasons. ``bad`` is an array column."""
    judged = batch.withColumn("bad_", bad)
    judged.where(F.size("bad_") == 0).drop("bad_").write.mode("append").parquet(path)
    judged.where(F.size("bad_") > 0).write.mode("append").parquet(rejects)


