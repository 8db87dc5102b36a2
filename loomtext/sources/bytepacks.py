"""Vectors as raw bytes: one signed byte a value, in the order of their keys, with what is needed to read them back.

A pack is a folder of parts and its ``meta.json``: dimensions, the one scale, the parts in order
with their rows, and the smallest cosine between a vector and what is read back. Keys lie in an index
of 8-byte integers beside each part. Readers take ranges of rows of any part, so a pack of one large part is read by many tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of values that one reading task takes.
RANGE = 16 << 20


def _store(path: str):
    """(file system, path) of a URI or a plain path, on the driver and in tasks."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_pack(df: DataFrame, key: str, vec: str, path: str, parts: int = 1) -> dict:
    """Write the vectors of ``df`` by ascending key under one scale, their largest absolute value; returns the meta data.

    Rows without a key or vector are left out. A task that runs again writes under another name, and only parts in the meta data count.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("k"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    told = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("scale"), F.max(F.size("v")).alias("dims"), F.min(F.size("v")).alias("least")).first()
    if told.dims != told.least:
        raise ValueError("vectors of a pack have the same length")
    scale, dims = float(told.scale or 1.0) or 1.0, int(told.dims or 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, n, least, first = f"part-{uuid.uuid4().hex}", 0, 1.0, None
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}.bin") as values, store.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch["v"].to_numpy()).astype(float)
                q = np.clip(np.rint(x / scale * 127), -127, 127).astype(np.int8)
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(q.astype(float), axis=1)
                cosine = np.where(size > 0, (x * q).sum(axis=1) / np.maximum(size, 1e-300), 1.0)
                keys = batch["k"].to_numpy(np.int64)
                values.write(q.tobytes())
                index.write(keys.astype("<i8").tobytes())
                n, least, first = n + len(x), min(least, float(cosine.min())), int(keys[0]) if first is None else first
        if n:
            yield pd.DataFrame({"name": [name], "first": [first], "n": [n], "cosine": [least]})

    ranged = rows.repartitionByRange(parts, "k").sortWithinPartitions("k")
    got = ranged.mapInPandas(run, "name string, first long, n long, cosine double").orderBy("first").collect()  # a row for each part
    meta = {"dims": dims, "scale": scale, "n": sum(r.n for r in got), "min_cosine": min((r.cosine for r in got), default=1.0), "parts": [{"name": r.name, "n": r.n} for r in got]}
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/meta.json") as out:
        out.write(json.dumps(meta).encode())
    return meta


def read_meta(path: str) -> dict:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/meta.json") as f:
        return json.loads(f.read())


class _Range(InputPartition):
    def __init__(self, name: str, first: int, n: int):
        self.name, self.first, self.n = name, first, n


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))
        self.meta = read_meta(self.path)

    def partitions(self) -> list[_Range]:
        """Ranges of rows, after every part was held against the meta data."""
        store, root = _store(self.path)
        dims, out = self.meta["dims"], []
        if self.meta["n"] != sum(p["n"] for p in self.meta["parts"]):
            raise ValueError("the parts of the pack don't add up to its rows")
        for part in self.meta["parts"]:
            sizes = [store.get_file_info(f"{root}/{part['name']}.{kind}").size for kind in ("bin", "idx")]
            if sizes != [part["n"] * dims, part["n"] * 8]:
                raise ValueError(f"{part['name']} has {sizes} bytes, {[part['n'] * dims, part['n'] * 8]} expected")
            step = max(1, self.range // max(1, dims))
            out += [_Range(part["name"], at, min(step, part["n"] - at)) for at in range(0, part["n"], step)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range):
        import pyarrow as pa

        if not partition.n:
            return
        store, root = _store(self.path)
        dims = self.meta["dims"]
        with store.open_input_file(f"{root}/{partition.name}.bin") as f:
            values = np.frombuffer(f.read_at(partition.n * dims, partition.first * dims), np.int8).reshape(-1, dims)
        with store.open_input_file(f"{root}/{partition.name}.idx") as f:
            keys = np.frombuffer(f.read_at(partition.n * 8, partition.first * 8), "<i8")
        for at in range(0, partition.n, 4096):
            x = values[at : at + 4096].astype(float) * (self.meta["scale"] / 127)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 4096].astype(np.int64)), lists], ["key", "vec"])


class BytePack(DataSource):
    """``spark.read.format("bytepack").load(path)``: (key, vec)."""

    @classmethod
    def name(cls) -> str:
        return "bytepack"

    def schema(self) -> str:
        return "key long, vec array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pack(spark: SparkSession, path: str, expected: int | None = None, bytes_per_task: int = RANGE) -> DataFrame:
    """(key, vec) of a pack; its meta data must tell of ``expected`` rows if that is given."""
    if expected is not None and read_meta(path)["n"] != expected:
        raise ValueError(f"the pack has {read_meta(path)['n']} rows, {expected} expected")
    spark.dataSource.register(BytePack)
    return spark.read.format("bytepack").option("range", bytes_per_task).load(path)


def fetched(ids: DataFrame, key: str, path: str, fetch, refresh: bool = False) -> DataFrame:
    """(id, answer): a catalogue's JSON answers for ``ids``, kept below ``path``.

    ``fetch`` takes an id and returns a JSON text; only ids whose answers aren't kept are asked for, all of them
    with ``refresh``. An answer whose ``id`` is another than was asked for stops the run and isn't kept.
    """
    spark = ids.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    kind = "id long, answer string, run string"
    kept = spark.read.schema(kind).parquet(f"{path}/*") if there else spark.createDataFrame([], kind)
    wanted = ids.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    todo = wanted if refresh else wanted.join(kept.select("id"), "id", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [fetch(int(i)) for i in batch["id"]]
            for i, a in zip(batch["id"], answers, strict=True):
                if json.loads(a).get("id") != i:
                    raise ValueError(f"asked for {i}, got {json.loads(a).get('id')}")
            yield pd.DataFrame({"id": batch["id"], "answer": answers})

    # Runs are named so that later ones sort behind earlier ones.
    run = f"{kept.agg(F.coalesce(F.max('run'), F.lit(''))).first()[0][:9] or 0:0>9}"
    name = f"{int(run) + 1:09d}-{uuid.uuid4().hex}"
    if not todo.isEmpty():
        todo.mapInPandas(ask, "id long, answer string").withColumn("run", F.lit(name)).write.parquet(f"{path}/{name}")
        kept = spark.read.schema(kind).parquet(f"{path}/*")
    latest = kept.join(wanted, "id", "left_semi").groupBy("id").agg(F.max_by("answer", "run").alias("answer"))
    return latest
