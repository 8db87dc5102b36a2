"""Structured Streaming forms of the incoming-folder, multi-part and retraction dataflows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import latest_wins
from .corrections import keep_state

BATCH = "id string, paragraphs array<string>, version long"


def incoming(spark: SparkSession, path: str, schema: str = BATCH, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def upsert_to(store: str, rejects: str, key: list[str], version: str, bad):
    """A ``foreachBatch`` function: valid rows are merged into ``store`` by key, others appended to ``rejects``.

    The merged table is written beside the old one and named by the batch, so a batch that runs again
    gives the same table.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        judged = batch.withColumn("bad_", bad)
        judged.where(F.size("bad_") > 0).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        good = judged.where(F.size("bad_") == 0).drop("bad_")
        if batch_id > 0:
            merged = latest_wins(spark.read.schema(good.schema).parquet(f"{store}/v{batch_id - 1}"), good, key, version)
        else:
            merged = latest_wins(good.limit(0), good, key, version)
        merged.write.mode("overwrite").parquet(f"{store}/v{batch_id}")

    return run


class Assembly(StatefulProcessor):
    """Parts of one message by number, and how many there are to be."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n int")
        self.parts = handle.getMapState("parts", "number int", "paragraphs array<string>")

    def _told(self, key: tuple, complete: bool) -> pd.DataFrame:
        held = sorted((k[0], list(v[0])) for k, v in self.parts.iterator())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.parts.clear()
        self.total.clear()
        return pd.DataFrame({"key": [key[0]], "paragraphs": [[p for _, ps in held for p in ps]], "complete": [complete]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in rows:
            for n, m, ps in zip(batch["part"], batch["parts"], batch["paragraphs"], strict=True):
                self.parts.updateValue((int(n),), (list(ps),))
                total = int(m)
        self.total.update((total,))
        if {k[0] for k in self.parts.keys()} == set(range(1, total + 1)):
            yield self._told(key, True)
        else:
            # Time runs from the last part that came.
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.total.exists():
            yield self._told(key, False)

    def close(self) -> None:
        pass


def assemble(parts: DataFrame, wait_ms: int = 3_600_000) -> DataFrame:
    """(key, paragraphs, complete) from a stream of (key, part, parts, paragraphs): held until all parts are there or time is up."""
    keep_state(parts.sparkSession)
    return parts.groupBy("key").transformWithStateInPandas(Assembly(wait_ms), "key string, paragraphs array<string>, complete boolean", "Append", "ProcessingTime")


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and kind; rows later than ``late`` are let go."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark: idempotent delivery."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
