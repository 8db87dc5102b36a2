"""An append-only log with corrections as a stream: what counts is added, and taken back once when it is corrected.

A record's state is kept under its log and line, and a correction goes to the line that it supersedes, so
both may come in any order and in any batch. The changes given out so far always add up to what the
batch operators of ``eventlog`` give for what has come so far, but for corrections that still wait for their line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "log string, line long, change string, by long, why string, payload string"
_COLUMNS = ["log", "line", "change", "by", "why", "payload"]


def keep_state(spark: SparkSession) -> None:
    """Stateful operators of several states need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Retractions(StatefulProcessor):
    """State of one line: the record, once it has come; the correction that voids it; corrections that wait for it."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "payload string, correction boolean, by long")
        self.waiting = handle.getListState("waiting", "by long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log, line = key
        marks, came = [], None
        for batch in rows:
            for r in batch.itertuples():
                if r.kind == 1:
                    marks.append(int(r.by))
                elif came is None:
                    came = (None if pd.isna(r.payload) else r.payload, bool(r.correction))
        known = self.record.get() if self.record.exists() else None
        fresh = known is None and came is not None
        if known is None and came is None:
            if not self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            held = {by for (by,) in self.waiting.get()} if self.waiting.exists() else set()
            self.waiting.put([(by,) for by in sorted(held | set(marks))])
            return
        payload, correction, voided = known if known is not None else (*came, None)
        if fresh and self.waiting.exists():
            marks += [by for (by,) in self.waiting.get()]
            self.waiting.clear()
        out, before = [], voided
        for by in sorted(set(marks)):
            why = "points ahead" if by <= line else "corrects a correction" if correction else None
            if why:
                out.append((log, line, "bad", by, why, None))
            elif voided is None:
                voided = by
            elif by != voided:
                out.append((log, line, "bad", max(by, voided), "voided before", None))
                voided = min(by, voided)
        if fresh and not correction and voided is None:
            out.append((log, line, "add", None, None, payload))
        if not fresh and before is None and voided is not None:
            out.append((log, line, "retract", voided, None, payload))
        self.record.update((payload, correction, voided))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.record.exists() and self.waiting.exists():
            yield pd.DataFrame([(*key, "bad", by, "no such line", None) for (by,) in self.waiting.get()], columns=_COLUMNS)
            self.waiting.clear()

    def close(self) -> None:
        pass


def changes(events: DataFrame, log: str, line: str, supersedes: str, is_correction, payload: str, wait_ms: int = 3_600_000) -> DataFrame:
    """(log, line, change, by, why, payload) from a stream of records: add, retract, and bad corrections with their reasons.

    A record is given out when it comes unless a correction is there already; it is taken back once, by the
    first valid correction. A correction of a correction never counts. One whose line hasn't come
    after ``wait_ms`` is bad; if the line comes still, it stays. A record that comes twice counts once.
    """
    keep_state(events.sparkSession)
    row = events.select(F.col(log).cast("string").alias("log"), F.col(line).cast("long").alias("by"), F.col(supersedes).cast("long").alias("to"), is_correction.alias("correction"), F.col(payload).cast("string").alias("payload"))
    record = F.struct(F.col("by").alias("line"), F.lit(0).alias("kind"), "by", "correction", "payload")
    mark = F.struct(F.col("to").alias("line"), F.lit(1).alias("kind"), "by", F.lit(None).cast("boolean").alias("correction"), F.lit(None).cast("string").alias("payload"))
    each = row.select("log", F.explode(F.when(F.col("correction") & F.col("to").isNotNull(), F.array(record, mark)).otherwise(F.array(record))).alias("e")).select("log", "e.*")
    return each.groupBy("log", "line").transformWithStateInPandas(Retractions(wait_ms), CHANGES, "Append", "ProcessingTime")
