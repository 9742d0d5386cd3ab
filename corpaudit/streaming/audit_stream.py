"""Incremental work: documents audited as they arrive, latest stages, retention of runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpaudit import tables
from corpaudit.operators.audit import audit
from corpaudit.sources.corpus import to_paragraphs


def read_documents(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of (doc_id, text) from Parquet files as they arrive."""
    reader = spark.readStream.schema("doc_id bigint, text string")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def audit_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audits each batch of new documents by the text rules.

    A batch is whole when its mark stands beside its output: repeated after that it is passed over, repeated before it overwrites what it left.
    Scratch tables go with their batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, f"{path}/_whole/batch={number}"
        if tables.marked(spark, done):
            return
        with tables.scope(spark):
            out = audit(to_paragraphs(batch))
            for name in ("issues", "rule_results", "report"):
                out[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        tables.mark(spark, done)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stage(events: DataFrame) -> DataFrame:
    """run_id, stage, status, ts: the latest status of each stage. The same aggregate runs on streams in update mode."""
    return events.groupBy("run_id", "stage").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))


def expire(runs: DataFrame, now, minutes: int = 60) -> DataFrame:
    """Runs (run_id, status, ts) younger than the retention, and those still processing."""
    return runs.where((F.col("status") == "processing") | (F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES")))


def expire_stream(runs: DataFrame, minutes: int = 60) -> DataFrame:
    """On a stream of (run_id, status, ts): run_id, status, ts, expired.

    A run's latest state is given whenever it changes. It is kept until the watermark passes its time by the retention,
    then given once more as expired and forgotten; a run still processing is kept on. State is one row per live run.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.getOption
        if state.hasTimedOut:
            status, at = held
            if status == "processing":
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + minutes * 60_000)
                return
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": [status], "ts": [pd.Timestamp(at, unit="ms")], "expired": [True]})
            return
        newest = held
        for rows in batches:
            millis = rows["ts"].astype("datetime64[ms]").astype("int64")
            for status, at in zip(rows["status"], millis, strict=True):
                # of one time the greatest status counts, as in latest_stage
                if newest is None or (at, status) > (newest[1], newest[0]):
                    newest = (status, int(at))
        state.update(newest)
        state.setTimeoutTimestamp(max(newest[1] + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        if newest != held:
            yield pd.DataFrame({"run_id": [key[0]], "status": [newest[0]], "ts": [pd.Timestamp(newest[1], unit="ms")], "expired": [False]})

    key = runs.schema["run_id"].dataType.simpleString()
    named = runs.select("run_id", "status", "ts").withWatermark("ts", "0 seconds").groupBy("run_id")
    return named.applyInPandasWithState(keep, f"run_id {key}, status string, ts timestamp, expired boolean", "status string, at long", "update", GroupStateTimeout.EventTimeTimeout)
