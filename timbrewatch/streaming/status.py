"""Call status and tier changes on live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbrewatch.operators.risk import call_status, transitions
from timbrewatch.sources.clips import exists
from timbrewatch.streaming.replay import each_batch


def status_updates(verdicts: DataFrame, ts: str, tie: str) -> DataFrame:
    """Latest verdict per call; run in update mode, it emits the calls that changed."""
    return call_status(verdicts, ts, tie)


def status_sink(path: str):
    """Batch handler that stores each update set under its batch number (safe to repeat)."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return store


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The current row of each call from the stored updates."""
    updates = spark.read.parquet(path)
    columns = [c for c in updates.columns if c not in ("call_id", "batch_id")]
    return updates.groupBy("call_id").agg(
        F.max_by(F.struct(*columns), "batch_id").alias("_s")).select("call_id", "_s.*")


def closed_slices(verdicts: DataFrame, watermark: str, slice_width: str, ts: str, tie: str) -> DataFrame:
    """Verdicts of a call in time order, one row per closed time slice.

    State is keyed by (call, slice); a slice holds what one call can produce in
    that time. A closed slice is final, and slices come out in time order.
    """
    return (
        verdicts.withWatermark(ts, watermark)
        .groupBy("call_id", F.window(ts, slice_width).alias("_slice"))
        .agg(F.array_sort(F.collect_list(F.struct(ts, tie, "tier"))).alias("_rows"))
    )


def transitions_sink(path: str, ts: str, tie: str, segment_seconds: int):
    """Batch handler that appends tier changes, continuing from the stored ones.

    The last tier of a call is that of its last stored change, so no other
    state is kept. Changes are stored under the batch number: a repeated batch
    reads the changes before it and overwrites its own.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("call_id", F.explode("_rows").alias("_r")).select("call_id", "_r.*")
        edges = transitions(rows, ts, tie, segment_seconds)
        if exists(spark, path):
            past = (
                spark.read.parquet(path).where(F.col("batch_id") < batch_id)
                .join(batch.select("call_id").distinct(), "call_id", "left_semi")
            )
            last = past.groupBy("call_id").agg(
                F.max_by("to_tier", F.struct(ts, tie)).alias("_last"))
            edges = (
                edges.join(last, "call_id", "left")
                .withColumn("from_tier", F.coalesce("from_tier", "_last")).drop("_last")
                .where(~F.col("from_tier").eqNullSafe(F.col("to_tier")))
            )
        edges.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return store


def run_transitions(verdicts: DataFrame, path: str, checkpoint: str, watermark: str, slice_width: str,
                    ts: str, tie: str, segment_seconds: int) -> None:
    """Replay what is available into the change table at ``path``."""
    slices = closed_slices(verdicts, watermark, slice_width, ts, tie)
    each_batch(slices, transitions_sink(path, ts, tie, segment_seconds), checkpoint)
