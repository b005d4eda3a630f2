"""Sliding windows and speech runs on live streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.operators.windows import sliding, window_chunks


def sliding_stream(df: DataFrame, size: str, hop: str, aggs: Sequence[Column], watermark: str,
                   ts: str = "event_ts") -> DataFrame:
    """Sliding windows per call, emitted once when the watermark passes their end."""
    return sliding(df.withWatermark(ts, watermark), size, hop, aggs, ts=ts)


def window_chunks_stream(df: DataFrame, size_ms: int, hop_ms: int, watermark: str) -> DataFrame:
    """Complete sample windows across chunk borders, from de-duplicated chunks."""
    return window_chunks(df, size_ms, hop_ms, watermark)


def speech_runs_stream(voiced: DataFrame, gap: str, watermark: str, ts: str = "event_ts") -> DataFrame:
    """Runs of voiced chunks as sessions; a pause is the gap between two runs.

    With local merging on, tasks shuffle their sessions and not their rows.
    """
    return (
        voiced.withWatermark(ts, watermark)
        .groupBy("call_id", F.session_window(ts, gap).alias("_run"))
        .agg(F.count("*").alias("n_chunks"))
        .select("call_id", F.col("_run.start").alias("run_start"),
                F.col("_run.end").alias("run_end"), "n_chunks")
    )
