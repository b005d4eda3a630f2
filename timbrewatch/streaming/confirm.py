"""High-risk verdicts and the confirmations of their log entries, on live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timbrewatch.plans.segments import micros


def confirmations_stream(verdicts: DataFrame, confirmations: DataFrame, wait_seconds: int, verdict_delay: str, confirmation_delay: str,
                         ts: str = "event_ts") -> DataFrame:
    """Every HIGH verdict once: when its confirmation comes, or without one when none can come in time any more.

    An outer join of two streams on the entry's id: the watermark passing the end of the wait releases the
    verdict with a null ``delay_ms``, which is the alarm. State is bounded by the wait and the
    delays. Conditions on a stream name its event time, so that rows that only move the watermark
    still do so. Ids are unique on both sides.
    """
    high = verdicts.withWatermark(ts, verdict_delay).where(
        F.when(F.col(ts).isNotNull(), (F.col("tier") == "HIGH") & F.col("event_id").isNotNull())).select("event_id", "call_id", ts)
    came = confirmations.withWatermark("confirmed_ts", confirmation_delay).where(
        F.when(F.col("confirmed_ts").isNotNull(), F.col("event_id").isNotNull())).select(
        F.when(F.col("confirmed_ts").isNotNull(), F.col("event_id")).alias("_id"), "confirmed_ts")
    until = F.col(ts) + F.expr(f"interval {wait_seconds} seconds")  # a literal: the check of watermarks reads it
    joined = high.join(came, (F.col("event_id") == F.col("_id")) & (F.col("confirmed_ts") >= F.col(ts)) & (F.col("confirmed_ts") <= until), "leftOuter")
    delay = ((micros(F.col("confirmed_ts")) - micros(F.col(ts))) / 1000).cast("bigint")
    return joined.select("event_id", "call_id", ts, delay.alias("delay_ms"))
