"""Transaction holds linked to risky calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timbrewatch.plans.asof import asof_join
from timbrewatch.plans.segments import micros


def asof_verdict(txns: DataFrame, verdicts: DataFrame, segment_seconds: int = 3600) -> DataFrame:
    """Each transaction with the last verdict of its account at or before it.

    ``verdicts``: ``account_id, verdict_ts, event_id`` and ``value``.
    """
    return asof_join(
        txns, verdicts, key="account_id", left_ts="ts", left_id="txn_id",
        right_ts="verdict_ts", right_id="event_id",
        right_cols=["event_id", "verdict_ts", "value"], segment_seconds=segment_seconds)


def holds(txns: DataFrame, verdicts: DataFrame, within_seconds: int,
          segment_seconds: int = 3600) -> DataFrame:
    """Transactions made within ``within_seconds`` after a high-risk verdict of their account.

    One row per transaction, naming the latest such verdict. If any verdict lies
    within the interval, so does the last one before the transaction, which
    turns the interval join into an as-of join and avoids listing all pairs.
    """
    wait = micros(F.col("ts")) - micros(F.col("verdict_ts"))
    return (
        asof_verdict(txns, verdicts, segment_seconds)
        .where(wait <= within_seconds * 1_000_000)
        .withColumn("reason", F.lit("high_risk_call"))
    )
