"""Automatic audit entries for flagged verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from timbrewatch.sources.audit_store import append_audit


def audit_sink(path: str, segment_seconds: int = 3600, max_call_days: int | None = None, writer: str = "stream"):
    """Batch handler that chains and appends a micro-batch of audit entries.

    Late entries join the end of their call's chain: chain order is arrival
    order, stored as ``seq``. ``writer`` names the streaming query: each has its own
    batch numbers, counted from its checkpoint.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        append_audit(batch, path, segment_seconds, max_call_days, writer, batch_id)

    return store
