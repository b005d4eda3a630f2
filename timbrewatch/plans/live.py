"""From scored chunks to flagged, explained windows: the engine's main path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timbrewatch.config import RiskConfig
from timbrewatch.functions.hashing import digest
from timbrewatch.operators.audit import audit_record
from timbrewatch.operators.risk import verdicts
from timbrewatch.operators.windows import sliding
from timbrewatch.plans.segments import micros


def window_verdicts(chunks: DataFrame, cfg: RiskConfig, size: str, hop: str) -> DataFrame:
    """One verdict per call and sliding window; batch, or a watermarked stream."""
    windows = sliding(chunks, size, hop, [
        F.count("*").alias("n_chunks"), F.avg("spoof_prob").alias("spoof_prob"),
        F.avg("speaker_sim").alias("speaker_sim"), F.max("audio_hash").alias("last_hash")])
    return verdicts(windows, cfg)


def window_audit(window_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Audit entries of flagged windows. The id is a digest of call and window start."""
    named = (
        window_rows.withColumn("event_id", digest(F.col("call_id"), micros(F.col("window_start"))))
        .withColumnRenamed("last_hash", "audio_hash").withColumnRenamed("window_end", "event_ts"))
    return audit_record(named, meta)
