"""The live path: chunks to window verdicts, audit entries and transaction holds, on streams that never end.

A stream shows a window when the watermark has passed it, so the last ones wait for later
events. A heartbeat, a row without a call, moves the watermark and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timbrewatch.config import RiskConfig
from timbrewatch.functions.hashing import digest
from timbrewatch.operators.risk import verdicts
from timbrewatch.plans.live import window_audit
from timbrewatch.plans.segments import micros, time_segment
from timbrewatch.sources.audit_store import append_audit


def window_verdict_stream(chunks: DataFrame, cfg: RiskConfig, size: str, hop: str, watermark: str) -> DataFrame:
    """One verdict per call and closed window. ``window_ts`` (just before the end) carries the watermark on."""
    windows = chunks.withWatermark("event_ts", watermark).groupBy("call_id", F.window("event_ts", size, hop).alias("window")).agg(
        F.count("*").alias("n_chunks"), F.avg("spoof_prob").alias("spoof_prob"), F.avg("speaker_sim").alias("speaker_sim"),
        F.max("audio_hash").alias("last_hash"), F.count("call_id").alias("_called"))
    # A condition on an aggregate stays above it; one on the call would take heartbeats from the watermark.
    windows = windows.where("_called > 0").select(
        "call_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        F.window_time("window").alias("window_ts"), "n_chunks", "spoof_prob", "speaker_sim", "last_hash")
    return verdicts(windows, cfg)


def verdict_id() -> "F.Column":
    return digest(F.col("call_id"), micros(F.col("window_start")))


def holds_of_stream(window_rows: DataFrame, txns: DataFrame, within_seconds: int, watermark: str) -> DataFrame:
    """Transactions within the interval after a HIGH window of their account, with the latest such verdict.

    Three stateful steps in one query: the windows, their interval join with the transactions, and one
    row per transaction. Verdicts and transactions meet by (account, time slice), so a busy account spreads
    over slices, and a transaction meets the windows of one interval only.
    """
    high = window_rows.where("tier = 'HIGH'")
    # Keys name the event time: a join also asks for non-null keys, and a condition on the account alone would be
    # moved before the watermark, where it takes the heartbeats away.
    timely = lambda ts, key: F.when(F.col(ts).isNotNull(), F.col(key))
    own = time_segment("window_ts", within_seconds)
    v = high.select(timely("window_ts", "call_id").alias("_account"), "window_ts", F.struct(
        F.col("window_end").alias("verdict_ts"), verdict_id().alias("verdict_id"), F.round("risk_score", 9).alias("risk_score")).alias("_v"),
        F.explode(F.array(own, own + 1)).alias("_at"))
    # A window ends one microsecond after its time, so its slice is that of the end or the one before.
    t = txns.withWatermark("ts", watermark).withColumns({
        "_key": timely("ts", "account_id"), "_slice": time_segment(F.col("ts") - F.expr("interval 1 microsecond"), within_seconds)})
    limit = F.make_dt_interval(secs=F.lit(within_seconds)) + F.expr("interval '0.000001' second")
    pairs = t.join(v, (F.col("_key") == F.col("_account")) & (F.col("_slice") == F.col("_at"))
                   & (F.col("ts") > F.col("window_ts")) & (F.col("ts") <= F.col("window_ts") + limit))
    # One event time goes on: that of the transaction.
    return pairs.select("txn_id", "account_id", "ts", "amount", "_v").groupBy("txn_id", "account_id", "ts", "amount").agg(
        F.max("_v").alias("_v")).select("txn_id", "account_id", "ts", "amount", "_v.verdict_id", "_v.verdict_ts", "_v.risk_score",
                                        F.lit("high_risk_call").alias("reason"))


def verdict_sinks(path: str, meta: DataFrame, segment_seconds: int, writer: str = "live"):
    """Batch handler with two sinks: the verdict table, under the batch number, and the audit log."""

    def store(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/verdicts/batch_id={batch_id}"
        batch.drop("window_ts").write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.parquet(target)
        append_audit(window_audit(written, meta), f"{path}/audit", segment_seconds, writer=writer, batch_id=batch_id)

    return store
