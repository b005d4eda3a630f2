"""Keyed state per call, kept between batches and given up after silence.

A call's rows of a batch come to its processor one by one, as plain rows: a frame per call would
cost more than its rows. State per call is the
last verdict, and for tier changes the verdicts that the watermark has not passed
yet; an event-time timer removes it once the call has been silent for ``idle``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timbrewatch.plans.segments import micros


def _when(row) -> tuple:
    """Order of a call's verdicts: by time, then by tie, null first."""
    return (row[0], row[1] is not None, row[1])


class TierChanges(StatefulProcessor):
    """Emits a verdict whose tier differs from the one before it, in time order."""

    def __init__(self, tie_type: str, columns: list[str], idle_ms: int) -> None:
        self.tie_type, self.row, self.idle_ms = tie_type, Row(*columns), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"us bigint, tie {self.tie_type}, tier string")
        self.last = handle.getValueState("last", "us bigint, tier string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r.us, r.tie, r.tier) for r in rows]
        self.pending.appendList(fresh)
        self.handle.registerTimer(-(-min(r[0] for r in fresh) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.pending.get(), key=_when)
        closed = [r for r in waiting if r[0] <= passed]
        rest = waiting[len(closed):]
        before = self.last.get()
        out = []
        for us, tie, tier in closed:
            if before is None or before[1] != tier:
                out.append(self.row(*key, us, tie, before and before[1], tier))
            before = (us, tier)
        if closed:
            self.last.update(before)
            self.pending.clear()
            if rest:
                self.pending.put(rest)
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif before is not None:
            silent = before[0] // 1000 + self.idle_ms
            if silent * 1000 <= passed:
                self.last.clear()
            else:
                self.handle.registerTimer(silent)
        return iter(out)

    def close(self) -> None:
        pass


class LatestVerdict(StatefulProcessor):
    """Emits a call's latest verdict whenever a batch brings a later one."""

    def __init__(self, schema: str, columns: list[str], idle_ms: int) -> None:
        self.schema, self.row, self.idle_ms = schema, Row(*columns), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.latest.get()
        fresh = max(((r.us, r.tie, r.risk_score, r.tier, r.action) for r in rows), key=_when)
        if before is not None and _when(fresh) <= _when(before):
            return iter([])
        self.latest.update(fresh)
        if before is None:  # a call with state has a timer, which follows its latest verdict
            self.handle.registerTimer(fresh[0] // 1000 + self.idle_ms)
        return iter([self.row(*key, *fresh)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        latest = self.latest.get()
        if latest is not None:
            silent = latest[0] // 1000 + self.idle_ms
            if silent <= timerValues.getCurrentWatermarkInMs():
                self.latest.clear()
            else:
                self.handle.registerTimer(silent)
        return iter([])

    def close(self) -> None:
        pass


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _keyed(verdicts: DataFrame, ts: str, tie: str, watermark: str) -> DataFrame:
    """Event time as microseconds beside the columns; rows that only move the watermark are left out."""
    rows = verdicts.withWatermark(ts, watermark).withColumns({"us": micros(F.col(ts)), "tie": F.col(tie)})
    # One condition that names the event time: it cannot be split and moved before the watermark.
    return rows.where(F.when(F.col(ts).isNotNull(), F.col("call_id").isNotNull()))


def tier_changes(verdicts: DataFrame, ts: str, tie: str, watermark: str, idle_seconds: int) -> DataFrame:
    """Stream of tier changes: call_id, ts, tie, from_tier, to_tier, each once and in time order.

    Equal to `risk.transitions` as far as the watermark has come, except that a call
    silent for ``idle_seconds`` starts anew. A null tier is a tier of its own. Verdicts later than the
    watermark are left out.
    """
    call, kind = _kind(verdicts, "call_id"), _kind(verdicts, tie)
    rows = _keyed(verdicts, ts, tie, watermark).select("call_id", ts, "us", "tie", "tier")
    columns = ["call_id", "us", "tie", "from_tier", "to_tier"]
    out = rows.groupBy("call_id").transformWithState(
        TierChanges(kind, columns, idle_seconds * 1000), f"call_id {call}, us bigint, tie {kind}, from_tier string, to_tier string",
        "append", "eventtime")
    return out.select("call_id", F.timestamp_micros("us").alias(ts), F.col("tie").alias(tie), "from_tier", "to_tier")


def latest_verdicts(verdicts: DataFrame, ts: str, tie: str, watermark: str, idle_seconds: int) -> DataFrame:
    """Stream of status updates: call_id, ts, tie, risk_score, tier, action, one per call and batch that brings a later verdict."""
    call, kind = _kind(verdicts, "call_id"), _kind(verdicts, tie)
    rows = _keyed(verdicts, ts, tie, watermark).select("call_id", ts, "us", "tie", "risk_score", "tier", "action")
    state = f"us bigint, tie {kind}, risk_score double, tier string, action string"
    out = rows.groupBy("call_id").transformWithState(
        LatestVerdict(state, ["call_id", "us", "tie", "risk_score", "tier", "action"], idle_seconds * 1000),
        f"call_id {call}, {state}", "update", "eventtime")
    return out.select("call_id", F.timestamp_micros("us").alias(ts), F.col("tie").alias(tie), "risk_score", "tier", "action")
