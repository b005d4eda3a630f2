"""Live streams with several batches: state that ends, ties, nulls, late rows and the latest verdict."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, functions as F

from timbrewatch.operators import guard
from timbrewatch.session import scratch_dir, streaming_session
from timbrewatch.streaming import calls, live

START = datetime(2024, 1, 1)
VERDICT = "call_id string, event_ts timestamp, event_id long, tier string, risk_score double, action string"


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture()
def feed(spark):
    """A folder that batches of rows arrive in, and a runner that processes what is there."""
    folder = scratch_dir(spark, "feed")
    progress = []

    def send(schema, rows, build, mode="append"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streaming_session(spark).readStream.schema(schema).parquet(f"{folder}/in")
        out = build(stream)

        def store(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

        query = out.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress[:] = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
        return spark.read.schema(out.schema).parquet(f"{folder}/out")

    send.state = lambda: sum(op["numRowsTotal"] for op in progress[-1])
    return send


def verdict(call, minute, event, tier):
    return (call, at(minute), event, tier, 0.5, "a")


def test_tier_changes_across_batches(feed):
    build = lambda s: calls.tier_changes(s, "event_ts", "event_id", "5 minutes", 3600)
    feed(VERDICT, [verdict("a", 0, 1, "LOW"), verdict("a", 3, 3, "HIGH"), verdict("a", 3, 2, "LOW"), verdict("b", 1, 4, None)], build)
    feed(VERDICT, [verdict("a", 1, 5, None), verdict("a", 8, 6, "HIGH"), verdict("b", 9, 7, None), verdict("b", 10, 8, "LOW")], build)
    feed(VERDICT, [verdict("a", 30, 9, "LOW"), verdict("a", 2, 10, "MEDIUM")], build)  # the last one is too late
    busy = feed.state()
    out = feed(VERDICT, [verdict(None, 500, None, None)], build)
    out = feed(VERDICT, [verdict(None, 600, None, None)], build)
    got = [(r.call_id, r.event_id, r.from_tier, r.to_tier) for r in out.orderBy("call_id", "event_ts", "event_id").collect()]
    assert got == [("a", 1, None, "LOW"), ("a", 5, "LOW", None), ("a", 2, None, "LOW"), ("a", 3, "LOW", "HIGH"), ("a", 9, "HIGH", "LOW"),
                   ("b", 4, None, None), ("b", 8, None, "LOW")]
    assert busy > 0 and feed.state() == 0  # silent calls are forgotten


def test_status_updates_and_expiry(feed):
    build = lambda s: calls.latest_verdicts(s, "event_ts", "event_id", "5 minutes", 600)
    feed(VERDICT, [verdict("a", 0, 1, "LOW"), verdict("a", 2, 3, "HIGH"), verdict("a", 2, 2, "LOW"), verdict("b", 1, 4, None)], build, "update")
    feed(VERDICT, [verdict("a", 1, 5, "LOW"), verdict("b", 4, 6, "MEDIUM")], build, "update")
    feed(VERDICT, [verdict(None, 500, None, None)], build, "update")
    out = feed(VERDICT, [verdict(None, 600, None, None)], build, "update")
    got = sorted((r.call_id, r.event_id, r.tier) for r in out.collect())
    assert got == [("a", 3, "HIGH"), ("b", 4, None), ("b", 6, "MEDIUM")] and feed.state() == 0


def test_holds_name_the_latest_verdict(spark, feed):
    schema = "call_id long, ts timestamp, risk double, txn_id long"
    windows = lambda s: s.withWatermark("ts", "1 minute").groupBy("call_id", F.window("ts", "4 minutes", "2 minutes").alias("window")).agg(
        F.max("risk").alias("risk_score"), F.count("call_id").alias("n")).where("n > 0").select(
        "call_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.window_time("window").alias("window_ts"),
        "risk_score", F.when(F.col("risk_score") >= 0.7, "HIGH").otherwise("LOW").alias("tier"))

    def build(s):
        txns = s.select("txn_id", F.col("call_id").alias("account_id"), "ts", F.lit(1.0).alias("amount"))
        return live.holds_of_stream(windows(s), txns, 300, "1 minute")

    rows = [(k % 3, at(k * 0.75), ((k * 37) % 100) / 100, k) for k in range(120)]
    for part in (rows[:50], rows[50:90], rows[90:], *([(None, at(5000 * k), None, None)] for k in (1, 2, 3))):
        out = feed(schema, part, build)
    batch = spark.createDataFrame(rows, schema)
    high = batch.groupBy("call_id", F.window("ts", "4 minutes", "2 minutes").alias("w")).agg(F.max("risk").alias("value")).where("value >= 0.7").select(
        F.col("call_id").alias("account_id"), F.col("w.end").alias("verdict_ts"), F.lit(1).alias("event_id"), "value")
    want = guard.holds(batch.select("txn_id", F.col("call_id").alias("account_id"), "ts"), high, 300, 60)
    key = lambda df: sorted((r.txn_id, r.verdict_ts) for r in df.collect())
    assert key(out) == key(want) and out.count() > 20


class Kept:
    """A state variable of one call, for calling a processor by hand; counts what is asked of it."""

    def __init__(self):
        self.value, self.requests = None, 0

    def __getattr__(self, name):
        def ask(*args):
            self.requests += 1
            if name in ("update", "appendList", "put"):
                self.value = [*(self.value or []), *args[0]] if name == "appendList" else args[0]
            elif name == "clear":
                self.value = None
            return self.value is not None if name == "exists" else self.value if name == "get" else None
        return ask


class Handle:
    def __init__(self):
        self.kept, self.timers = Kept(), []

    def getValueState(self, *_):
        return self.kept

    def registerTimer(self, at_ms):
        self.timers.append(at_ms)


def test_status_costs_a_call_few_requests():
    """A call's rows of a batch come as plain rows and cost one read, at most one write, and a timer only when the call is new."""
    columns = ["call_id", "us", "tie", "risk_score", "tier", "action"]
    row, handle = Row(*columns), Handle()
    processor = calls.LatestVerdict("us bigint, tie bigint, risk_score double, tier string, action string", columns, 600_000)
    processor.init(handle)

    def batch(*verdicts):
        handle.kept.requests = 0
        return [tuple(r) for r in processor.handleInputRows(("a",), (row("a", m * 60_000_000, tie, 0.5, tier, None) for m, tie, tier in verdicts), None)]

    assert batch((1, None, "LOW"), (2, None, "LOW"), (2, 7, "HIGH"), (2, None, "LOW")) == [("a", 120_000_000, 7, 0.5, "HIGH", None)]
    assert handle.kept.requests == 2 and handle.timers == [720_000]
    assert batch((2, 6, "LOW"), (2, 7, "LOW"), (1, 9, "LOW")) == [] and handle.kept.requests == 1
    assert batch((5, 2 ** 53 + 1, None)) == [("a", 300_000_000, 2 ** 53 + 1, 0.5, None, None)] and handle.kept.requests == 2
    assert handle.timers == [720_000]
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.now})()
    for clock.now, timers in ((720_000, [720_000, 900_000]), (900_000, [720_000, 900_000])):
        assert list(processor.handleExpiredTimer(("a",), clock, None)) == [] and handle.timers == timers
    assert handle.kept.value is None  # the first timer asked for a later one, which ended the state


def test_status_keeps_nulls_and_large_numbers(feed):
    build = lambda s: calls.latest_verdicts(s, "event_ts", "event_id", "5 minutes", 600)
    big = 2 ** 53 + 1
    feed(VERDICT, [verdict("a", 2, None, "LOW"), verdict("a", 2, big, "HIGH"), ("b", at(1), None, None, None, None)], build, "update")
    out = feed(VERDICT, [verdict("a", 2, None, "LOW"), verdict("b", 1, 4, "LOW")], build, "update")
    assert sorted(((r.call_id, r.event_id, r.risk_score, r.tier, r.action) for r in out.collect()), key=repr) == [
        ("a", big, 0.5, "HIGH", "a"), ("b", 4, 0.5, "LOW", "a"), ("b", None, None, None, None)]
