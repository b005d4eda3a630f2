"""Streams equal their batch twins on what the watermark has closed; several micro-batches each."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows_of
from timbrewatch.catalog import fixtures as fx
from timbrewatch.operators import guard, risk, windows
from timbrewatch.schemas import EVENTS
from timbrewatch.session import scratch_dir, streaming_session
from timbrewatch.sources.chunks import dedup_chunks, read_chunks
from timbrewatch.streaming import guard as guard_stream, status, windows as window_stream
from timbrewatch.streaming.replay import each_batch, to_table

DAY = fx.DAY


@pytest.fixture(scope="module")
def sliced(spark):
    """The events as four files in time order, written one after another."""
    path = f"{scratch_dir(spark, 'sliced')}/events"
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    total = events.count()
    for i in range(4):
        part = events.where(F.col("event_id").between(i * total // 4, (i + 1) * total // 4 - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture()
def stream(spark, sliced):
    def chunks():
        source = read_chunks(streaming_session(spark), sliced, EVENTS, max_files=1)
        return fx.as_chunks(source, F.col("ts").cast("timestamp"))
    return chunks


@pytest.fixture(scope="module")
def batch(spark):
    return fx.chunks(spark, SF_DIR).withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def test_sliding(spark, stream, batch):
    aggs = [F.count("*").alias("n"), F.max("amplitude").alias("top")]
    got = to_table(window_stream.sliding_stream(stream(), "2 days", "1 day", aggs, "1 day"), "t", spark)
    want = windows.sliding(batch, "2 days", "1 day", aggs)
    columns = ("call_id", "window_start", "n", "top")
    closed = rows_of(got, *columns)
    assert closed and set(closed) <= set(rows_of(want, *columns))
    last = max(r[1] for r in closed)
    assert closed == [r for r in rows_of(want, *columns) if r[1] <= last]


def test_dedup_across_batches(spark, stream, batch):
    twice = stream().withColumn("ingest_ts", F.col("event_ts"))
    twice = twice.unionByName(twice)
    got = to_table(dedup_chunks(twice, watermark="1 day"), "t", spark)
    assert rows_of(got, "call_id", "seq") == rows_of(batch, "call_id", "seq")


def test_holds_across_batches(spark, sliced):
    session = streaming_session(spark)
    source = [read_chunks(session, sliced, EVENTS, max_files=1).withColumn("ts", F.col("ts").cast("timestamp"))
              for _ in range(2)]
    got = to_table(guard_stream.holds_stream(fx.txns(source[0]), fx.flags(source[1]), DAY, "1 hour", "1 hour"), "t", spark)
    rows = spark.read.parquet(sliced).withColumn("ts", F.col("ts").cast("timestamp"))
    want = guard.holds(fx.txns(rows), fx.flags(rows), DAY, DAY)
    assert got.count() > 0 and rows_of(got, "txn_id") == rows_of(want, "txn_id")


def test_transitions_across_batches(spark, stream, batch):
    folder = scratch_dir(spark, "t")
    status.run_transitions(fx.chunk_verdicts(stream()), f"{folder}/edges", f"{folder}/c", "1 day", "1 hour",
                           "event_ts", "event_id", DAY)
    edges = spark.read.parquet(f"{folder}/edges")
    assert edges.select("batch_id").distinct().count() > 1
    columns = ("call_id", "event_id", "from_tier", "to_tier")
    last = edges.agg(F.max("event_id")).first()[0]
    want = risk.transitions(fx.chunk_verdicts(batch), "event_ts", "event_id", DAY).where(F.col("event_id") <= last)
    assert rows_of(edges, *columns) == rows_of(want, *columns)


def test_status_across_batches(spark, stream, batch):
    folder = scratch_dir(spark, "t")
    updates = status.status_updates(fx.chunk_verdicts(stream()), "event_ts", "event_id")
    each_batch(updates, status.status_sink(f"{folder}/s"), f"{folder}/c", "update")
    got = status.read_status(spark, f"{folder}/s")
    want = risk.call_status(fx.chunk_verdicts(batch), "event_ts", "event_id")
    assert rows_of(got, "call_id", "event_ts", "tier") == rows_of(want, "call_id", "event_ts", "tier")


def test_callers_session_is_left_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    streaming_session(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
