"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from timbrewatch.catalog.queries import QUERIES
from timbrewatch.operators import audit, identity

BATCH = [n for n in QUERIES if "stream" not in n and not n.endswith("_live") and n not in (
    "audit_append", "latency_sketches", "audio_clip_scan", "pcm_unpack", "clip_ranges", "audit_verify", "anomaly_cells", "heatmap_grid", "suspicious_topk")]
# Windows over keys whose groups are bounded by construction, or over summaries of segments.
BOUNDED = re.compile(r"_segment|_block|window_no|vec_id")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_row_windows_over_a_whole_call(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        found = re.search(r"windowspecdefinition\(([^()]*)", line)
        if found and not name.startswith("roc"):
            assert BOUNDED.search(found.group(1)), line


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(QUERIES["txn_hold"](spark, SF_DIR))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(event_type,error)" in plan and "GreaterThanOrEqual(value,100.0)" in plan
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert scans and all("props" not in s for s in scans)


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("sliding_window_agg", "call_status", "enroll_voiceprint", "call_spoof_rollup", "latency_report"):
        assert "partial_" in plan_of(QUERIES[name](spark, SF_DIR))


def test_audit_log_is_pruned_by_day(spark, tmp_path):
    rows = spark.range(10).select(
        F.col("id").alias("event_id"), F.lit("d").alias("caller_did"), F.lit("HIGH").alias("tier"),
        F.timestamp_seconds(F.col("id") * 86_400).alias("event_ts"))
    rows.withColumn("event_date", F.to_date("event_ts")).write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    from datetime import datetime
    page = audit.audit_query(spark.read.parquet(str(tmp_path / "log")), 5, since=datetime(1970, 1, 3), until=datetime(1970, 1, 5))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date[^\]]*>= 1970-01-03", plan_of(page))
    assert sorted(r["event_id"] for r in page.collect()) == [2, 3]


def test_hot_identity_is_split_by_adaptive_execution(spark):
    """A third of the probes claim one identity; its partition is read by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        vec = F.array(*[F.rand(i) for i in range(8)])
        probes = spark.range(0, 30_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("d"), F.col("id") % 500)).alias("claimed_did"), vec.alias("embedding"))
        prints = spark.range(500).select(F.concat(F.lit("d"), "id").alias("did"), vec.alias("embedding")).unionByName(
            spark.range(1).select(F.lit("hot").alias("did"), vec.alias("embedding")))
        checked = identity.verify(probes, prints, 0.5)
        assert len(checked.collect()) == 30_000
        assert "skew=true" in plan_of(checked)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_call_is_dealt_by_segment_even_after_a_join_on_the_call(spark, skewed):
    """Without broadcasts the rows come hashed by call; the windows must not settle for that."""
    from timbrewatch.plans.segments import Segments, lag_struct, time_segment

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        meta = skewed.groupBy("call_id").agg(F.count("*").alias("n"))
        spec = Segments(["call_id"], ["event_ts", "seq"], time_segment("event_ts", 60))
        rows = lag_struct(skewed.join(meta, "call_id"), spec, ["v"], "_prev")
        plan = plan_of(rows)
        assert re.search(r"Exchange hashpartitioning\(call_id#\d+L, _segment#\d+L", plan)
        largest = spec.cut(skewed.join(meta, "call_id")).groupBy("call_id", "_segment").count().agg(F.max("count")).first()[0]
        assert largest <= 100
        want = lag_struct(skewed, spec, ["v"], "_prev")
        key = lambda df: sorted((r.seq, r._prev and r._prev.v) for r in df.collect())
        assert key(rows) == key(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
