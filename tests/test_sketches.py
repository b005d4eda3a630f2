"""Quantiles of merged sketches against sorted values."""

import math

import pytest
from pyspark.sql import functions as F

from timbrewatch.operators import sketches
from timbrewatch.session import scratch_dir

PS = (0.0, 0.01, 0.5, 0.95, 0.999, 1.0)


def exact(values, p):
    return sorted(values)[max(1, math.ceil(p * len(values))) - 1]


@pytest.mark.parametrize("accuracy", [0.01, 0.05])
def test_error_bound(spark, accuracy):
    """A third of the rows in one group; heavy tails, zeros and negative delays; merged from pieces of any order."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 50 == 0, 0).when(F.col("id") % 41 == 0, -F.col("id")).otherwise(
            F.floor(F.exp(F.pmod(F.xxhash64("id"), F.lit(2_000_000)) / 100_000.0))).cast("bigint").alias("v"),
        (F.col("id") % 5).alias("piece"))
    parts = sketches.sketch(rows, F.col("v"), "g", "piece", accuracy=accuracy)
    got = sketches.quantiles(sketches.merge(parts, "g"), PS, "g", accuracy=accuracy).collect()
    values = {}
    for r in rows.collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert {r["g"]: r["n"] for r in got} == {g: len(v) for g, v in values.items()}
    for r in got:
        assert r["mean"] == pytest.approx(sum(values[r["g"]]) / r["n"])
        for p in PS:
            want = exact(values[r["g"]], p)
            assert abs(r[f"p{p * 100:g}".replace(".", "_")] - want) <= abs(want) * accuracy * (1 + 1e-9)


def test_cells_stay_few(spark):
    rows = spark.range(200_000).select((F.col("id") * 977).alias("v"))
    assert sketches.sketch(rows, F.col("v")).count() < 1000


def test_repeated_batches_and_pruned_days(spark):
    path = scratch_dir(spark, "sketch")
    rows = spark.range(100).select(F.col("id").alias("v"), F.timestamp_seconds(F.col("id") * 20_000).alias("ts"))
    keep = sketches.store(path, F.col("v"), F.to_date("ts"))
    for batch in (0, 1, 1, 0):
        keep(rows.where(F.col("v") % 2 == batch), batch)
    stored = sketches.read(spark, path)
    assert sketches.quantiles(sketches.merge(stored), [0.5]).first()["n"] == 100
    day = stored.where("day = date'1970-01-03'")
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    assert sketches.quantiles(sketches.merge(day), [1.0]).first()["p100"] == pytest.approx(12, rel=0.01)


def test_empty_and_null(spark):
    none = spark.sql("select cast(null as bigint) as v, 'a' as g")
    assert sketches.quantiles(sketches.sketch(none, F.col("v"), "g"), [0.5], "g").count() == 0
    assert sketches.quantiles(sketches.sketch(none, F.col("v")), [0.5]).first()["p50"] is None
