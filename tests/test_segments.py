"""Segmented computations equal the plain windows they replace."""

import pytest
from pyspark.sql import Window, functions as F

from tests.conftest import rows_of
from timbrewatch.plans.asof import asof_join
from timbrewatch.plans.segments import (
    Segments, adjacent_struct, lag_struct, last_known, number_runs, position, running_sum, time_segment,
)


def plain():
    return Window.partitionBy("call_id").orderBy("event_ts", "seq")


def upto():
    return plain().rowsBetween(Window.unboundedPreceding, 0)


def spec(seconds):
    return Segments(["call_id"], ["event_ts", "seq"], time_segment("event_ts", seconds))


@pytest.mark.parametrize("seconds", [1, 30, 100_000])
def test_lag(skewed, seconds):
    got = lag_struct(skewed, spec(seconds), ["v"], "p").withColumn("p", F.col("p.v"))
    want = skewed.withColumn("p", F.lag("v").over(plain()))
    assert rows_of(got, "seq", "p") == rows_of(want, "seq", "p")


@pytest.mark.parametrize("seconds", [1, 30, 100_000])
def test_running_sum_and_position(skewed, seconds):
    got = position(running_sum(skewed, spec(seconds), F.col("v"), "total"), spec(seconds), "n")
    want = skewed.withColumn("total", F.sum("v").over(upto())).withColumn("n", F.row_number().over(plain()))
    assert rows_of(got, "seq", "total", "n") == rows_of(want, "seq", "total", "n")


@pytest.mark.parametrize("seconds", [1, 30, 100_000])
def test_last_known(skewed, seconds):
    got = last_known(skewed, spec(seconds), "known", "k")
    want = skewed.withColumn("k", F.last("known", ignorenulls=True).over(upto()))
    assert rows_of(got, "seq", "k") == rows_of(want, "seq", "k")


@pytest.mark.parametrize("seconds", [1, 30, 100_000])
def test_number_runs(skewed, seconds):
    flagged = skewed.withColumn("low", F.col("v") < 4)
    got = number_runs(flagged, spec(seconds), ["low"], F.col("low") != F.col("_prev.low"), "run")
    opens = F.coalesce(F.col("low") != F.lag("low").over(plain()), F.lit(True)).cast("bigint")
    want = flagged.withColumn("o", opens).withColumn("run", F.sum("o").over(upto()))
    assert rows_of(got, "seq", "run") == rows_of(want, "seq", "run")


@pytest.mark.parametrize("width", [1, 7, 5000])
def test_adjacent(spark, width):
    numbered = spark.range(200).where("id % 13 <> 5").select(
        (F.col("id") % 2).alias("call_id"), F.floor(F.col("id") / 2).alias("n"), F.col("id").alias("v"))
    got = adjacent_struct(numbered, ["call_id"], "n", width, ["v"], "p").withColumn("p", F.col("p.v"))
    other = numbered.select("call_id", (F.col("n") + 1).alias("n"), F.col("v").alias("p"))
    want = numbered.join(other, ["call_id", "n"], "left")
    assert rows_of(got, "call_id", "n", "p") == rows_of(want, "call_id", "n", "p")


def test_asof_takes_the_equal_time_and_keeps_unmatched(spark):
    left = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:10', 'a'),"
                     " (2, timestamp'2024-01-01 00:00:05', 'a'), (3, timestamp'2024-01-01', 'b') as t(id, ts, k)")
    right = spark.sql("select * from values (7, timestamp'2024-01-01 00:00:06', 'a', 'x'),"
                      " (8, timestamp'2024-01-01 00:00:10', 'a', 'y') as t(rid, rts, k, val)")
    got = asof_join(left, right, key="k", left_ts="ts", left_id="id", right_ts="rts", right_id="rid",
                    right_cols=["rid", "val"], segment_seconds=1)
    assert rows_of(got, "id", "rid", "val") == [(1, 8, "y"), (2, None, None), (3, None, None)]
