"""Ordered computations per key that never gather one key in one task.

``lag``, running totals and as-of lookups are usually written as a window
partitioned by the key, which sorts all rows of a key in a single task. A call
may hold a large share of the table, so here a key is cut into consecutive
segments. The window runs inside (key, segment); one summary row per segment is
carried to the following segments over the much smaller summary table and joined
back on (key, segment). The result equals the plain window exactly.

Rows are shuffled once, on (key, segment). Summaries are combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

SEG = "_segment"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for both timestamp types (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def time_segment(ts: str | Column, seconds: int) -> Column:
    """Index of the fixed-width time slice; rises with ``ts``."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(micros(col) / F.lit(seconds * 1_000_000)).cast("bigint")


def index_segment(position: str, width: int) -> Column:
    """Slice of a dense counter: at most ``width`` rows of one key per segment."""
    return F.floor(F.col(position) / F.lit(width)).cast("bigint")


@dataclass(frozen=True)
class Segments:
    """``keys`` must be non-null; ``segment`` must not fall as ``order`` rises.

    ``order`` must be unique within ``keys`` for a reproducible result.
    """

    keys: Sequence[str]
    order: Sequence[str]
    segment: Column

    def cut(self, df: DataFrame) -> DataFrame:
        """Rows dealt by (key, segment). Said outright: rows dealt by key alone, as after a join on it, would
        satisfy the windows too and leave a busy key in one task."""
        return df.withColumn(SEG, self.segment).repartition(*self.by)

    @property
    def by(self) -> list[str]:
        return [*self.keys, SEG]

    @property
    def local(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def position(self) -> Column:
        return F.struct(*self.order)

    @property
    def across(self):
        return Window.partitionBy(*self.keys).orderBy(SEG)


def lag_struct(df: DataFrame, spec: Segments, cols: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: struct of ``cols`` from the preceding row of the key, or null."""
    rows = spec.cut(df)
    item = F.struct(*cols)
    local = rows.withColumn("_near", F.lag(item).over(spec.local))
    carry = (
        rows.groupBy(*spec.by).agg(F.max_by(item, spec.position).alias("_tail"))
        .select(*spec.by, F.lag("_tail").over(spec.across).alias("_far"))
    )
    return (
        local.join(carry, spec.by, "left")
        .withColumn(name, F.coalesce("_near", "_far"))
        .drop("_near", "_far", SEG)
    )


def running_sum(df: DataFrame, spec: Segments, value: Column, name: str) -> DataFrame:
    """Add ``name``: inclusive running total of ``value`` within the key."""
    rows = spec.cut(df)
    near = F.sum(value).over(spec.local.rowsBetween(Window.unboundedPreceding, 0))
    local = rows.withColumn("_near", near)
    before = spec.across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*spec.by).agg(F.sum(value).alias("_total"))
        .select(*spec.by, F.sum("_total").over(before).alias("_far"))
    )
    return (
        local.join(carry, spec.by, "left")
        .withColumn(name, F.col("_near") + F.coalesce("_far", F.lit(0)))
        .drop("_near", "_far", SEG)
    )


def position(df: DataFrame, spec: Segments, name: str) -> DataFrame:
    """Add ``name``: the 1-based position within the key."""
    return running_sum(df, spec, F.lit(1).cast("bigint"), name)


def last_known(df: DataFrame, spec: Segments, value: str, name: str) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` at or before each row of the key."""
    rows = spec.cut(df)
    near = F.last(value, ignorenulls=True).over(
        spec.local.rowsBetween(Window.unboundedPreceding, 0))
    local = rows.withColumn("_near", near)
    before = spec.across.rowsBetween(Window.unboundedPreceding, -1)
    # max_by skips rows whose ordering is null, that is, rows without a value.
    ordering = F.when(F.col(value).isNotNull(), spec.position)
    carry = (
        rows.groupBy(*spec.by).agg(F.max_by(value, ordering).alias("_tail"))
        .select(*spec.by, F.last("_tail", ignorenulls=True).over(before).alias("_far"))
    )
    return (
        local.join(carry, spec.by, "left")
        .withColumn(name, F.coalesce("_near", "_far"))
        .drop("_near", "_far", SEG)
    )


def number_runs(df: DataFrame, spec: Segments, cols: Sequence[str], starts: Column,
                name: str) -> DataFrame:
    """Add ``name``: the number of the run each row belongs to, counted from 1 per key.

    ``starts`` says whether a row opens a new run; it may use ``cols`` and, as
    ``_prev``, the same columns of the row before. The first row of a key always
    opens one. Whether the first row of a segment opens a run is settled on the
    summaries, so rows are shuffled once.
    """
    rows = spec.cut(df)
    item = F.struct(*cols)
    inner = F.when(F.col("_prev").isNotNull(), starts.cast("bigint"))
    local = (
        rows.withColumn("_prev", F.lag(item).over(spec.local))
        .withColumn("_opens", F.coalesce(inner, F.lit(0)))
        .withColumn("_near", F.sum("_opens").over(spec.local.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_prev", "_opens")
    )
    before = spec.across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy(*spec.by).agg(
            F.max("_near").alias("_count"), F.min_by(item, spec.position).alias("_head"),
            F.max_by(item, spec.position).alias("_tail"))
        .withColumn("_prev", F.lag("_tail").over(spec.across))
        .select(*spec.by, "_count", "_prev", *[F.col("_head")[c].alias(c) for c in cols if c not in spec.by])
        .withColumn("_open", F.coalesce(starts, F.lit(True)).cast("bigint"))
        .withColumn("_base", F.col("_open") + F.coalesce(
            F.sum(F.col("_count") + F.col("_open")).over(before), F.lit(0)))
        .select(*spec.by, "_base")
    )
    return (
        local.join(carry, spec.by, "left")
        .withColumn(name, F.col("_near") + F.col("_base"))
        .drop("_near", "_base", SEG)
    )


def adjacent_struct(df: DataFrame, keys: Sequence[str], index: str, width: int,
                    cols: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: struct of ``cols`` from the row numbered one less, or null.

    For dense counters. The last row of each segment is also handed to the next
    segment as a neighbour, so one shuffle does it and the input is read once.
    """
    seg = index_segment(index, width)
    own = F.struct(seg.alias("at"), F.lit(False).alias("copy"))
    following = F.struct((seg + 1).alias("at"), F.lit(True).alias("copy"))
    is_last = F.pmod(F.col(index), F.lit(width)) == width - 1
    placed = (
        df.withColumn("_c", F.explode(F.when(is_last, F.array(own, following)).otherwise(F.array(own))))
        .withColumns({SEG: F.col("_c.at"), "_copy": F.col("_c.copy")}).drop("_c")
    )
    order = Window.partitionBy(*keys, SEG).orderBy(index)
    before = F.lag(F.struct(F.col(index).alias("_index"), *cols)).over(order)
    return (
        placed.withColumn("_before", before).where(~F.col("_copy"))
        .withColumn(name, F.when(F.col("_before._index") == F.col(index) - 1, F.col("_before")))
        .drop("_before", "_copy", SEG)
    )
