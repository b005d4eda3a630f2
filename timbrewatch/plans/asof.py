"""As-of join by union and carried last value: linear in both sides, no pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from timbrewatch.plans.segments import Segments, last_known, time_segment


def asof_join(left: DataFrame, right: DataFrame, *, key: str, left_ts: str, left_id: str,
              right_ts: str, right_id: str, right_cols: Sequence[str],
              segment_seconds: int) -> DataFrame:
    """Each left row with the last right row of its key at or before it.

    Both sides are stacked into one timeline and the last right row is carried
    forward; on equal times the right row comes first. Left rows without an
    earlier right row keep nulls.
    """
    payload = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(*[F.col(c) for c in right_cols])
    found_type = right.select(found.alias("f")).schema["f"].dataType
    left_type = left.select(payload.alias("p")).schema["p"].dataType
    if left.schema[left_id].dataType == right.schema[right_id].dataType:
        id_type = left.schema[left_id].dataType
    else:
        id_type = "string"
    timeline = (
        right.select(
            F.col(key).alias("_key"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
            F.col(right_id).cast(id_type).alias("_id"), found.alias("_found"),
            F.lit(None).cast(left_type).alias("_row"))
        .unionByName(left.select(
            F.col(key).alias("_key"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"),
            F.col(left_id).cast(id_type).alias("_id"), F.lit(None).cast(found_type).alias("_found"),
            payload.alias("_row")))
    )
    spec = Segments(["_key"], ["_ts", "_side", "_id"], time_segment("_ts", segment_seconds))
    seen = last_known(timeline, spec, "_found", "_seen").where(F.col("_row").isNotNull())
    return seen.select("_row.*", *[F.col("_seen")[c].alias(c) for c in right_cols])
