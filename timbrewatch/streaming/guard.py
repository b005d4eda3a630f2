"""Transaction holds on two live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timbrewatch.plans.segments import time_segment


def holds_stream(txns: DataFrame, verdicts: DataFrame, within_seconds: int, txn_delay: str,
                 verdict_delay: str) -> DataFrame:
    """Transactions with a high-risk verdict of their account in the preceding interval.

    A semi join: each transaction comes out once, as soon as one verdict is
    known, however many there are. Time slices of the interval's width are part
    of the key, with every verdict present in its own and the next slice; a busy
    account thus spreads over slices and a match looks at two slices only.
    """
    t = (
        txns.withWatermark("ts", txn_delay)
        .withColumn("_slice", time_segment("ts", within_seconds))
    )
    own = time_segment("verdict_ts", within_seconds)
    v = (
        verdicts.select(F.col("account_id").alias("_account"), F.col("verdict_ts"))
        .withWatermark("verdict_ts", verdict_delay)
        .withColumn("_at", F.explode(F.array(own, own + 1)))
    )
    interval = F.make_dt_interval(secs=F.lit(within_seconds))
    return t.join(
        v,
        (F.col("account_id") == F.col("_account")) & (F.col("_slice") == F.col("_at"))
        & (F.col("ts") >= F.col("verdict_ts")) & (F.col("ts") <= F.col("verdict_ts") + interval),
        "left_semi",
    ).drop("_slice")
