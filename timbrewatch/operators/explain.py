"""Which time-frequency cells look anomalous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F


def baseline(mel: DataFrame) -> DataFrame:
    """Mean and sample deviation of every mel band: one row of two arrays.

    One mergeable aggregate over whole arrays; cells are not exploded for it.
    """
    stats = Summarizer.metrics("mean", "std").summary(array_to_vector("mel_db"))
    return mel.select(stats.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("sd"))


def cells(mel: DataFrame, base: DataFrame) -> DataFrame:
    """``db`` and ``z`` of each cell against its band's baseline.

    ``mel`` should hold flagged windows only: this is the one operator that
    turns arrays into cells. The baseline is a single row whose width is the
    number of bands.
    """
    # An uncorrelated scalar subquery: evaluated once, shipped as one value.
    stat = base.select(F.struct("mean", "sd").alias("s")).scalar()
    kept = [c for c in mel.columns if c != "mel_db"]
    exploded = mel.select(*kept, F.posexplode("mel_db").alias("mel_bin", "db"))
    mean, sd = F.get(stat["mean"], F.col("mel_bin")), F.get(stat["sd"], F.col("mel_bin"))
    return exploded.withColumn("z", (F.col("db") - mean) / F.nullif(sd, F.lit(0.0)))


def heatmap(cell_rows: DataFrame, bands: Sequence[int], fill: float = 0.0) -> DataFrame:
    """Frames by bands, with cells that are absent filled.

    The band list is given, so no pass over the data is spent on finding it.
    """
    grid = cell_rows.groupBy("call_id", "frame_no").pivot("mel_bin", list(bands)).agg(F.max("z"))
    return grid.select("call_id", "frame_no", *[
        F.coalesce(F.col(f"`{b}`"), F.lit(fill)).alias(f"band_{b}") for b in bands])


def suspicious(cell_rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k cells with the largest absolute z per call and window.

    Spark keeps k rows per group before the shuffle and again after it.
    """
    order = Window.partitionBy("call_id", *by).orderBy(F.desc(F.abs("z")), "frame_no", "mel_bin")
    return (
        cell_rows.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
    )
