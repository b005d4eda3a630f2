"""Quantiles of delays from sketches kept per day and merged when read.

A delay falls into a cell whose bounds grow by a fixed ratio, so a cell's middle
is within ``accuracy`` of every delay in it, and cells of different days, batches
and machines add up. Quantiles are then found among the cells, of which there
are about ``ln(largest) / (2 * accuracy)`` however many delays were counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ACCURACY = 0.01
SKETCH = "cell int, n bigint, total bigint, batch bigint, day date"


def ratio_of(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def cell_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """Cell of a whole number: 0 for zero, ``k`` for (r^(k-2), r^(k-1)], negative numbers mirrored; null for null."""
    size = F.ceil(F.log(F.abs(value).cast("double")) / math.log(ratio_of(accuracy))) + 1
    return F.when(value == 0, 0).otherwise(F.signum(value) * size).cast("int")


def middle_of(cell: Column, accuracy: float = ACCURACY) -> Column:
    """The number within ``accuracy`` of all numbers of a cell."""
    r = ratio_of(accuracy)
    return F.when(cell == 0, 0.0).otherwise(F.signum(cell) * F.pow(F.lit(r), F.abs(cell) - 1) * (2 / (1 + r)))


def sketch(rows: DataFrame, value: Column, *by: str, accuracy: float = ACCURACY) -> DataFrame:
    """``*by, cell, n, total``; counted map-side, so the shuffle holds cells. Null values are left out."""
    return (
        rows.select(*by, value.cast("bigint").alias("_v")).where(F.col("_v").isNotNull())
        .groupBy(*by, cell_of(F.col("_v"), accuracy).alias("cell"))
        .agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    )


def merge(cells: DataFrame, *by: str) -> DataFrame:
    """The sketch of the union of what ``cells`` were made of."""
    return cells.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def quantiles(cells: DataFrame, ps: Sequence[float], *by: str, accuracy: float = ACCURACY) -> DataFrame:
    """``*by, n, mean`` and ``p50`` etc. per group of a merged sketch.

    ``p`` names the value of rank ``ceil(p * n)``, at least 1; the result is
    within ``accuracy`` of it, relatively. Only the cells of a group, bounded in
    number, meet in one row. Without ``by`` an empty sketch gives one row of
    nulls, with it none.
    """
    sorted_cells = F.array_sort(F.collect_list(F.struct("cell", "n")))
    start = F.expr("named_struct('upto', 0L, 'steps', CAST(array() AS array<struct<cell:int,upto:bigint>>))")

    def step(acc: Column, c: Column) -> Column:
        upto = acc["upto"] + c["n"]
        return F.struct(upto.alias("upto"), F.concat(
            acc["steps"], F.array(F.struct(c["cell"].alias("cell"), upto.alias("upto")))).alias("steps"))

    grouped = cells.groupBy(*by).agg(sorted_cells.alias("_cells"), F.sum("n").alias("n"), F.sum("total").alias("_total"))
    steps = grouped.withColumn("_steps", F.aggregate("_cells", start, step)["steps"])

    def at(p: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p)))
        return middle_of(F.get(F.filter("_steps", lambda s: s["upto"] >= rank), F.lit(0))["cell"], accuracy)

    return steps.select(*by, "n", (F.col("_total") / F.col("n")).alias("mean"),
                        *[at(p).alias(f"p{p * 100:g}".replace(".", "_")) for p in ps])


def store(path: str, value: Column, day: Column, accuracy: float = ACCURACY) -> Callable[[DataFrame, int], None]:
    """A function (rows, batch number) that keeps the batch's sketch per day below ``path``; also a ``foreachBatch`` sink.

    A batch has a folder of its own, so a repeated batch replaces itself.
    ``path`` must be reachable from all executors.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        sketch(rows.withColumn("day", day), value, "day", accuracy=accuracy).write.mode("overwrite").partitionBy(
            "day").parquet(f"{path.rstrip('/')}/batch={batch}")

    return keep


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored sketches; a filter on ``day`` leaves other days unread."""
    return spark.read.schema(SKETCH).option("basePath", path).parquet(path)
