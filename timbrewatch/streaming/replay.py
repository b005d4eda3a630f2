"""Run a streaming query over what is available and hand back a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from timbrewatch.session import scratch_dir


def finish(writer, timeout_seconds: int | None = None) -> None:
    """Process what is available; only a caller's own time limit stops a replay."""
    query = writer.trigger(availableNow=True).start()
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError("the replay did not end in time")


def to_table(stream: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Append-mode output as Parquet in the shared scratch folder."""
    folder = scratch_dir(stream.sparkSession, name)
    finish(stream.writeStream.outputMode("append").format("parquet")
           .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table"))
    return (reader or stream.sparkSession).read.schema(StructType(list(stream.schema))).parquet(f"{folder}/table")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append") -> None:
    finish(stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint))
