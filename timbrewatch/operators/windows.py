"""Framing, sliding windows and chunk-sequence checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.plans.segments import Segments, lag_struct, time_segment


def frames(df: DataFrame, length: int, hop: int, samples: str = "samples") -> DataFrame:
    """Cut each sample array into full frames of ``length`` every ``hop`` samples.

    Map-only. Arrays shorter than a frame give no row.
    """
    x = F.col(samples)
    starts = F.when(
        F.size(x) >= length, F.sequence(F.lit(0), F.size(x) - F.lit(length), F.lit(hop)))
    cuts = F.transform(starts, lambda i: F.struct(
        i.alias("offset"), F.slice(x, i + 1, length).alias("samples")))
    kept = [c for c in df.columns if c != samples]
    return (
        df.select(*kept, F.posexplode(cuts).alias("sub_frame", "_cut"))
        .select(*kept, "sub_frame", "_cut.offset", F.col("_cut.samples").alias(samples))
    )


def sliding(df: DataFrame, size: str, hop: str, aggs: Sequence[Column],
            keys: Sequence[str] = ("call_id",), ts: str = "event_ts") -> DataFrame:
    """Aggregate per key and sliding window, for batch and watermarked streams alike.

    The shuffle key includes the window, so one long call spreads over its
    windows, and rows are combined before the shuffle.
    """
    return (
        df.groupBy(*keys, F.window(ts, size, hop).alias("window"))
        .agg(*aggs)
        .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
        .drop("window")
    )


def _floor_div(x: Column, y: Column | int) -> Column:
    """Exact floor of a quotient of bigints; a double would lose present-day sample clocks."""
    y = y if isinstance(y, Column) else F.lit(y)
    return F.call_function("div", x - F.pmod(x, y), y)


def _trimmed(pieces: Column, first: Column) -> Column:
    """``struct<at, whole, skips>``: end of the sorted pieces, whether they join up, samples to skip in each."""
    start = F.struct(first.alias("at"), F.lit(True).alias("whole"), F.array().cast("array<int>").alias("skips"))

    def step(acc: Column, piece: Column) -> Column:
        skip = F.least(F.greatest(acc["at"] - piece["_from"], F.lit(0)), F.size(piece["_piece"])).cast("int")
        return F.struct(
            F.greatest(acc["at"], piece["_from"] + F.size(piece["_piece"])).alias("at"),
            (acc["whole"] & (piece["_from"] <= acc["at"])).alias("whole"),
            F.concat(acc["skips"], F.array(skip)).alias("skips"))

    return F.aggregate(pieces, start, step)


def window_chunks(df: DataFrame, size_ms: int, hop_ms: int, watermark: str | None = None) -> DataFrame:
    """Assemble complete analysis windows from chunks, across chunk borders.

    Each chunk is cut where hop cells of the absolute sample clock begin; cell
    ``c`` begins at sample ``floor(c * rate * hop / 1000)``, so cells of a
    fractional number of samples do not drift. A window is a whole number of
    cells, so its samples are the sorted pieces of its cells. Grouping is by
    (call, window): a long call spreads over its windows, a group holds at most
    one window of samples once redelivered chunks are removed, and no per-call
    tail has to be kept. Samples that overlap earlier ones are left out. A window
    is ``complete`` where its pieces join up from its first sample to its last.

    Input: ``call_id, event_ts`` (time of the first sample), ``sample_rate,
    samples``. Streams pass ``watermark``. One sample rate per call.
    """
    if size_ms % hop_ms:
        raise ValueError("the window must be a whole number of hops")
    micros, rate = F.unix_micros("event_ts"), F.col("sample_rate").cast("bigint")
    start = _floor_div(micros, 1_000_000) * rate + F.round(
        F.pmod(micros, F.lit(1_000_000)) * rate / 1_000_000).cast("bigint")
    border = lambda c: _floor_div(c * hop_ms * rate, 1000)
    cell_of = lambda n: _floor_div((n + 1) * 1000 - 1, rate * hop_ms)
    placed = df.withColumn("_start", start)
    cells = F.sequence(cell_of(F.col("_start")), cell_of(F.col("_start") + F.size("samples") - 1))
    pieces = (
        placed.where(F.size("samples") > 0)
        .select("call_id", "sample_rate", "samples", "_start", F.explode(cells).alias("_c"))
        .withColumn("_from", F.greatest(F.col("_start"), border(F.col("_c"))))
        .withColumn("_to", F.least(F.col("_start") + F.size("samples"), border(F.col("_c") + 1)))
        .select(
            "call_id", "sample_rate", "_from",
            F.slice("samples", (F.col("_from") - F.col("_start") + 1).cast("int"),
                    (F.col("_to") - F.col("_from")).cast("int")).alias("_piece"),
            F.timestamp_micros(F.col("_c") * (hop_ms * 1000)).alias("cell_ts"))
    )
    if watermark:
        pieces = pieces.withWatermark("cell_ts", watermark)
    first = _floor_div(F.unix_micros("window.start"), hop_ms * 1000)
    return (
        pieces.groupBy("call_id", "sample_rate", F.window(
            "cell_ts", f"{size_ms} milliseconds", f"{hop_ms} milliseconds").alias("window"))
        .agg(F.array_sort(F.collect_list(F.struct("_from", "_piece"))).alias("_pieces"))
        .withColumn("_joined", _trimmed(F.col("_pieces"), border(first)))
        .withColumn("samples", F.flatten(F.zip_with("_pieces", "_joined.skips", lambda p, skip: F.slice(
            p["_piece"], skip + 1, F.size(p["_piece"]) - skip))))
        .select("call_id", "sample_rate", F.col("window.start").alias("window_start"),
                F.col("window.end").alias("window_end"), "samples",
                (F.col("_joined.whole") & (F.col("_joined.at") == border(first + size_ms // hop_ms))).alias("complete"))
    )


def gaps(df: DataFrame, segment_seconds: int = 60) -> DataFrame:
    """Chunks whose sequence number does not follow its predecessor in time.

    ``step`` > 1 means ``step - 1`` chunks are missing; <= 0 means out of order
    or repeated.
    """
    spec = Segments(["call_id"], ["event_ts", "seq"], time_segment("event_ts", segment_seconds))
    step = F.col("seq") - F.col("_prev.seq")
    return (
        lag_struct(df, spec, ["seq"], "_prev")
        .withColumn("step", step)
        .where(F.col("step") != 1)
        .withColumn("problem", F.when(F.col("step") > 1, "missing").otherwise("disorder"))
        .drop("_prev")
    )
