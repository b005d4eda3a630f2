"""Pitch contour, jitter, shimmer and pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.config import FrameSpec
from timbrewatch.functions.prosody import pitch_track
from timbrewatch.operators.spectral import with_previous_frame
from timbrewatch.plans.segments import Segments, micros, number_runs, time_segment


def f0_contour(frames: DataFrame, spec: FrameSpec) -> DataFrame:
    """Replace ``samples`` by ``rms``, ``peak``, ``f0`` and ``voiced``. Map-only."""
    kept = [c for c in frames.columns if c != "samples"]
    return (
        frames.select(*kept, pitch_track(F.col("samples"), spec).alias("_p"))
        .select(*kept, "_p.rms", "_p.peak", "_p.f0", F.col("_p.f0").isNotNull().alias("voiced"))
    )


STEP_COLUMNS = ("f0", "peak", "voiced")


def steps_of() -> dict[str, Column]:
    """The differences that jitter, shimmer and pauses are made of.

    ``period`` and the absolute change of period and peak since ``_prev`` exist
    for voiced frames only; ``pause_start`` marks an unvoiced frame right after
    a voiced one.
    """
    both = F.col("voiced") & F.col("_prev.voiced")
    period = 1.0 / F.col("f0")
    return {
        "period": F.when(F.col("voiced"), period),
        "period_step": F.when(both, F.abs(period - 1.0 / F.col("_prev.f0"))),
        "peak_step": F.when(both, F.abs(F.col("peak") - F.col("_prev.peak"))),
        "pause_start": F.coalesce(~F.col("voiced") & F.col("_prev.voiced"), F.lit(False)),
    }


def with_steps(contour: DataFrame) -> DataFrame:
    return with_previous_frame(contour, *STEP_COLUMNS).withColumns(steps_of()).drop("_prev")


def _relative(step: str, level: Column) -> Column:
    return F.avg(step) / F.nullif(F.avg(level), F.lit(0.0))


def jitter_of() -> Column:
    return _relative("period_step", F.col("period"))


def shimmer_of() -> Column:
    return _relative("peak_step", F.when(F.col("voiced"), F.col("peak")))


def jitter(contour: DataFrame, *by: str) -> DataFrame:
    """Mean change of consecutive pitch periods over the mean period."""
    return with_steps(contour).groupBy("call_id", *by).agg(jitter_of().alias("jitter"))


def shimmer(contour: DataFrame, *by: str) -> DataFrame:
    """Mean change of consecutive voiced peaks over the mean voiced peak."""
    return with_steps(contour).groupBy("call_id", *by).agg(shimmer_of().alias("shimmer"))


def summary_aggs() -> list[Column]:
    return [
        F.avg("f0").alias("f0_mean"),
        F.stddev_samp("f0").alias("f0_sd"),
        (F.max("f0") - F.min("f0")).alias("f0_range"),
        F.avg(F.col("voiced").cast("double")).alias("voiced_share"),
        jitter_of().alias("jitter"),
        shimmer_of().alias("shimmer"),
        F.avg(F.col("pause_start").cast("double")).alias("pause_rate"),
    ]


def prosody_summary(contour: DataFrame, *by: str) -> DataFrame:
    """Pitch, voicing, jitter, shimmer and pause rate per call and window."""
    return with_steps(contour).groupBy("call_id", *by).agg(*summary_aggs())


def micro_pauses(chunks: DataFrame, floor: float, min_len: int, level: str = "amplitude",
                 segment_seconds: int = 60) -> DataFrame:
    """Silent runs of at least ``min_len`` consecutive chunks, with start, end and count.

    A run is reduced by aggregation, so its length does not matter.
    """
    spec = Segments(["call_id"], ["event_ts", "seq"], time_segment("event_ts", segment_seconds))
    flagged = chunks.select("call_id", "event_ts", "seq", (F.col(level) < floor).alias("silent"))
    numbered = number_runs(flagged, spec, ["silent"], F.col("silent") != F.col("_prev.silent"), "run")
    return (
        numbered.where("silent").groupBy("call_id", "run")
        .agg(F.min("event_ts").alias("pause_start"), F.max("event_ts").alias("pause_end"),
             F.count("*").alias("n_chunks"))
        .where(F.col("n_chunks") >= min_len)
        .drop("run")
    )


def speech_runs(voiced: DataFrame, gap_seconds: int, segment_seconds: int = 60) -> DataFrame:
    """Batch sessions of voiced rows: a gap of ``gap_seconds`` or more starts a new one.

    Equal to grouping by a session window, whose batch plan would bring all rows
    of a call to one task. As there, a session ends ``gap_seconds`` after its
    last row.
    """
    spec = Segments(["call_id"], ["event_ts", "seq"], time_segment("event_ts", segment_seconds))
    wait = micros(F.col("event_ts")) - micros(F.col("_prev.event_ts"))
    numbered = number_runs(voiced.select("call_id", "event_ts", "seq"), spec, ["event_ts"],
                           wait >= gap_seconds * 1_000_000, "run")
    return (
        numbered.groupBy("call_id", "run")
        .agg(F.min("event_ts").alias("run_start"), F.max("event_ts").alias("_last"),
             F.count("*").alias("n_chunks"))
        .select("call_id", "run_start",
                (F.col("_last") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("run_end"), "n_chunks")
    )
