"""Spectral features per frame: spectrum, mel bands, flux, phase and vocoder measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.config import FrameSpec
from timbrewatch.functions import spectral as fs
from timbrewatch.plans.segments import adjacent_struct

FRAMES_PER_SEGMENT = 4096


def with_previous_frame(df: DataFrame, *cols: str) -> DataFrame:
    """Add ``_prev`` with ``cols`` of the adjacent earlier frame of the call, or null.

    Frame numbers are unique in a call, so a task's group holds at most
    ``FRAMES_PER_SEGMENT`` frames and a neighbour, however long the call is.
    """
    return adjacent_struct(df, ["call_id"], "frame_no", FRAMES_PER_SEGMENT, cols, "_prev")


def power_spectrum(frames: DataFrame, taper: bool = True) -> DataFrame:
    """Replace ``samples`` by ``power`` and ``phase`` per bin. Map-only."""
    kept = [c for c in frames.columns if c != "samples"]
    return (
        frames.select(*kept, fs.spectrum(F.col("samples"), taper).alias("_s"))
        .select(*kept, F.col("_s.power").alias("power"), F.col("_s.phase").alias("phase"))
    )


def mel_spectrogram(spectrum: DataFrame, spec: FrameSpec) -> DataFrame:
    """Add ``mel_db``. Map-only; the filterbank size depends on parameters alone."""
    return spectrum.withColumn("mel_db", fs.mel_db(F.col("power"), spec))


def flux_of() -> Column:
    """Euclidean distance of ``mel_db`` from that of ``_prev``."""
    changes = F.zip_with("mel_db", "_prev.mel_db", lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(changes, F.lit(0.0), lambda acc, x: acc + x))


def spectral_flux(mel: DataFrame) -> DataFrame:
    """Add ``flux`` against the adjacent earlier frame; null where that is absent."""
    return with_previous_frame(mel, "mel_db").withColumn("flux", flux_of()).drop("_prev")


def mel_irregularity(mel: DataFrame) -> DataFrame:
    """Flux and its z-score within the call.

    Statistics per call are combined map-side. The join back is left to adaptive
    execution: broadcast when the statistics prove small, otherwise a merge join
    whose oversized partitions are split.
    """
    return flux_scores(spectral_flux(mel.select("call_id", "frame_no", "mel_db")))


def flux_scores(flux: DataFrame) -> DataFrame:
    """``flux_z`` of each frame's ``flux`` within its call."""
    flux = flux.select("call_id", "frame_no", "flux")
    stats = flux.groupBy("call_id").agg(
        F.avg("flux").alias("_mean"), F.stddev_samp("flux").alias("_sd"))
    z = (F.col("flux") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return flux.join(stats, "call_id").withColumn("flux_z", z).drop("_mean", "_sd")


def phase_dev_of(spec: FrameSpec, floor: float = 1e-6) -> Column:
    """Mean absolute deviation of the phase advance since ``_prev`` from a steady tone's.

    The expected advance of bin ``b`` over one hop is ``2*pi*b*hop/length``. The
    first and last bin are real and are left out, as are bins whose power is
    below ``floor`` in either frame. Null where no bin remains.
    """
    turn = 2 * math.pi

    def deviation(now, before, b):
        raw = now["phase"] - before["phase"] - b * (turn * spec.hop / spec.length)
        return F.abs(raw - turn * F.round(raw / turn))

    pairs = F.zip_with(
        F.arrays_zip("power", "phase"), F.arrays_zip("_prev.power", "_prev.phase"),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    per_bin = F.transform(pairs, lambda x, b: F.when(
        (b > 0) & (b < spec.length / 2) & (x["a"]["power"] >= floor) & (x["b"]["power"] >= floor),
        deviation(x["a"], x["b"], b)))
    total = F.aggregate(
        per_bin, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, x: F.when(x.isNull(), acc).otherwise(
            F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n"))),
        lambda acc: acc["s"] / F.nullif(acc["n"], F.lit(0)))
    return F.when(F.col("_prev").isNotNull(), total)


def phase_deviation(spectrum: DataFrame, spec: FrameSpec, floor: float = 1e-6) -> DataFrame:
    """``phase_dev`` of each frame; null where the earlier frame is absent."""
    narrow = spectrum.select("call_id", "frame_no", "power", "phase")
    return with_previous_frame(narrow, "power", "phase").select(
        "call_id", "frame_no", phase_dev_of(spec, floor).alias("phase_dev"))


def vocoder_artifacts(spectrum: DataFrame, spec: FrameSpec, high_hz: float = 4000.0,
                      share: float = 0.85) -> DataFrame:
    """Add spectral flatness, energy share above ``high_hz`` and roll-off. Map-only."""
    kept = spectrum.columns
    return (
        spectrum.withColumn("_v", fs.vocoder_measures(F.col("power"), spec, high_hz, share))
        .select(*kept, "_v.flatness", "_v.high_ratio", "_v.rolloff_hz")
    )
