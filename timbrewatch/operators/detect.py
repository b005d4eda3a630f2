"""Feature vectors, spoof probability and its roll-up to calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from timbrewatch.config import FrameSpec, LogisticModel
from timbrewatch.operators import linked, prosody
from timbrewatch.plans.segments import micros, time_segment


MEASURES = ("flux", "flatness", "high_ratio", "rolloff_hz", "phase_dev")


def spectral_summary(per_frame: DataFrame, *by: str) -> DataFrame:
    """Window means of the per-frame spectral measures present in ``per_frame``."""
    measures = [c for c in MEASURES if c in per_frame.columns]
    return per_frame.groupBy("call_id", *by).agg(*[F.avg(m).alias(f"{m}_mean") for m in measures])


def assemble(spectral: DataFrame, prosody: DataFrame, on: Sequence[str],
             names: Sequence[str]) -> DataFrame:
    """One row per window with ``features`` in the order of ``names``.

    Both sides are already one row per window, so the join is unique on its
    key and spreads over windows.
    """
    return spectral.join(prosody, list(on)).withColumn(
        "features", F.array(*[F.col(n).cast("double") for n in names]))


def frame_measures(frames: DataFrame, spec: FrameSpec, *by: str) -> DataFrame:
    """All spectral and prosodic measures per frame, with ``mel_db``: one pass, and samples in its one shuffle."""
    return with_changes(linked.measure_frames(frames, spec, *by))


def with_changes(measured: DataFrame) -> DataFrame:
    """Add the steps of pitch and peak to the measures of ``linked``."""
    return measured.withColumns(prosody.steps_of()).drop("_prev")


def clip_scores(blocks: DataFrame, spec: FrameSpec, model: LogisticModel, frames_per_window: int) -> DataFrame:
    """``call_id, window_no`` with features and ``spoof_prob`` from blocks of clips; a clip is a call.

    One shuffle, of partial sums per window, whatever the length of a clip.
    """
    per_frame = with_changes(linked.measure_blocks(blocks, spec)).withColumnRenamed("clip", "call_id").withColumn(
        "window_no", F.floor(F.col("frame_no") / frames_per_window).cast("bigint"))
    return spoof_score(summarise_frames(per_frame, "window_no"), model)


def summarise_frames(measures: DataFrame, *by: str) -> DataFrame:
    """Spectral and prosodic features per call and window."""
    return measures.groupBy("call_id", *by).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in MEASURES], *prosody.summary_aggs())


def window_features(frames: DataFrame, spec: FrameSpec, *by: str) -> DataFrame:
    """Window features straight from frames, for when no tables are stored in between."""
    return summarise_frames(frame_measures(frames, spec, *by), *by)


def logistic(model: LogisticModel) -> Column:
    """Probability from named columns; a missing feature contributes nothing."""
    score = F.lit(model.intercept)
    for name, weight in model.weights.items():
        score = score + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
    return 1.0 / (1.0 + F.exp(-score))


def spoof_score(features: DataFrame, model: LogisticModel) -> DataFrame:
    """Add ``spoof_prob`` from the built-in logistic scorer. Map-only, generated code."""
    return features.withColumn("spoof_prob", logistic(model))


def spoof_score_batch(features: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
                      width: int, batch_size: int = 1024) -> DataFrame:
    """Add ``spoof_prob`` from an external model over the ``features`` array.

    ``make_predict`` runs once per Python worker and returns a function from a
    (rows, width) matrix to probabilities. Missing features arrive as zero.
    """
    predict = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size,
                                input_tensor_shapes=[[width]])
    filled = F.transform("features", lambda x: F.coalesce(x, F.lit(0.0)))
    return features.withColumn("spoof_prob", predict(filled))


def call_spoof_rollup(scores: DataFrame, half_life_seconds: float, ts: str = "window_end",
                      segment_seconds: int = 60) -> DataFrame:
    """Maximum, mean, latest and time-decayed mean probability per call.

    Weights halve every ``half_life_seconds`` before the call's last score. They
    are first taken relative to the end of each time slice, so that a call is
    reduced by slice, with map-side combining, before its last score is known.
    """
    width = segment_seconds * 1_000_000
    cut = scores.withColumn("_seg", time_segment(ts, segment_seconds))
    rate = F.lit(np.log(2.0) / (half_life_seconds * 1e6))
    weight = F.exp((micros(F.col(ts)) - (F.col("_seg") + 1) * width) * rate)
    slices = cut.groupBy("call_id", "_seg").agg(
        F.max("spoof_prob").alias("_max"), F.sum("spoof_prob").alias("_sum"), F.count("spoof_prob").alias("_n"),
        F.max_by("spoof_prob", ts).alias("_latest"), F.max(ts).alias("_last"),
        F.sum(F.col("spoof_prob") * weight).alias("_pw"),
        F.sum(F.when(F.col("spoof_prob").isNotNull(), weight)).alias("_w"))
    # The newest slice is the reference of the call; older ones are scaled down to it.
    newest = slices.groupBy("call_id").agg(F.max("_seg").alias("_top"))
    scale = F.exp((F.col("_seg") - F.col("_top")) * (width * rate))
    return (
        slices.join(newest, "call_id").groupBy("call_id").agg(
            F.max("_max").alias("max_prob"),
            (F.sum("_sum") / F.sum("_n")).alias("mean_prob"),
            F.max_by("_latest", "_last").alias("latest_prob"),
            (F.sum(F.col("_pw") * scale) / F.sum(F.col("_w") * scale)).alias("decayed_prob"),
            F.sum("_n").alias("n_windows"))
    )
