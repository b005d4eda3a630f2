"""Accuracy and latency reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from timbrewatch.plans.segments import micros

#: Score ranges whose totals are summed up in one small window.
SCORE_RANGES = 4096
PERCENTILES = (0.5, 0.95, 0.99)


def trials(truth: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Ground truth with its verdict; clips without a verdict are kept.

    Both sides have one row per clip.
    """
    return truth.join(verdicts, "clip_id", "left")


def confusion(trial_rows: DataFrame, threshold: float, score: str = "risk_score") -> DataFrame:
    """Outcome counts and error rates per generator and overall.

    Authentic clips form the group ``authentic``; the overall line is ``ALL``.
    A rate is null where its group has no clips it could apply to. Clips without
    a score are counted apart. The grouping sets run over the counted groups,
    not over the clips.
    """
    s, fake = F.col(score), F.col("truth") == "synthetic"
    flagged = s >= threshold
    counted = trial_rows.groupBy(F.coalesce("generator", F.lit("authentic")).alias("generator")).agg(
        F.count_if(fake & flagged).alias("tp"), F.count_if(fake & ~flagged).alias("fn"),
        F.count_if(~fake & flagged).alias("fp"), F.count_if(~fake & ~flagged).alias("tn"),
        F.count_if(s.isNull()).alias("unscored"))
    names = ("tp", "fn", "fp", "tn", "unscored")
    return (
        counted.groupingSets([["generator"], []], "generator")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(F.coalesce("generator", F.lit("ALL")).alias("generator"), *names,
                (F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0))).alias("false_reject_rate"),
                (F.col("fn") / F.nullif(F.col("fn") + F.col("tp"), F.lit(0))).alias("false_accept_rate"))
    )


def roc(trial_rows: DataFrame, score: str = "risk_score", ranges: int = SCORE_RANGES) -> DataFrame:
    """ROC points: the rates when everything at or above ``threshold`` is flagged.

    One row per distinct score, plus what the score adds (``tpr_step``,
    ``fpr_step``). Scores lie in [0, 1] and are cut into ``ranges`` ranges: points
    are summed up within their range, and only range totals in a global window.
    """
    fake = F.col("truth") == "synthetic"
    per_score = (
        trial_rows.where(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("threshold"))
        .agg(F.count_if(fake).alias("_p"), F.count_if(~fake).alias("_n"))
        .withColumn("_range", F.least(F.floor(F.col("threshold") * ranges), F.lit(ranges)))
    )
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = per_score.groupBy("_range").agg(F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn")).select(
        "_range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above{c}") for c in ("_rp", "_rn")),
        *(F.nullif(F.sum(c).over(whole), F.lit(0)).alias(f"_all{c}") for c in ("_rp", "_rn")))
    upto = Window.partitionBy("_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    summed = per_score.withColumns({c: F.sum(c[1:3]).over(upto) for c in ("__p", "__n")})
    return summed.join(F.broadcast(totals), "_range").select(
        "threshold",
        ((F.col("__p") + F.col("_above_rp")) / F.col("_all_rp")).alias("tpr"),
        ((F.col("__n") + F.col("_above_rn")) / F.col("_all_rn")).alias("fpr"),
        (F.col("_p") / F.col("_all_rp")).alias("tpr_step"), (F.col("_n") / F.col("_all_rn")).alias("fpr_step"))


def roc_summary(points: DataFrame) -> DataFrame:
    """Area under the curve (trapezoids) and the threshold where both error rates meet."""
    step, height = F.col("fpr_step"), F.col("tpr") - F.col("tpr_step") / 2
    gap = F.round(F.abs(F.col("fpr") - (1 - F.col("tpr"))), 9)
    return points.withColumn("_area", step * height).agg(
        F.sum("_area").alias("auc"),
        F.min_by("threshold", F.struct(gap, F.col("threshold"))).alias("eer_threshold"),
        F.min_by((F.col("fpr") + 1 - F.col("tpr")) / 2, F.struct(gap, F.col("threshold"))).alias("eer"))


def _delay_ms(start: str, end: str) -> Column:
    return F.floor((micros(F.col(end)) - micros(F.col(start))) / 1000).cast("bigint")


def _percentiles(histogram: DataFrame, value: str, weight: str, percentiles: Sequence[float]) -> list[Column]:
    return [F.percentile(value, F.lit(p), F.col(weight)).alias(f"p{p * 100:g}_ms") for p in percentiles]


def latency(rows: DataFrame, budget_ms: int, window_ms: int, start: str = "event_ts",
            end: str = "verdict_ts", percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Exact percentiles of verdict delay, share within budget, and real-time factor.

    Delays are counted per millisecond first; the final task sees one row per
    distinct delay, not one per verdict. The real-time factor is delay over the
    audio length of a window.
    """
    histogram = rows.groupBy(_delay_ms(start, end).alias("_ms")).agg(F.count("*").alias("_n")).where(
        F.col("_ms").isNotNull())
    return histogram.agg(
        F.sum("_n").alias("n_verdicts"),
        *_percentiles(histogram, "_ms", "_n", percentiles),
        (F.sum(F.when(F.col("_ms") <= budget_ms, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("within_budget"),
        (F.sum(F.col("_ms") * F.col("_n")) / (F.sum("_n") * window_ms)).alias("real_time_factor"))


def confirm_delay(verdicts: DataFrame, confirmations: DataFrame, bound_ms: int,
                  percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Delay from high-risk verdicts to their confirmed entry.

    ``breaches`` counts confirmations later than the bound and verdicts never
    confirmed.
    """
    high = verdicts.where(F.col("tier") == "HIGH").select("event_id", "event_ts")
    joined = high.join(confirmations, "event_id", "left")
    histogram = joined.groupBy(_delay_ms("event_ts", "confirmed_ts").alias("_ms")).agg(
        F.count("*").alias("_n"))
    late = F.col("_ms").isNull() | (F.col("_ms") > bound_ms)
    return histogram.agg(
        F.sum("_n").alias("n_high"),
        F.sum(F.when(F.col("_ms").isNull(), F.col("_n")).otherwise(0)).alias("unconfirmed"),
        *_percentiles(histogram, "_ms", "_n", percentiles),
        F.sum(F.when(late, F.col("_n")).otherwise(0)).alias("breaches"))
