"""Risk scoring, tiers, actions and call status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.config import RiskConfig
from timbrewatch.plans.segments import Segments, lag_struct, time_segment

# What each tier sets in motion.
ACTIONS = {
    "LOW": ("normal", False, False, False),
    "MEDIUM": ("challenge", True, False, False),
    "HIGH": ("block", True, True, True),
}
ACTION_COLUMNS = ("action", "warn", "block", "freeze_txn")


def enrich(scores: DataFrame, meta: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Attach call metadata and the mismatch flag to each scored window.

    Metadata is unique per call. The configuration has been read already and
    enters as constants.
    """
    return scores.join(meta, "call_id", "left").withColumn(
        "mismatch", F.col("speaker_sim") < cfg.mismatch_threshold)


def weighted_mean(factors: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of the factors that are present; null without any."""
    total, present = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        value = factors[name]
        total = total + F.coalesce(value * weight, F.lit(0.0))
        present = present + F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0)
    return F.try_divide(total, present)


def risk(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Add ``risk_score`` in [0, 1] from ``spoof_prob``, ``speaker_sim`` and, if weighted, ``context_risk``.

    A missing factor leaves its weight to the others. The score leaves through
    a one-row generator: Spark pushes filters on tiers down by repeating the
    expressions behind them, which made methods too large for the JIT; through
    the generator it pushes filters on other columns only.
    """
    factors = {"spoof": F.col("spoof_prob"), "mismatch": 1.0 - F.col("speaker_sim")}
    if cfg.w_context > 0:
        factors["context"] = F.col("context_risk")
    mean = F.col("_mean")
    # The clamp alone would turn "no factor at all" into a bound.
    score = F.when(mean.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))
    return df.withColumn("_mean", weighted_mean(factors, cfg.weights)).select(
        *df.columns, F.inline(F.array(F.struct(score.alias("risk_score")))))


def tier(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Add ``tier``; null where there is no score."""
    score = F.col("risk_score")
    return df.withColumn("tier", F.when(score >= cfg.high, "HIGH").when(score >= cfg.medium, "MEDIUM")
                         .when(score.isNotNull(), "LOW"))


def action(df: DataFrame) -> DataFrame:
    """Add the action of the tier and its switches, as constants of the plan."""
    for i, name in enumerate(ACTION_COLUMNS):
        value = None
        for level, row in ACTIONS.items():
            hit = F.col("tier") == level
            value = F.when(hit, F.lit(row[i])) if value is None else value.when(hit, F.lit(row[i]))
        df = df.withColumn(name, value)
    return df


def verdicts(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Score, tier and action in one map-only step."""
    return action(tier(risk(df, cfg), cfg))


def call_status(rows: DataFrame, ts: str = "window_end", tie: str | None = None) -> DataFrame:
    """The latest score, tier and action per call, combined map-side."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    latest = F.max_by(F.struct(ts, "risk_score", "tier", "action"), order)
    return rows.groupBy("call_id").agg(latest.alias("_s")).select("call_id", "_s.*")


def transitions(rows: DataFrame, ts: str = "window_end", tie: str = "event_id",
                segment_seconds: int = 60) -> DataFrame:
    """Rows where a call's tier differs from its previous one; the first always counts."""
    spec = Segments(["call_id"], [ts, tie], time_segment(ts, segment_seconds))
    narrow = rows.select("call_id", ts, tie, "tier")
    return (
        lag_struct(narrow, spec, ["tier"], "_prev")
        .withColumn("from_tier", F.col("_prev.tier"))
        .where(~F.col("tier").eqNullSafe(F.col("from_tier")))
        .select("call_id", ts, tie, "from_tier", F.col("tier").alias("to_tier"))
    )


def challenges(status: DataFrame, n: int | None = None, ts: str = "window_end") -> DataFrame:
    """All calls at MEDIUM, newest first; with ``n`` only that many, as a page to show."""
    queue = status.where(F.col("tier") == "MEDIUM").orderBy(F.desc(ts), "call_id")
    return queue if n is None else queue.limit(n)
