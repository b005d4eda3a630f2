"""Voiceprint registry snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_enrollment(df: DataFrame) -> DataFrame:
    """The current registry row per identity; re-enrolment replaces.

    ``did, embedding_hash, registered_at``. The hash breaks ties.
    """
    newest = F.max_by(F.struct("embedding_hash", "registered_at"), F.struct("registered_at", "embedding_hash"))
    return df.groupBy("did").agg(newest.alias("_r")).select("did", "_r.*")
