"""Digests over explicitly formatted text; doubles are quantised, never printed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timbrewatch.plans.segments import micros

# Fixed values of the stored format.
SEPARATOR = "|"
GENESIS = "GENESIS"
PROBABILITY_SCALE = 1_000_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts]), 256)


def link(prev_hash: Column, entry_digest: Column) -> Column:
    return F.sha2(F.concat(prev_hash, entry_digest), 256)


def entry_digest() -> Column:
    """Digest of an audit entry's own fields, its position included.

    Each field stands behind its length, and a missing one is ``~``, so no two field lists
    share a text: nothing can be moved from one field to the next.
    """
    probability = F.round(F.col("spoof_prob") * PROBABILITY_SCALE).cast("bigint")
    parts = [
        F.col("call_id"), F.col("seq"), F.col("event_id"), F.col("caller_did"),
        F.col("audio_hash"), probability, F.col("tier"), micros(F.col("event_ts")),
    ]
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]), 256)
