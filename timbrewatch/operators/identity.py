"""Voiceprint enrolment, hashing, verification and caller resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timbrewatch.functions.vectors import cosine, mean_vector, quantised_text, unit
from timbrewatch.plans.nearest import nearest_by_tiles, nearest_in_matrix

HASH_SCALE = 1_000_000
# Most numbers a registry may hold to be sent to every executor: 32 MB of doubles.
MATRIX_CELLS = 4_000_000


def enroll(vectors: DataFrame) -> DataFrame:
    """One unit-length mean voiceprint per identity, combined map-side."""
    return (
        vectors.groupBy("did").agg(mean_vector(F.col("embedding")).alias("_mean"))
        .select("did", unit(F.col("_mean")).alias("embedding"))
    )


def hash_embedding(voiceprints: DataFrame) -> DataFrame:
    """``did, embedding_hash`` with the vector itself left out. Map-only."""
    text = quantised_text(F.col("embedding"), HASH_SCALE)
    return voiceprints.select("did", F.sha2(text, 256).alias("embedding_hash"))


def verify(probes: DataFrame, voiceprints: DataFrame, threshold: float) -> DataFrame:
    """Similarity of each probe to the voiceprint of the identity it claims.

    Probes of unknown identities are kept with null similarity and count as
    mismatches. Voiceprints are unique per identity and may be many, so no
    broadcast is forced; see the README on skewed identities.
    """
    prints = voiceprints.select(F.col("did").alias("claimed_did"), F.col("embedding").alias("_vp"))
    return (
        probes.join(prints, "claimed_did", "left")
        .withColumn("speaker_sim", cosine(F.col("embedding"), F.col("_vp")))
        .withColumn("mismatch", F.coalesce(F.col("speaker_sim") < threshold, F.lit(True)))
        .drop("_vp", "embedding")
    )


def identify(probes: DataFrame, voiceprints: DataFrame, k: int, probe_id: str = "vec_id",
             matrix_cells: int = MATRIX_CELLS) -> DataFrame:
    """The k most similar enrolled identities of each probe, exactly.

    The registry is measured first: within the bound it becomes one matrix on
    every executor; beyond it, tiles are joined.
    """
    cells = voiceprints.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    search = nearest_in_matrix if cells <= matrix_cells else nearest_by_tiles
    return search(probes, voiceprints, probe_id, k)


def integrity(voiceprints: DataFrame, registry: DataFrame) -> DataFrame:
    """Voiceprints whose recomputed hash is missing from, or differs in, the registry."""
    known = registry.select("did", F.col("embedding_hash").alias("_registered"))
    return (
        hash_embedding(voiceprints).join(known, "did", "left")
        .where(F.col("_registered").isNull() | (F.col("_registered") != F.col("embedding_hash")))
        .select("did", "embedding_hash",
                F.when(F.col("_registered").isNull(), "unregistered").otherwise("altered").alias("problem"))
    )


def resolve(calls: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach the caller's DID; ``resolved`` is false where none is on file."""
    dids = meta.select("call_id", F.col("did").alias("caller_did"))
    return calls.join(dids, "call_id", "left").withColumn("resolved", F.col("caller_did").isNotNull())


def unresolved(calls: DataFrame, meta: DataFrame) -> DataFrame:
    """Calls without a DID on file."""
    known = meta.where(F.col("did").isNotNull()).select("call_id")
    return calls.join(known, "call_id", "left_anti")
