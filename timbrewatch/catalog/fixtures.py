"""Stand-ins for the engine's tables, derived from the supplied ones.

``events`` plays the chunk, verdict and transaction streams, ``embeddings`` the
sample frames and voice vectors, ``customer`` the call metadata. Events of one
user are hours apart, so days stand for seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbrewatch.config import FrameSpec, LogisticModel, RiskConfig
from timbrewatch.functions.hashing import digest
from timbrewatch.operators import detect, linked, prosody, risk, spectral
from timbrewatch.plans.segments import Segments, index_segment, position
from timbrewatch.schemas import EVENTS, RISK_CONFIG
from timbrewatch.sources.chunks import read_chunks

CFG = RiskConfig()
SPEC = FrameSpec(sample_rate=16_000, length=64, hop=64, n_mels=12, fmin=400.0, fmax=2000.0, voicing=0.2)
DAY = 86_400
HOUR = 3_600
FRAMES_PER_WINDOW = 8
SILENCE = 20.0
FEATURES = (
    "flux_mean", "flatness_mean", "high_ratio_mean", "rolloff_hz_mean", "phase_dev_mean",
    "f0_mean", "f0_sd", "f0_range", "voiced_share", "jitter", "shimmer", "pause_rate",
)
MODEL = LogisticModel(
    weights={"flux_mean": 0.05, "flatness_mean": -4.0, "high_ratio_mean": 2.0, "phase_dev_mean": 0.5,
             "voiced_share": 1.0, "jitter": 0.8, "shimmer": 0.6, "pause_rate": -1.5},
    intercept=-1.2,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of() -> Column:
    """The counter in ``props``, a flat object with this one key; a pattern beats a JSON parser here."""
    return F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")


def as_chunks(events: DataFrame, ts: Column | None = None) -> DataFrame:
    """Chunks with their scores from event rows, static or streaming. Map-only."""
    return events.select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"),
        (F.col("ts") if ts is None else ts).alias("event_ts"), "event_type",
        F.col("value").alias("amplitude"), k_of().alias("k"),
        F.round(1 - F.exp(-F.col("value") / 50), 6).alias("spoof_prob"),
        (k_of() / F.lit(100.0)).alias("speaker_sim"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chunks(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream. The pattern matches a table kept as one file or as a folder."""
    return read_chunks(spark, f"{sf_dir}/events.parque[t]", EVENTS)


def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream; event time in the type watermarks need."""
    return as_chunks(event_stream(spark, sf_dir), F.col("ts").cast("timestamp"))


def audio_hash() -> Column:
    """Digest standing for the chunk's audio, which is not supplied."""
    return digest(F.col("call_id"), F.col("seq"), F.round(F.col("amplitude") * 100).cast("bigint"))


def chunk_verdicts(df: DataFrame, cfg: RiskConfig = CFG) -> DataFrame:
    """One verdict per chunk."""
    return risk.verdicts(df, cfg).withColumn("event_id", F.col("seq"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label, in id order, as the consecutive frames of a call."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("call_id"), "vec_id", "embedding")
    spec = Segments(["call_id"], ["vec_id"], index_segment("vec_id", 1024))
    return position(rows, spec, "_pos").select(
        "call_id", (F.col("_pos") - 1).alias("frame_no"), "vec_id",
        F.col("embedding").cast("array<double>").alias("samples"))


def txns(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), "ts",
        F.col("value").alias("amount"))


def flags(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").select(
        "event_id", F.col("user_id").alias("account_id"), F.col("ts").alias("verdict_ts"), "value")


def call_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; those in arrears have no DID on file."""
    did = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("did:key:"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("call_id"), did.alias("did"), "c_mktsegment", "c_acctbal")


def voice_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("did:key:"), F.col("label").cast("string")).alias("did"), "embedding")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    fake = F.col("event_type") == "error"
    generator = F.when(fake, F.when(k_of() < 33, "gen_a").when(k_of() < 66, "gen_b").otherwise("gen_c"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("clip_id"),
        F.when(fake, "synthetic").otherwise("authentic").alias("truth"), generator.alias("generator"))


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed after ``k`` seconds; the quickest tenth never arrived."""
    return (
        table(spark, sf_dir, "events").select("event_id", "ts", k_of().alias("k")).where("k >= 10")
        .select("event_id", (F.col("ts") + F.make_dt_interval(secs=F.col("k"))).alias("confirmed_ts"))
    )


def confirmation_stream(events: DataFrame) -> DataFrame:
    """The same from a stream of events; heartbeats keep a time and no id."""
    sure = F.col("user_id").isNotNull() & (k_of() >= 10)
    return events.select(F.when(sure, F.col("event_id")).alias("event_id"),
                         (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=k_of())).alias("confirmed_ts"))


def window_no() -> Column:
    return F.floor(F.col("frame_no") / FRAMES_PER_WINDOW).cast("bigint")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.power_spectrum(frames(spark, sf_dir)).select("call_id", "frame_no", "power", "phase")


def mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.mel_spectrogram(spectrum(spark, sf_dir), SPEC).select("call_id", "frame_no", "mel_db")


def contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prosody.f0_contour(frames(spark, sf_dir), SPEC)


def spectral_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spectral measures per frame."""
    return linked.measure_frames(frames(spark, sf_dir), SPEC).select(
        "call_id", "frame_no", *detect.MEASURES)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window features from a spectral and a prosodic table, joined once per window."""
    by_window = detect.spectral_summary(
        spectral_frames(spark, sf_dir).withColumn("window_no", window_no()), "window_no")
    speech = prosody.prosody_summary(
        contour(spark, sf_dir).withColumn("window_no", window_no()), "window_no")
    return detect.assemble(by_window, speech, ["call_id", "window_no"], FEATURES)


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features in one pass over the frames."""
    return detect.window_features(
        frames(spark, sf_dir).withColumn("window_no", window_no()), SPEC, "window_no")


def risk_config(spark: SparkSession) -> DataFrame:
    """The settings as the table an operator would keep."""
    return spark.createDataFrame([("medium", CFG.medium), ("high", CFG.high)], RISK_CONFIG)


def arriving_events(spark: SparkSession, sf_dir: str, folder: str, slices: int = 3, flushes: int = 2) -> Iterator[int]:
    """Events arrive in ``folder`` one time slice after another, then heartbeats; yields after each arrival.

    A heartbeat is an event without a user, far later than the others.
    """
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    width = (high - low) // slices + 1
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) / width)
    for k in range(slices):
        events.where(at == k).write.mode("append").parquet(folder)
        yield k
    for k in range(flushes):
        beat = F.timestamp_micros(F.lit(high + (k + 1) * 60 * DAY * 1_000_000)).cast("timestamp_ntz")
        spark.range(1).select(F.lit(None).cast("bigint").alias("event_id"), beat.alias("ts"), F.lit(None).cast("bigint").alias("user_id"),
                              F.lit("purchase").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props")).write.mode("append").parquet(folder)
        yield slices + k
