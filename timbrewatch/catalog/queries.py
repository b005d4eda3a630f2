"""One query per operator, over the supplied tables.

Every query takes (spark, folder) and returns a DataFrame whose columns match
the SQL of the same name in ``oracles``. Arrays are returned as rows and
numbers rounded, for comparison only; the operators themselves do neither.
Fixture scores have few decimals; the digits kept are those where no exact
tie can occur, because engines round ties differently.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbrewatch.catalog import fixtures as fx
from timbrewatch.catalog.fixtures import CFG, DAY, HOUR, SPEC, table
from timbrewatch.config import RiskConfig
from timbrewatch.operators import (
    audit, detect, explain, guard, identity, merkle, prosody, risk, sketches, spectral, trials, windows,
)
from timbrewatch.plans.live import window_audit, window_verdicts
from timbrewatch.session import scratch_dir, streaming_session
from timbrewatch.sources import clips as clip_source, wav
from timbrewatch.sources.audit_store import read_log
from timbrewatch.sources.chunks import dedup_chunks, read_chunks
from timbrewatch.sources.enrollment import latest_enrollment
from timbrewatch.schemas import EVENTS
from timbrewatch.streaming import calls, confirm, guard as guard_stream, live, status as status_stream, windows as window_stream
from timbrewatch.streaming.audit import audit_sink
from timbrewatch.streaming.replay import each_batch, finish, to_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def rounded(digits: int, *names: str) -> dict[str, Column]:
    return {n: F.round(n, digits) for n in names}


def plain_ts(*names: str) -> dict[str, Column]:
    """Zone-free timestamps, as the supplied tables have them."""
    return {n: F.col(n).cast("timestamp_ntz") for n in names}


# Sources and sinks -----------------------------------------------------------

FRAMES_PER_CLIP = 64


def _clip_folder(spark: SparkSession, sf_dir: str) -> str:
    """Frames written as WAV files, ``FRAMES_PER_CLIP`` to a clip, in the shared folder."""
    block = F.floor(F.col("frame_no") / FRAMES_PER_CLIP).cast("bigint")
    pcm = F.transform("samples", lambda x: F.floor(x * 32767 + 0.5).cast("int"))
    clips = (
        fx.frames(spark, sf_dir).groupBy("call_id", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("frame_no", pcm.alias("pcm")))).alias("f"))
        .select(F.concat_ws("-", F.lit("call"), "call_id", "block").alias("name"),
                F.lit(SPEC.sample_rate).alias("sample_rate"), F.flatten("f.pcm").alias("pcm"))
    )
    folder = clip_source.qualified(spark, scratch_dir(spark, "clips"))
    clip_source.write_clips(clips, folder).write.format("noop").mode("overwrite").save()
    return folder


def _clip_name() -> Column:
    return F.regexp_extract("path", r"([^/]+)\.wav$", 1)


@query
def audio_clip_scan(spark, sf_dir):
    clips = clip_source.read_clips(spark, _clip_folder(spark, sf_dir))
    return clips.select(_clip_name().alias("clip"), F.col("length").alias("n_bytes"))


@query
def pcm_unpack(spark, sf_dir):
    clips = clip_source.read_clips(spark, _clip_folder(spark, sf_dir))
    blocks = clip_source.unpack_pcm(clips.withColumn("path", _clip_name()), block_samples=1000)
    pcm = F.transform("samples", lambda x: (x * 32768).cast("bigint"))
    return (
        blocks.withColumn("pcm", pcm).groupBy("clip", "sample_rate").agg(
            F.sum(F.size("pcm")).alias("n_samples"), F.max("start_sample").alias("last_block"),
            F.sum(F.aggregate("pcm", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"),
            F.min(F.array_min("pcm")).alias("low"), F.max(F.array_max("pcm")).alias("high"))
    )


def _clip_of() -> Column:
    return F.regexp_extract("clip", r"([^/]+)\.wav$", 1)


@query
def clip_ranges(spark, sf_dir):
    """The same from byte ranges: parts of 4,000 bytes, which end inside clips and blocks."""
    blocks = wav.read_blocks(spark, _clip_folder(spark, sf_dir), 1000, split_bytes=4000)
    return blocks.groupBy(_clip_of().alias("clip"), "sample_rate").agg(
        F.sum(F.size("samples")).alias("n_samples"), F.max("start_sample").alias("last_block"),
        F.sum(F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"),
        F.min(F.array_min("samples")).cast("bigint").alias("low"), F.max(F.array_max("samples")).cast("bigint").alias("high"))


@query
def clip_verdicts(spark, sf_dir):
    """From WAV files to verdicts per window: blocks, frames, features, score, tier."""
    blocks = wav.read_frame_blocks(spark, _clip_folder(spark, sf_dir), SPEC, frames=20, split_bytes=4000)
    scores = detect.clip_scores(blocks, SPEC, fx.MODEL, fx.FRAMES_PER_WINDOW)
    rows = risk.verdicts(scores.withColumn("speaker_sim", F.lit(None).cast("double")), CFG)
    return rows.select(F.regexp_extract("call_id", r"([^/]+)\.wav$", 1).alias("clip"), "window_no",
                       F.round("spoof_prob", 6).alias("spoof_prob"), "tier", "action", "freeze_txn")


@query
def chunk_stream_source(spark, sf_dir):
    stream = fx.chunk_stream(streaming_session(spark), sf_dir)
    return to_table(stream, "chunks", spark).withColumns(plain_ts("event_ts"))


def _redelivered(df: DataFrame) -> DataFrame:
    """All chunks, with clicks arriving a second time five seconds later."""
    first = df.withColumn("ingest_ts", F.col("event_ts"))
    again = df.where("event_type = 'click'").withColumn(
        "ingest_ts", F.col("event_ts") + F.expr("interval 5 seconds"))
    return first.unionByName(again).select("call_id", "seq", "event_ts", "ingest_ts", "amplitude")


@query
def chunk_dedup(spark, sf_dir):
    return dedup_chunks(_redelivered(fx.chunks(spark, sf_dir)))


@query
def chunk_dedup_stream(spark, sf_dir):
    stream = dedup_chunks(_redelivered(fx.chunk_stream(streaming_session(spark), sf_dir)))
    return to_table(stream, "dedup", spark).select("call_id", "seq", "amplitude")


@query
def audit_append(spark, sf_dir):
    """Flagged verdicts of a stream, appended to the log; the replay at the end adds nothing."""
    session = streaming_session(spark)
    folder = scratch_dir(spark, "audit")
    for run in ("first", "replay"):
        verdicts = fx.chunk_verdicts(fx.chunk_stream(session, sf_dir)).withColumn("audio_hash", fx.audio_hash())
        entries = audit.audit_record(verdicts, fx.call_meta(session, sf_dir))
        each_batch(entries, audit_sink(f"{folder}/log", DAY, writer=run), f"{folder}/checkpoint-{run}")
    return read_log(spark, f"{folder}/log").select("call_id", "seq", "event_id", "prev_hash", "entry_hash")


def _sightings(df: DataFrame) -> DataFrame:
    """Contents seen by the store; many chunks share one content."""
    digest = F.sha2(F.concat_ws("|", "event_type", F.col("k").cast("string")), 256)
    return df.select(digest.alias("audio_hash"), F.concat(F.lit("ref:"), F.col("seq").cast("string")).alias("uri"),
                     (F.col("k") + 44).cast("bigint").alias("n_bytes"), F.col("event_ts").alias("first_seen"),
                     "event_type")


@query
def content_ref_append(spark, sf_dir):
    seen = _sightings(fx.chunks(spark, sf_dir))
    stored = clip_source.reduce_refs(seen.where("event_type = 'view'"))
    return clip_source.new_refs(seen, stored)


@query
def enrollment_latest(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).where("event_type = 'signup'").select(
        F.concat(F.lit("did:key:"), F.col("call_id").cast("string")).alias("did"),
        F.sha2(F.col("k").cast("string"), 256).alias("embedding_hash"), F.col("event_ts").alias("registered_at"))
    return latest_enrollment(rows)


# Framing and windows ---------------------------------------------------------

@query
def frame_samples(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return windows.frames(vectors, 16, 8).select(
        "vec_id", F.col("sub_frame").cast("bigint").alias("sub_frame"), F.col("offset").cast("bigint").alias("offset"),
        F.size("samples").cast("bigint").alias("n"), F.round(F.get("samples", F.lit(0)), 6).alias("first_sample"),
        F.round(total, 6).alias("total"))


def _window_aggs() -> list[Column]:
    return [F.count("*").alias("n_chunks"), F.round(F.avg("spoof_prob"), 10).alias("mean_prob"),
            F.max("amplitude").alias("max_amplitude")]


@query
def sliding_window_agg(spark, sf_dir):
    return windows.sliding(fx.chunks(spark, sf_dir), "2 days", "1 day", _window_aggs())


@query
def sliding_window_stream(spark, sf_dir):
    stream = fx.chunk_stream(streaming_session(spark), sf_dir)
    closed = window_stream.sliding_stream(stream, "2 days", "1 day", _window_aggs(), "1 day")
    return to_table(closed, "sliding", spark).withColumns(plain_ts("window_start", "window_end"))


#: 2024-01-01 in microseconds: present-day sample clocks.
FRAMES_FROM_US = 1_704_067_200_000_000


def _frame_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as chunks of 4 ms, end to end, from the start of 2024."""
    step_us = SPEC.length * 1_000_000 // SPEC.sample_rate
    return fx.frames(spark, sf_dir).select(
        "call_id", F.timestamp_micros(F.col("frame_no") * step_us + FRAMES_FROM_US).alias("event_ts"),
        F.lit(SPEC.sample_rate).alias("sample_rate"), "samples")


def _window_samples(df: DataFrame) -> DataFrame:
    return df.select(
        "call_id", F.unix_micros("window_start").alias("start_us"), F.size("samples").cast("bigint").alias("n"),
        "complete", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.get("samples", F.lit(0)), 6).alias("first_sample"),
        F.round(F.element_at("samples", -1), 6).alias("last_sample"))


@query
def cross_chunk_windows(spark, sf_dir):
    return _window_samples(windows.window_chunks(_frame_chunks(spark, sf_dir), 6, 3))


@query
def cross_chunk_windows_stream(spark, sf_dir):
    source = f"{scratch_dir(spark, 'frame-chunks')}/chunks"
    chunks = _frame_chunks(spark, sf_dir)
    chunks.write.parquet(source)
    stream = streaming_session(spark).readStream.schema(chunks.schema).parquet(source)
    closed = window_stream.window_chunks_stream(stream, 6, 3, "12 milliseconds")
    return _window_samples(to_table(closed, "sample-windows", spark))


@query
def chunk_gap_check(spark, sf_dir):
    """Sequence numbers are the payload counters, so gaps and disorder abound."""
    rows = fx.chunks(spark, sf_dir).select("call_id", "event_ts", F.col("k").cast("bigint").alias("seq"))
    return windows.gaps(rows, DAY)


# Spectral features -----------------------------------------------------------

@query
def power_spectrum(spark, sf_dir):
    return fx.spectrum(spark, sf_dir).select("call_id", "frame_no", F.posexplode("power").alias("b", "power")).select(
        "call_id", "frame_no", F.col("b").cast("bigint").alias("freq_bin"), F.round("power", 7).alias("power"))


@query
def mel_spectrogram(spark, sf_dir):
    return fx.mel(spark, sf_dir).select("call_id", "frame_no", F.posexplode("mel_db").alias("m", "db")).select(
        "call_id", "frame_no", F.col("m").cast("bigint").alias("mel_bin"), F.round("db", 5).alias("db"))


@query
def mel_irregularity(spark, sf_dir):
    return spectral.flux_scores(fx.spectral_frames(spark, sf_dir)).withColumns(rounded(5, "flux", "flux_z"))


@query
def phase_deviation(spark, sf_dir):
    return fx.spectral_frames(spark, sf_dir).select("call_id", "frame_no", F.round("phase_dev", 5).alias("phase_dev"))


@query
def vocoder_artifacts(spark, sf_dir):
    return (
        spectral.vocoder_artifacts(fx.spectrum(spark, sf_dir), SPEC).drop("power", "phase")
        .withColumns(rounded(6, "flatness", "high_ratio", "rolloff_hz"))
    )


# Prosody ---------------------------------------------------------------------

@query
def f0_contour(spark, sf_dir):
    return fx.contour(spark, sf_dir).select(
        "call_id", "frame_no", *[F.round(c, 6).alias(c) for c in ("rms", "peak", "f0")], "voiced")


@query
def jitter(spark, sf_dir):
    return prosody.jitter(fx.contour(spark, sf_dir)).withColumns(rounded(6, "jitter"))


@query
def shimmer(spark, sf_dir):
    return prosody.shimmer(fx.contour(spark, sf_dir)).withColumns(rounded(6, "shimmer"))


@query
def micro_pauses(spark, sf_dir):
    return prosody.micro_pauses(fx.chunks(spark, sf_dir), fx.SILENCE, 2, segment_seconds=DAY)


@query
def speech_runs(spark, sf_dir):
    voiced = fx.chunks(spark, sf_dir).where(F.col("amplitude") >= fx.SILENCE)
    return prosody.speech_runs(voiced, 12 * HOUR, DAY)


@query
def speech_runs_stream(spark, sf_dir):
    voiced = fx.chunk_stream(streaming_session(spark), sf_dir).where(F.col("amplitude") >= fx.SILENCE)
    closed = window_stream.speech_runs_stream(voiced, "12 hours", "1 day")
    return to_table(closed, "runs", spark).withColumns(plain_ts("run_start", "run_end"))


@query
def prosody_summary(spark, sf_dir):
    rows = fx.contour(spark, sf_dir).withColumn("window_no", fx.window_no())
    names = ("f0_mean", "f0_sd", "f0_range", "voiced_share", "jitter", "shimmer", "pause_rate")
    return prosody.prosody_summary(rows, "window_no").withColumns(rounded(5, *names))


# Detection -------------------------------------------------------------------

@query
def feature_assembly(spark, sf_dir):
    rows = fx.assembled(spark, sf_dir)
    return rows.select("call_id", "window_no", *[
        F.round(F.get("features", F.lit(i)), 5).alias(n) for i, n in enumerate(fx.FEATURES)])


@query
def spoof_score(spark, sf_dir):
    return detect.spoof_score(fx.window_features(spark, sf_dir), fx.MODEL).select(
        "call_id", "window_no", F.round("spoof_prob", 6).alias("spoof_prob"))


def _load_model():
    weights = np.array([fx.MODEL.weights.get(n, 0.0) for n in fx.FEATURES])

    def predict(features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(features @ weights + fx.MODEL.intercept)))

    return predict


@query
def spoof_score_batch(spark, sf_dir):
    """The same scores through the slot for external models."""
    rows = fx.window_features(spark, sf_dir).withColumn(
        "features", F.array(*[F.col(n).cast("double") for n in fx.FEATURES]))
    return detect.spoof_score_batch(rows, _load_model, len(fx.FEATURES)).select(
        "call_id", "window_no", F.round("spoof_prob", 6).alias("spoof_prob"))


@query
def call_spoof_rollup(spark, sf_dir):
    return detect.call_spoof_rollup(fx.chunks(spark, sf_dir), DAY, "event_ts", DAY).withColumns(
        {**rounded(6, "decayed_prob"), **rounded(12, "mean_prob")})


# Identity --------------------------------------------------------------------

def _voiceprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.enroll(fx.voice_vectors(spark, sf_dir))


@query
def enroll_voiceprint(spark, sf_dir):
    return _voiceprints(spark, sf_dir).select("did", F.posexplode("embedding").alias("p", "v")).select(
        "did", F.col("p").cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


@query
def hash_voiceprint(spark, sf_dir):
    return identity.hash_embedding(_voiceprints(spark, sf_dir))


@query
def verify_claimed(spark, sf_dir):
    probes = fx.voice_vectors(spark, sf_dir).withColumnRenamed("did", "claimed_did")
    return identity.verify(probes, _voiceprints(spark, sf_dir), 0.15).withColumns(rounded(6, "speaker_sim"))


@query
def identify_topk(spark, sf_dir):
    return identity.identify(fx.voice_vectors(spark, sf_dir), _voiceprints(spark, sf_dir), 3)


@query
def registry_integrity(spark, sf_dir):
    """Against a registry that lost one identity and holds a wrong hash for another."""
    prints = _voiceprints(spark, sf_dir)
    registry = identity.hash_embedding(prints).where("did <> 'did:key:9'").withColumn(
        "embedding_hash", F.when(F.col("did") == "did:key:3", F.sha2(F.lit("altered"), 256))
        .otherwise(F.col("embedding_hash")))
    return identity.integrity(prints, registry)


@query
def resolve_caller(spark, sf_dir):
    calls = fx.chunks(spark, sf_dir).select("call_id", "seq")
    return identity.resolve(calls, fx.call_meta(spark, sf_dir))


@query
def unresolved_caller(spark, sf_dir):
    calls = fx.chunks(spark, sf_dir).select("call_id", "seq")
    return identity.unresolved(calls, fx.call_meta(spark, sf_dir))


# Risk ------------------------------------------------------------------------

def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.chunk_verdicts(fx.chunks(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.enrich(fx.chunks(spark, sf_dir), fx.call_meta(spark, sf_dir), CFG)


@query
def context_enrich(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "call_id", "seq", "spoof_prob", "speaker_sim", "did", "c_mktsegment", "mismatch")


@query
def risk_score(spark, sf_dir):
    """Three factors; the speaker check is missing for callers without a DID."""
    cfg = RiskConfig(w_spoof=0.6, w_mismatch=0.25, w_context=0.15)
    rows = (
        _enriched(spark, sf_dir)
        .withColumn("speaker_sim", F.when(F.col("did").isNotNull(), F.col("speaker_sim")))
        .withColumn("context_risk", F.when(F.col("c_acctbal") < 1000, 1.0).otherwise(0.0))
    )
    return risk.risk(rows, cfg).select("call_id", "seq", F.round("risk_score", 8).alias("risk_score"))


@query
def risk_tier(spark, sf_dir):
    return risk.tier(risk.risk(fx.chunks(spark, sf_dir), CFG), CFG).groupBy("call_id", "tier").agg(
        F.count("*").alias("n"))


@query
def tier_action(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("call_id", "seq", "tier", *risk.ACTION_COLUMNS)


@query
def call_status(spark, sf_dir):
    return risk.call_status(_verdicts(spark, sf_dir), "event_ts", "event_id").withColumns(rounded(8, "risk_score"))


@query
def call_status_stream(spark, sf_dir):
    folder = scratch_dir(spark, "status")
    verdicts = fx.chunk_verdicts(fx.chunk_stream(streaming_session(spark), sf_dir))
    each_batch(status_stream.status_updates(verdicts, "event_ts", "event_id"),
               status_stream.status_sink(f"{folder}/status"), f"{folder}/checkpoint", "update")
    return status_stream.read_status(spark, f"{folder}/status").withColumns(
        {**plain_ts("event_ts"), **rounded(8, "risk_score")})


@query
def tier_transition(spark, sf_dir):
    return risk.transitions(_verdicts(spark, sf_dir), "event_ts", "event_id", DAY)


@query
def tier_transition_stream(spark, sf_dir):
    folder = scratch_dir(spark, "transitions")
    verdicts = fx.chunk_verdicts(fx.chunk_stream(streaming_session(spark), sf_dir))
    status_stream.run_transitions(verdicts, f"{folder}/edges", f"{folder}/checkpoint", "1 day", "1 hour",
                                  "event_ts", "event_id", DAY)
    return spark.read.parquet(f"{folder}/edges").select(
        "call_id", "event_ts", "event_id", "from_tier", "to_tier").withColumns(plain_ts("event_ts"))


@query
def challenge_queue(spark, sf_dir):
    status = risk.call_status(_verdicts(spark, sf_dir), "event_ts", "event_id")
    return risk.challenges(status, ts="event_ts").select("call_id", "event_ts", F.round("risk_score", 8).alias("risk_score"))


# Transaction guard -----------------------------------------------------------

@query
def txn_hold(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    flagged = fx.flags(events).where("value >= 100")
    return guard.holds(fx.txns(events), flagged, DAY, DAY).withColumnRenamed("event_id", "verdict_id")


@query
def txn_hold_stream(spark, sf_dir):
    session = streaming_session(spark)

    def events():
        return fx.event_stream(session, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))

    held = guard_stream.holds_stream(
        fx.txns(events()), fx.flags(events()).where("value >= 100"), DAY, "1 day", "1 day")
    return to_table(held, "holds", spark).withColumns(plain_ts("ts"))


@query
def txn_asof_verdict(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return guard.asof_verdict(fx.txns(events), fx.flags(events), DAY).withColumnRenamed("event_id", "verdict_id")


# Audit and provenance --------------------------------------------------------

def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries; the hash is taken from the verdict's own chunk, so nothing is joined for it."""
    verdicts = _verdicts(spark, sf_dir).withColumn("audio_hash", fx.audio_hash())
    return audit.audit_record(verdicts, fx.call_meta(spark, sf_dir))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain(_entries(spark, sf_dir), segment_seconds=DAY)


@query
def audit_record(spark, sf_dir):
    chunks = fx.chunks(spark, sf_dir)
    audio = chunks.select("call_id", "seq", fx.audio_hash().alias("audio_hash"))
    return audit.audit_record(fx.chunk_verdicts(chunks), fx.call_meta(spark, sf_dir), audio)


@query
def audit_chain(spark, sf_dir):
    return _chained(spark, sf_dir).select("call_id", "seq", "event_id", "prev_hash", "entry_hash")


@query
def audit_seal(spark, sf_dir):
    return audit.seal(_chained(spark, sf_dir))


@query
def audit_verify(spark, sf_dir):
    """After someone lowered the probability of the clearest cases."""
    log = f"{scratch_dir(spark, 'log')}/entries"
    _chained(spark, sf_dir).write.parquet(log)
    altered = spark.read.parquet(log).withColumn(
        "spoof_prob", F.when(F.col("spoof_prob") >= 0.99, 0.5).otherwise(F.col("spoof_prob")))
    return audit.verify_chain(altered)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chained log, its nodes (both written once, as an append would) and its sizes."""
    folder = scratch_dir(spark, "tree")
    _chained(spark, sf_dir).write.parquet(f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    merkle.tree_nodes(merkle.leaves(log)).write.parquet(f"{folder}/nodes")
    return log, spark.read.parquet(f"{folder}/nodes"), merkle.sizes_of(log)


@query
def audit_root(spark, sf_dir):
    log, nodes, sizes = _tree(spark, sf_dir)
    return merkle.roots(nodes, sizes)


@query
def audit_inclusion(spark, sf_dir):
    """Proof of every entry of the log: the hashes it takes and the root it leads to."""
    log, nodes, sizes = _tree(spark, sf_dir)
    return merkle.inclusion_proofs(nodes, sizes, log).select(
        "call_id", (F.col("at") + 1).alias("seq"), (F.size("path") + F.size("peaks") - 1).cast("bigint").alias("n_hashes"),
        merkle.proven_root().alias("root"))


@query
def audit_consistency(spark, sf_dir):
    """Each log continues what it was at two thirds of its length."""
    log, nodes, sizes = _tree(spark, sf_dir)
    before = sizes.withColumn("n_entries", F.ceil(F.col("n_entries") * 2 / 3).cast("bigint"))
    return merkle.consistency_proofs(nodes, before, sizes).select(
        "call_id", "old_entries", "n_entries", merkle.old_root().alias("old_root"), merkle.proven_root().alias("root"))


@query
def audit_kept_roots(spark, sf_dir):
    """Against roots kept before the log was rewritten: the clearest cases softened and chained anew, the quiet calls cut."""
    kept = merkle.roots(*_tree(spark, sf_dir)[1:])
    entries = _entries(spark, sf_dir).withColumn("spoof_prob", F.when(F.col("spoof_prob") >= 0.99, 0.5).otherwise(F.col("spoof_prob")))
    forged = audit.chain(entries, segment_seconds=DAY)
    quiet = kept.where("n_entries % 5 = 0").select("call_id", F.col("n_entries").alias("seq"))
    return merkle.check_kept(forged.join(quiet, ["call_id", "seq"], "left_anti"), kept).select("call_id", "n_entries", "problem")


@query
def audit_query(spark, sf_dir):
    return audit.audit_query(
        _entries(spark, sf_dir), 100, tier="HIGH", since=datetime(2024, 1, 10), until=datetime(2024, 1, 20),
        after=(datetime(2024, 1, 19, 12), 1 << 40))


@query
def audit_feed(spark, sf_dir):
    return audit.audit_feed(_entries(spark, sf_dir), 50)


@query
def audit_reconcile(spark, sf_dir):
    """Entries of signups were lost, and some confirmations never came."""
    verdicts = _verdicts(spark, sf_dir)
    logged = verdicts.where("event_type <> 'signup'").where(F.col("tier").isin("MEDIUM", "HIGH"))
    return audit.unconfirmed(verdicts, logged, fx.confirmations(spark, sf_dir))


@query
def content_ref_check(spark, sf_dir):
    seen = _sightings(fx.chunks(spark, sf_dir))
    return audit.ref_check(seen.where("event_type <> 'view'"),
                           clip_source.reduce_refs(seen.where("event_type <> 'click'")))


# Explainability --------------------------------------------------------------

def _flagged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of windows scored as likely spoofed, against the baseline of all frames.

    Frame measures are needed for the score, the baseline and the cells; they
    are written once to the shared folder, a fraction of the size of the samples.
    """
    folder = scratch_dir(spark, "frame-measures")
    rows = fx.frames(spark, sf_dir).withColumn("window_no", fx.window_no())
    detect.frame_measures(rows, SPEC, "window_no").write.parquet(folder)
    stored = spark.read.parquet(folder)
    scores = detect.spoof_score(detect.summarise_frames(stored, "window_no"), fx.MODEL)
    flagged = scores.where("spoof_prob >= 0.5").select("call_id", "window_no")
    mel = stored.select("call_id", "window_no", "frame_no", "mel_db")
    return explain.cells(mel.join(flagged, ["call_id", "window_no"], "left_semi"), explain.baseline(mel))


@query
def anomaly_cells(spark, sf_dir):
    return _flagged_cells(spark, sf_dir).withColumn("mel_bin", F.col("mel_bin").cast("bigint")).withColumns(
        rounded(5, "db", "z"))


@query
def heatmap_grid(spark, sf_dir):
    cells = _flagged_cells(spark, sf_dir).where(F.abs("z") >= 1)
    grid = explain.heatmap(cells, range(SPEC.n_mels))
    return grid.withColumns(rounded(5, *[f"band_{b}" for b in range(SPEC.n_mels)]))


@query
def suspicious_topk(spark, sf_dir):
    cells = _flagged_cells(spark, sf_dir).withColumn("mel_bin", F.col("mel_bin").cast("bigint")).withColumns(
        rounded(5, "z"))
    return explain.suspicious(cells, 5, "window_no").drop("db")


# Trials ----------------------------------------------------------------------

def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups never received a verdict."""
    verdicts = _verdicts(spark, sf_dir).where("event_type <> 'signup'").select(
        F.col("seq").alias("clip_id"), "risk_score", "tier")
    return trials.trials(fx.truth(spark, sf_dir), verdicts)


@query
def trial_join(spark, sf_dir):
    return _trials(spark, sf_dir).withColumns(rounded(8, "risk_score"))


@query
def confusion_by_generator(spark, sf_dir):
    return trials.confusion(_trials(spark, sf_dir), 0.5).withColumns(
        rounded(6, "false_reject_rate", "false_accept_rate"))


@query
def roc_points(spark, sf_dir):
    points = trials.roc(_trials(spark, sf_dir).withColumns(rounded(8, "risk_score")))
    return points.select("threshold", "tpr", "fpr").withColumns(rounded(6, "tpr", "fpr"))


@query
def roc_eer(spark, sf_dir):
    return trials.roc_summary(trials.roc(_trials(spark, sf_dir).withColumns(rounded(8, "risk_score")))).withColumns(rounded(6, "auc", "eer"))


@query
def latency_report(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).withColumn(
        "verdict_ts", F.col("event_ts") + F.make_dt_interval(secs=F.col("k")))
    return trials.latency(rows, 60_000, 3_000).withColumns(rounded(6, "within_budget", "real_time_factor"))


@query
def latency_sketches(spark, sf_dir):
    """Delays per month from sketches kept per day by two batches, one of them delivered twice."""
    rows = fx.chunks(spark, sf_dir)
    folder = scratch_dir(spark, "latency-sketches")
    keep = sketches.store(folder, F.col("k") * 1000, F.to_date("event_ts"))
    for batch in (0, 1, 0):
        keep(rows.where(F.col("seq") % 2 == batch), batch)
    cells = sketches.read(spark, folder).withColumn("month", F.date_trunc("month", "day").cast("date"))
    return sketches.quantiles(sketches.merge(cells, "month"), (0.5, 0.95, 0.99), "month").withColumns(
        rounded(6, "mean", "p50", "p95", "p99"))


@query
def confirm_delay(spark, sf_dir):
    return trials.confirm_delay(_verdicts(spark, sf_dir), fx.confirmations(spark, sf_dir), 60_000)


# The main path ---------------------------------------------------------------

@query
def flagged_windows(spark, sf_dir):
    """Which calls are at risk, in which window, what is done, and what is logged."""
    chunks = fx.chunks(spark, sf_dir).withColumn("audio_hash", fx.audio_hash())
    verdicts = window_verdicts(chunks, CFG, "2 days", "1 day")
    entries = window_audit(verdicts, fx.call_meta(spark, sf_dir))
    return entries.withColumns(rounded(10, "spoof_prob"))


def _live_source(session: SparkSession, folder: str) -> DataFrame:
    return read_chunks(session, folder, EVENTS)


def _live_windows(session: SparkSession, folder: str) -> DataFrame:
    cfg = RiskConfig.from_table(fx.risk_config(session))
    chunks = fx.as_chunks(_live_source(session, folder), F.col("ts").cast("timestamp")).withColumn("audio_hash", fx.audio_hash())
    return live.window_verdict_stream(chunks, cfg, "2 days", "1 day", "1 day")


@query
def flagged_windows_stream(spark, sf_dir):
    """The same entries from a stream with several batches, with thresholds from a table; heartbeats close the last windows."""
    session, folder = streaming_session(spark), scratch_dir(spark, "live")
    for _ in fx.arriving_events(spark, sf_dir, f"{folder}/events"):
        each_batch(_live_windows(session, f"{folder}/events"),
                   live.verdict_sinks(folder, fx.call_meta(session, sf_dir), DAY), f"{folder}/checkpoint")
    log = read_log(spark, f"{folder}/audit")
    return log.select("event_id", "call_id", "caller_did", "audio_hash", F.round("spoof_prob", 10).alias("spoof_prob"), "tier", "event_ts").withColumns(
        plain_ts("event_ts"))


@query
def live_holds_stream(spark, sf_dir):
    """Holds from HIGH windows, each with the verdict that caused it."""
    session, folder = streaming_session(spark), scratch_dir(spark, "live-holds")
    for _ in fx.arriving_events(spark, sf_dir, f"{folder}/events"):
        txns = fx.txns(_live_source(session, f"{folder}/events")).withColumn("ts", F.col("ts").cast("timestamp"))
        held = live.holds_of_stream(_live_windows(session, f"{folder}/events"), txns, DAY, "1 day")
        finish(held.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/holds"))
    return spark.read.schema(held.schema).parquet(f"{folder}/holds").withColumns({**plain_ts("ts", "verdict_ts"), **rounded(6, "risk_score")})


#: Silence after which a call's state is given up; longer than any in the supplied events.
IDLE = 400 * DAY


def _live_verdicts(session: SparkSession, folder: str) -> DataFrame:
    return fx.chunk_verdicts(fx.as_chunks(_live_source(session, folder), F.col("ts").cast("timestamp")))


@query
def tier_transition_live(spark, sf_dir):
    """All tier changes, from state per call."""
    session, folder = streaming_session(spark), scratch_dir(spark, "changes")
    for _ in fx.arriving_events(spark, sf_dir, f"{folder}/events"):
        edges = calls.tier_changes(_live_verdicts(session, f"{folder}/events"), "event_ts", "event_id", "1 day", IDLE)
        finish(edges.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/edges"))
    return spark.read.schema(edges.schema).parquet(f"{folder}/edges").withColumns(plain_ts("event_ts"))


@query
def call_status_live(spark, sf_dir):
    """The status of every call, from state per call."""
    session, folder = streaming_session(spark), scratch_dir(spark, "live-status")
    for _ in fx.arriving_events(spark, sf_dir, f"{folder}/events"):
        updates = calls.latest_verdicts(_live_verdicts(session, f"{folder}/events"), "event_ts", "event_id", "1 day", IDLE)
        each_batch(updates, status_stream.status_sink(f"{folder}/status"), f"{folder}/checkpoint", "update")
    return status_stream.read_status(spark, f"{folder}/status").drop("event_id").withColumns({**plain_ts("event_ts"), **rounded(8, "risk_score")})


@query
def confirmations_live(spark, sf_dir):
    """HIGH verdicts with the delay of their confirmation; null where none came in an hour."""
    session, folder = streaming_session(spark), scratch_dir(spark, "confirmations")
    for _ in fx.arriving_events(spark, sf_dir, f"{folder}/events"):
        came = fx.confirmation_stream(_live_source(session, f"{folder}/events"))
        rows = confirm.confirmations_stream(_live_verdicts(session, f"{folder}/events"), came, HOUR, "1 day", "1 day")
        finish(rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows"))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows").withColumns(plain_ts("event_ts"))
