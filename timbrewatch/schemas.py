"""Explicit schemas of the tables and streams; nothing is inferred."""

from __future__ import annotations

PCM_CHUNK = (
    "call_id string, seq bigint, event_ts timestamp, ingest_ts timestamp, "
    "sample_rate int, samples array<float>"
)
PCM_BLOCK = "clip string, sample_rate int, start_sample bigint, samples array<double>"
FRAME = "call_id string, frame_no int, start_ts timestamp, samples array<double>"
VOICEPRINT = "did string, embedding array<float>, enrolled_at timestamp"
REGISTRY = "did string, embedding_hash string, registered_at timestamp"
CALL_META = "call_id string, caller_id string, did string"
RISK_CONFIG = "param string, value double"
VERDICT = (
    "call_id string, window_start timestamp, window_end timestamp, spoof_prob double, "
    "speaker_sim double, risk_score double, tier string, action string"
)
TXN = "txn_id string, account_id string, ts timestamp, amount decimal(18,2)"
HOLD = "txn_id string, call_id string, verdict_ts timestamp, reason string"
AUDIT_EVENT = (
    "event_id string, call_id string, caller_did string, audio_hash string, spoof_prob double, "
    "tier string, event_ts timestamp, seq bigint, prev_hash string, entry_hash string"
)
CONFIRMATION = "event_id string, confirmed_ts timestamp"
CONTENT_REF = "audio_hash string, uri string, n_bytes bigint, first_seen timestamp"
TRIAL = "clip_id string, truth string, generator string"

# The supplied stand-in for the chunk, verdict and transaction streams.
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
