"""SQL statements the queries are checked against, over the supplied tables.

Each statement is written from the definition of its operator and shares no code
with it. ``WITH`` parts used by several statements are named in ``PARTS``; a
statement lists the parts it needs in order.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

K = "cast(json_extract_string(props, '$.k') as int)"

PARTS = {
    "chunks": f"""
        select user_id as call_id, event_id as seq, ts as event_ts, event_type, value as amplitude,
               {K} as k, round(1 - exp(-value / 50), 6) as spoof_prob, {K} / 100.0::double as speaker_sim
        from events""",
    "verdicts": """
        select *, seq as event_id,
               case when risk_score >= 0.7::double then 'HIGH' when risk_score >= 0.4::double then 'MEDIUM'
                    else 'LOW' end as tier
        from (select *, spoof_prob * 0.7::double + (1 - speaker_sim) * 0.3::double as risk_score from chunks)""",
    "meta": """
        select c_custkey as call_id, case when c_acctbal >= 0 then 'did:key:' || c_custkey end as did,
               c_mktsegment, c_acctbal
        from customer""",
    "entries": """
        select event_id, v.call_id, did as caller_did,
               sha256(v.call_id || '|' || seq || '|' || cast(round(amplitude * 100) as bigint)) as audio_hash,
               spoof_prob, tier, event_ts
        from verdicts v left join meta m on v.call_id = m.call_id
        where tier in ('MEDIUM', 'HIGH')""",
    "digested": """
        select *, sha256(list_aggregate(list_transform(
            [call_id::varchar, seq::varchar, event_id::varchar, caller_did, audio_hash,
             cast(round(spoof_prob * 1000000) as bigint)::varchar, tier, epoch_us(event_ts)::varchar],
            lambda f: coalesce(length(f) || ':' || f, '~')), 'string_agg', '')) as digest
        from (select *, row_number() over (partition by call_id order by event_ts, event_id) as seq from entries)""",
    "chained": """
        select call_id, seq, event_id, digest, 'GENESIS' as prev_hash, sha256('GENESIS' || digest) as entry_hash
        from digested where (seq - 1) % 256 = 0
        union all
        select d.call_id, d.seq, d.event_id, d.digest, c.entry_hash, sha256(c.entry_hash || d.digest)
        from chained c join digested d on d.call_id = c.call_id and d.seq = c.seq + 1
        where (d.seq - 1) % 256 <> 0""",
    "nodes": """
        select call_id, 0 as level, (seq - 1)::bigint as at_no, sha256('0' || digest) as hash from digested
        union all
        select call_id, level + 1, at_no // 2, sha256('1' || string_agg(hash, '' order by at_no))
        from nodes group by call_id, level, at_no // 2 having count(*) = 2""",
    "lengths": "select call_id, count(*)::bigint as n_entries from digested group by call_id",
    "cuts": "select call_id, ceil(n_entries * 2 / 3)::bigint as n_entries from lengths union select * from lengths",
    "tops": """
        select c.call_id, c.n_entries, n.level, n.hash
        from cuts c join nodes n on n.call_id = c.call_id and (c.n_entries >> n.level) % 2 = 1
             and n.at_no = (c.n_entries >> (n.level + 1)) * 2""",
    "roots": """
        select call_id, n_entries, list_reduce(list(hash order by level), lambda acc, h: sha256('1' || h || acc)) as root
        from tops group by call_id, n_entries""",
    "frames": """
        select label as call_id, row_number() over (partition by label order by vec_id) - 1 as frame_no, embedding
        from embeddings""",
    "samples": """
        select call_id, frame_no, unnest(embedding)::double as x,
               generate_subscripts(embedding, 1) - 1 as n
        from frames""",
    "dft": """
        select call_id, frame_no, b,
               sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * cos(2 * pi() * b * n / 64)) as re,
               -sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * sin(2 * pi() * b * n / 64)) as im
        from samples, (select unnest(range(0, 33)) as b) bins
        group by call_id, frame_no, b""",
    "spectrum": """
        select call_id, frame_no, b, (re * re + im * im) / 64 as power, atan2(im, re) as phase from dft""",
    "edges": """
        select i, 700 * (pow(10, (i * (2595 * log10(1 + 8000 / 700.0::double)) / 13) / 2595) - 1) as hz
        from (select unnest(range(0, 14)) as i)""",
    "bank": """
        select b, m.i - 1 as mel_bin,
               greatest(0, least((b * 250.0::double - lo.hz) / (m.hz - lo.hz),
                                 (hi.hz - b * 250.0::double) / (hi.hz - m.hz))) as w
        from (select unnest(range(0, 33)) as b) bins, edges m
        join edges lo on lo.i = m.i - 1 join edges hi on hi.i = m.i + 1""",
    "mel": """
        select call_id, frame_no, mel_bin, 10 * log10(greatest(sum(power * w), 1e-10)) as db
        from spectrum join bank using (b) group by call_id, frame_no, mel_bin""",
    "flux": """
        select a.call_id, a.frame_no, sqrt(sum((a.db - p.db) * (a.db - p.db))) as flux
        from mel a left join mel p
          on p.call_id = a.call_id and p.frame_no = a.frame_no - 1 and p.mel_bin = a.mel_bin
        group by a.call_id, a.frame_no""",
    "phase_dev": """
        select call_id, frame_no, avg(abs(d - 2 * pi() * round(d / (2 * pi())))) filter (usable) as phase_dev
        from (select a.call_id, a.frame_no, a.phase - p.phase - 2 * pi() * a.b as d,
                     a.b between 1 and 31 and a.power >= 1e-6 and p.power >= 1e-6 as usable
              from spectrum a left join spectrum p
                on p.call_id = a.call_id and p.frame_no = a.frame_no - 1 and p.b = a.b)
        group by call_id, frame_no""",
    "vocoder": """
        select call_id, frame_no, exp(avg(ln(p))) / avg(p) as flatness,
               sum(p) filter (b >= 16) / sum(p) as high_ratio,
               min(b) filter (upto >= 0.85::double * whole) * 250.0::double as rolloff_hz
        from (select call_id, frame_no, b, greatest(power, 1e-10) as p,
                     sum(greatest(power, 1e-10)) over (partition by call_id, frame_no order by b) as upto,
                     sum(greatest(power, 1e-10)) over (partition by call_id, frame_no) as whole
              from spectrum)
        group by call_id, frame_no""",
    "lags": """
        select a.call_id, a.frame_no, b.n - a.n as lag, sum(a.x * b.x) as r
        from samples a join samples b
          on a.call_id = b.call_id and a.frame_no = b.frame_no and b.n - a.n between 8 and 40
        group by a.call_id, a.frame_no, b.n - a.n""",
    "energy": """
        select call_id, frame_no, sum(x * x) as e, sqrt(sum(x * x) / 64) as rms, max(abs(x)) as peak
        from samples group by call_id, frame_no""",
    "contour": """
        select call_id, frame_no, rms, peak, case when strength >= 0.2 then 16000.0::double / lag end as f0,
               strength >= 0.2 as voiced
        from (select call_id, frame_no, rms, peak, lag, round(r / e, 9) as strength,
                     row_number() over (partition by call_id, frame_no order by round(r / e, 9) desc, lag) as pick
              from lags join energy using (call_id, frame_no))
        where pick = 1""",
    "steps": """
        select a.*, 1 / a.f0 as period, abs(1 / a.f0 - 1 / p.f0) as period_step,
               case when a.voiced and p.voiced then abs(a.peak - p.peak) end as peak_step,
               case when a.voiced then a.peak end as voiced_peak,
               coalesce(not a.voiced and p.voiced, false) as pause_start
        from contour a left join contour p on p.call_id = a.call_id and p.frame_no = a.frame_no - 1""",
    "prosody_windows": """
        select call_id, frame_no // 8 as window_no, avg(f0) as f0_mean, stddev_samp(f0) as f0_sd,
               max(f0) - min(f0) as f0_range, avg(voiced::int) as voiced_share,
               avg(period_step) / avg(period) as jitter, avg(peak_step) / avg(voiced_peak) as shimmer,
               avg(pause_start::int) as pause_rate
        from steps group by call_id, frame_no // 8""",
    "features": """
        select s.*, f0_mean, f0_sd, f0_range, voiced_share, jitter, shimmer, pause_rate
        from (select call_id, frame_no // 8 as window_no, avg(flux) as flux_mean, avg(flatness) as flatness_mean,
                     avg(high_ratio) as high_ratio_mean, avg(rolloff_hz) as rolloff_hz_mean,
                     avg(phase_dev) as phase_dev_mean
              from flux join vocoder using (call_id, frame_no) join phase_dev using (call_id, frame_no)
              group by call_id, frame_no // 8) s
        join prosody_windows p on p.call_id = s.call_id and p.window_no = s.window_no""",
    "scores": """
        select call_id, window_no, 1 / (1 + exp(-(
            -1.2 + 0.05 * coalesce(flux_mean, 0) - 4 * coalesce(flatness_mean, 0) + 2 * coalesce(high_ratio_mean, 0)
            + 0.5 * coalesce(phase_dev_mean, 0) + coalesce(voiced_share, 0) + 0.8 * coalesce(jitter, 0)
            + 0.6 * coalesce(shimmer, 0) - 1.5 * coalesce(pause_rate, 0)))) as spoof_prob
        from features""",
    "cells": """
        select m.call_id, m.frame_no // 8 as window_no, m.frame_no, m.mel_bin, db, (db - mean) / nullif(sd, 0) as z
        from mel m
        join (select mel_bin, avg(db) as mean, stddev_samp(db) as sd from mel group by mel_bin) using (mel_bin)
        join (select call_id, window_no from scores where spoof_prob >= 0.5) f
          on f.call_id = m.call_id and f.window_no = m.frame_no // 8""",
    "means": """
        select did, pos, avg(v) as v
        from (select 'did:key:' || label as did, unnest(embedding)::double as v,
                     generate_subscripts(embedding, 1) - 1 as pos from embeddings)
        group by did, pos""",
    "prints": """
        select did, pos, v / sqrt(sum(v * v) over (partition by did)) as v from means""",
    "hashes": """
        select did, sha256(string_agg(cast(round(v * 1000000) as bigint)::varchar, ',' order by pos)) as embedding_hash
        from prints group by did""",
    "probes": """
        select vec_id, 'did:key:' || label as claimed_did, unnest(embedding)::double as x,
               generate_subscripts(embedding, 1) - 1 as pos
        from embeddings""",
    "similarities": """
        select vec_id, claimed_did, did, sum(x * v) / (sqrt(sum(x * x)) * sqrt(sum(v * v))) as sim
        from probes join prints using (pos) group by vec_id, claimed_did, did""",
    "txns": """
        select event_id as txn_id, user_id as account_id, ts, value as amount
        from events where event_type = 'purchase'""",
    "flags": """
        select event_id, user_id as account_id, ts as verdict_ts, value from events where event_type = 'error'""",
    "confirmations": f"""
        select event_id, ts + to_seconds({K}) as confirmed_ts from events where {K} >= 10""",
    "truth": f"""
        select event_id as clip_id, case when event_type = 'error' then 'synthetic' else 'authentic' end as truth,
               case when event_type <> 'error' then null when {K} < 33 then 'gen_a' when {K} < 66 then 'gen_b'
                    else 'gen_c' end as generator
        from events""",
    "trials": """
        select t.*, v.risk_score, v.tier
        from truth t left join (select * from verdicts where event_type <> 'signup') v on v.seq = t.clip_id""",
    "sightings": """
        select sha256(event_type || '|' || k) as audio_hash, 'ref:' || seq as uri, (k + 44)::bigint as n_bytes,
               event_ts as first_seen, event_type
        from chunks""",
    "hop_windows": """
        select c.*, d.day - to_days(i) as window_start, d.day - to_days(i) + interval 2 days as window_end
        from chunks c, lateral (select date_trunc('day', c.event_ts) as day) d, (select unnest([0, 1]) as i)""",
    "sample_windows": """
        select call_id, (pos // 48 - i) * 3000 + 1704067200000000 as start_us, pos, x
        from (select call_id, frame_no * 64 + n as pos, x from samples), (select unnest([0, 1]) as i)""",
    "points": """
        select threshold, sum(p) over (order by threshold desc) / sum(p) over () as tpr,
               sum(n) over (order by threshold desc) / sum(n) over () as fpr
        from (select round(risk_score, 8) as threshold,
                     count(*) filter (truth = 'synthetic') as p, count(*) filter (truth = 'authentic') as n
              from trials where risk_score is not null group by 1)""",
}

RECURSIVE = {"chained", "nodes"}


def oracle(name: str, parts: str, statement: str, **replaced: str) -> None:
    names = parts.split()
    names = [n for n in names if n]
    head = ", ".join(f"{p} as ({replaced.get(p) or PARTS[p]})" for p in names)
    kind = "recursive " if RECURSIVE & set(names) else ""
    ORACLES[name] = f"with {kind}{head} {statement}" if names else statement


CHUNKS, VERDICTS = "chunks", "chunks verdicts"
ENTRIES = "chunks verdicts meta entries"
CHAIN = f"{ENTRIES} digested chained"
SPECTRUM = "frames samples dft spectrum"
MEL = f"{SPECTRUM} edges bank mel"
CONTOUR = "frames samples lags energy contour"
STEPS = f"{CONTOUR} steps"
FEATURES = f"{MEL} flux phase_dev vocoder lags energy contour steps prosody_windows features"
SCORES = f"{FEATURES} scores"
CELLS = f"{SCORES} cells"
TRIALS = "chunks verdicts truth trials"
LAST_TS = "(select max(event_ts) from chunks)"

# Sources and sinks
oracle("audio_clip_scan", "frames", """
    select 'call-' || call_id || '-' || (frame_no // 64) as clip, (44 + 2 * 64 * count(*))::bigint as n_bytes
    from frames group by call_id, frame_no // 64""")
oracle("pcm_unpack", "frames samples", """
    select 'call-' || call_id || '-' || (frame_no // 64) as clip, 16000 as sample_rate, count(*) as n_samples,
           ((count(*) - 1) // 1000 * 1000)::bigint as last_block, sum(q)::bigint as total, min(q) as low, max(q) as high
    from (select *, floor(x * 32767 + 0.5)::bigint as q from samples) group by call_id, frame_no // 64""")
ORACLES["clip_ranges"] = ORACLES["pcm_unpack"]
oracle("clip_verdicts", SCORES, """
    select call_id as clip, window_no, round(spoof_prob, 6) as spoof_prob,
           case when spoof_prob >= 0.7::double then 'HIGH' when spoof_prob >= 0.4::double then 'MEDIUM' else 'LOW' end as tier,
           case when spoof_prob >= 0.7::double then 'block' when spoof_prob >= 0.4::double then 'challenge'
                else 'normal' end as action, spoof_prob >= 0.7::double as freeze_txn
    from scores""", frames="""
    select 'call-' || label || '-' || (n // 64) as call_id, n % 64 as frame_no,
           list_transform(embedding, lambda v: floor(v::double * 32767 + 0.5) / 32768) as embedding
    from (select *, row_number() over (partition by label order by vec_id) - 1 as n from embeddings)""")
oracle("chunk_stream_source", CHUNKS, "select * from chunks")
oracle("chunk_dedup", CHUNKS, """
    select call_id, seq, event_ts, event_ts as ingest_ts, amplitude from chunks""")
oracle("chunk_dedup_stream", CHUNKS, "select call_id, seq, amplitude from chunks")
oracle("audit_append", CHAIN, "select call_id, seq, event_id, prev_hash, entry_hash from chained")
oracle("content_ref_append", "chunks sightings", """
    select audio_hash, arg_min(uri, first_seen) as uri, max(n_bytes) as n_bytes, min(first_seen) as first_seen
    from sightings where audio_hash not in (select audio_hash from sightings where event_type = 'view')
    group by audio_hash""")
oracle("enrollment_latest", CHUNKS, """
    select 'did:key:' || call_id as did, sha256(arg_max(k, event_ts)::varchar) as embedding_hash,
           max(event_ts) as registered_at
    from chunks where event_type = 'signup' group by call_id""")

# Framing and windows
oracle("frame_samples", "", """
    select vec_id, s as sub_frame, s * 8 as "offset", 16::bigint as n,
           round(embedding[s * 8 + 1]::double, 6) as first_sample,
           round(list_sum(list_transform(embedding[s * 8 + 1 : s * 8 + 16], lambda v: v::double)), 6) as total
    from embeddings, (select unnest(range(0, 7)) as s)""")
WINDOW_AGGS = """count(*) as n_chunks, round(avg(spoof_prob), 10) as mean_prob, max(amplitude) as max_amplitude,
    window_start, window_end"""
oracle("sliding_window_agg", "chunks hop_windows", f"""
    select call_id, {WINDOW_AGGS} from hop_windows group by call_id, window_start, window_end""")
oracle("sliding_window_stream", "chunks hop_windows", f"""
    select call_id, {WINDOW_AGGS} from hop_windows where window_end <= {LAST_TS} - interval 1 day
    group by call_id, window_start, window_end""")
SAMPLE_AGGS = """count(*) as n, count(*) = 96 as complete, round(sum(x), 6) as total,
    round(arg_min(x, pos), 6) as first_sample, round(arg_max(x, pos), 6) as last_sample"""
oracle("cross_chunk_windows", "frames samples sample_windows", f"""
    select call_id, start_us, {SAMPLE_AGGS} from sample_windows group by call_id, start_us""")
oracle("cross_chunk_windows_stream", "frames samples sample_windows", f"""
    select call_id, start_us, {SAMPLE_AGGS} from sample_windows
    where start_us - 1704067200000000 + 6000 <= (select max(pos // 48 * 3) - 12 from (select frame_no * 64 + n as pos from samples)) * 1000
    group by call_id, start_us""")
oracle("chunk_gap_check", CHUNKS, """
    select call_id, event_ts, seq, step, case when step > 1 then 'missing' else 'disorder' end as problem
    from (select call_id, event_ts, k::bigint as seq,
                 (k - lag(k) over (partition by call_id order by event_ts, k))::bigint as step from chunks)
    where step <> 1""")

# Spectral features
oracle("power_spectrum", SPECTRUM, """
    select call_id, frame_no, b as freq_bin, round(power, 7) as power from spectrum""")
oracle("mel_spectrogram", MEL, "select call_id, frame_no, mel_bin, round(db, 5) as db from mel")
oracle("mel_irregularity", f"{MEL} flux", """
    select call_id, frame_no, round(flux, 5) as flux,
           round((flux - avg(flux) over (partition by call_id))
                 / nullif(stddev_samp(flux) over (partition by call_id), 0), 5) as flux_z
    from flux""")
oracle("phase_deviation", f"{SPECTRUM} phase_dev", """
    select call_id, frame_no, round(phase_dev, 5) as phase_dev from phase_dev""")
oracle("vocoder_artifacts", f"{SPECTRUM} vocoder", """
    select call_id, frame_no, round(flatness, 6) as flatness, round(high_ratio, 6) as high_ratio,
           round(rolloff_hz, 6) as rolloff_hz from vocoder""")

# Prosody
oracle("f0_contour", CONTOUR, """
    select call_id, frame_no, round(rms, 6) as rms, round(peak, 6) as peak, round(f0, 6) as f0, voiced from contour""")
oracle("jitter", STEPS, """
    select call_id, round(avg(period_step) / avg(period), 6) as jitter from steps group by call_id""")
oracle("shimmer", STEPS, """
    select call_id, round(avg(peak_step) / avg(voiced_peak), 6) as shimmer from steps group by call_id""")
oracle("micro_pauses", CHUNKS, """
    select call_id, min(event_ts) as pause_start, max(event_ts) as pause_end, count(*) as n_chunks
    from (select *, row_number() over (partition by call_id order by event_ts, seq)
                  - row_number() over (partition by call_id, amplitude < 20 order by event_ts, seq) as run from chunks)
    where amplitude < 20 group by call_id, run having count(*) >= 2""")
RUNS = """
    select call_id, min(event_ts) as run_start, max(event_ts) + interval 12 hours as run_end, count(*) as n_chunks
    from (select call_id, event_ts, sum(opens) over (partition by call_id order by event_ts, seq) as run
          from (select call_id, event_ts, seq,
                       coalesce(event_ts - lag(event_ts) over (partition by call_id order by event_ts, seq)
                                >= interval 12 hours, true)::int as opens
                from chunks where amplitude >= 20))
    group by call_id, run"""
oracle("speech_runs", CHUNKS, RUNS)
oracle("speech_runs_stream", CHUNKS, f"""
    select * from ({RUNS}) where run_end <= (select max(event_ts) from chunks where amplitude >= 20) - interval 1 day""")
oracle("prosody_summary", f"{STEPS} prosody_windows", """
    select call_id, window_no, round(f0_mean, 5) as f0_mean, round(f0_sd, 5) as f0_sd, round(f0_range, 5) as f0_range,
           round(voiced_share, 5) as voiced_share, round(jitter, 5) as jitter, round(shimmer, 5) as shimmer,
           round(pause_rate, 5) as pause_rate from prosody_windows""")

# Detection
FEATURE_NAMES = (
    "flux_mean flatness_mean high_ratio_mean rolloff_hz_mean phase_dev_mean "
    "f0_mean f0_sd f0_range voiced_share jitter shimmer pause_rate").split()
oracle("feature_assembly", FEATURES, "select call_id, window_no, " + ", ".join(
    f"round({n}, 5) as {n}" for n in FEATURE_NAMES) + " from features")
oracle("spoof_score", SCORES, "select call_id, window_no, round(spoof_prob, 6) as spoof_prob from scores")
oracle("spoof_score_batch", SCORES, "select call_id, window_no, round(spoof_prob, 6) as spoof_prob from scores")
oracle("call_spoof_rollup", CHUNKS, """
    select call_id, max(spoof_prob) as max_prob, round(avg(spoof_prob), 12) as mean_prob,
           arg_max(spoof_prob, event_ts) as latest_prob,
           round(sum(spoof_prob * w) / sum(w), 6) as decayed_prob, count(*) as n_windows
    from (select *, pow(0.5::double, (epoch_us(max(event_ts) over (partition by call_id)) - epoch_us(event_ts))
                        / 86400e6) as w from chunks)
    group by call_id""")

# Identity
oracle("enroll_voiceprint", "means prints", "select did, pos, round(v, 6) as value from prints")
oracle("hash_voiceprint", "means prints hashes", "select did, embedding_hash from hashes")
oracle("verify_claimed", "means prints probes similarities", """
    select claimed_did, vec_id, round(sim, 6) as speaker_sim, sim < 0.15 as mismatch
    from similarities where did = claimed_did""")
oracle("identify_topk", "means prints probes similarities", """
    select vec_id, did, similarity, rank
    from (select vec_id, did, round(sim, 6) as similarity,
                 row_number() over (partition by vec_id order by round(sim, 6) desc, did) as rank from similarities)
    where rank <= 3""")
oracle("registry_integrity", "means prints hashes", """
    select did, embedding_hash, case when did = 'did:key:9' then 'unregistered' else 'altered' end as problem
    from hashes where did in ('did:key:9', 'did:key:3')""")
oracle("resolve_caller", "chunks meta", """
    select c.call_id, c.seq, m.did as caller_did, m.did is not null as resolved
    from chunks c left join meta m on m.call_id = c.call_id""")
oracle("unresolved_caller", "chunks meta", """
    select call_id, seq from chunks where call_id not in (select call_id from meta where did is not null)""")

# Risk
oracle("context_enrich", "chunks meta", """
    select c.call_id, seq, spoof_prob, speaker_sim, did, c_mktsegment, speaker_sim < 0.5 as mismatch
    from chunks c left join meta m on m.call_id = c.call_id""")
oracle("risk_score", "chunks meta", """
    select c.call_id, seq, round(case
        when did is null then (spoof_prob * 0.6 + poor * 0.15) / (0.6 + 0.15)
        else spoof_prob * 0.6 + (1 - speaker_sim) * 0.25 + poor * 0.15 end, 8) as risk_score
    from chunks c left join (select *, case when c_acctbal < 1000 then 1.0::double else 0.0::double end as poor from meta) m
      on m.call_id = c.call_id""")
oracle("risk_tier", VERDICTS, "select call_id, tier, count(*) as n from verdicts group by call_id, tier")
oracle("tier_action", VERDICTS, """
    select call_id, seq, tier, case tier when 'LOW' then 'normal' when 'MEDIUM' then 'challenge' else 'block' end as action,
           tier <> 'LOW' as warn, tier = 'HIGH' as block, tier = 'HIGH' as freeze_txn from verdicts""")
STATUS = """
    select call_id, event_ts, round(risk_score, 8) as risk_score, tier,
           case tier when 'LOW' then 'normal' when 'MEDIUM' then 'challenge' else 'block' end as action
    from (select *, row_number() over (partition by call_id order by event_ts desc, seq desc) as age from verdicts)
    where age = 1"""
oracle("call_status", VERDICTS, STATUS)
oracle("call_status_stream", VERDICTS, STATUS)
EDGES = """
    select call_id, event_ts, event_id, from_tier, tier as to_tier
    from (select *, lag(tier) over (partition by call_id order by event_ts, event_id) as from_tier from verdicts)
    where from_tier is distinct from tier"""
oracle("tier_transition", VERDICTS, EDGES)
oracle("tier_transition_stream", VERDICTS, f"""
    select * from ({EDGES}) where date_trunc('hour', event_ts) + interval 1 hour <= {LAST_TS} - interval 1 day""")
oracle("challenge_queue", VERDICTS, f"""
    select call_id, event_ts, risk_score from ({STATUS}) where tier = 'MEDIUM'""")

# Transaction guard
oracle("txn_hold", "txns flags", """
    select txn_id, account_id, ts, amount, verdict_id, verdict_ts, value, 'high_risk_call' as reason
    from (select t.*, f.event_id as verdict_id, f.verdict_ts, f.value,
                 row_number() over (partition by txn_id order by verdict_ts desc, f.event_id desc) as age
          from txns t join flags f
            on f.account_id = t.account_id and f.value >= 100
           and f.verdict_ts between t.ts - interval 1 day and t.ts)
    where age = 1""")
oracle("txn_hold_stream", "txns flags", """
    select * from txns t where exists (
        select 1 from flags f where f.account_id = t.account_id and f.value >= 100
           and f.verdict_ts between t.ts - interval 1 day and t.ts)""")
oracle("txn_asof_verdict", "txns flags", """
    select t.*, f.event_id as verdict_id, f.verdict_ts, f.value
    from txns t asof left join flags f on f.account_id = t.account_id and f.verdict_ts <= t.ts""")

# Audit and provenance
oracle("audit_record", ENTRIES, "select * from entries")
oracle("audit_chain", CHAIN, "select call_id, seq, event_id, prev_hash, entry_hash from chained")
oracle("audit_seal", f"{CHAIN} ", """
    , l0 as (select call_id, (seq - 1) // 256 as node, count(*) as n, arg_max(entry_hash, seq) as h
             from chained group by 1, 2),
    l1 as (select call_id, node // 256 as node, sum(n) as n, sha256(string_agg(h, '' order by node)) as h from l0 group by 1, 2),
    l2 as (select call_id, node // 256 as node, sum(n) as n, sha256(string_agg(h, '' order by node)) as h from l1 group by 1, 2),
    l3 as (select call_id, node // 256 as node, sum(n) as n, sha256(string_agg(h, '' order by node)) as h from l2 group by 1, 2)
    select call_id, sum(n)::bigint as n_entries, sha256(string_agg(h, '' order by node)) as seal from l3 group by call_id""")
oracle("audit_verify", CHAIN, """
    select e.call_id, count(*) as n_entries, count(*) filter (spoof_prob >= 0.99) as n_broken,
           min(e.seq) filter (spoof_prob >= 0.99) as first_broken_seq,
           case when count(*) filter (spoof_prob >= 0.99) > 0 then 'altered' end as reason
    from digested e join chained c on c.call_id = e.call_id and c.seq = e.seq group by e.call_id""")
TREE = f"{ENTRIES} digested nodes lengths cuts tops roots"
oracle("audit_root", TREE, "select r.* from roots r join lengths l on l.call_id = r.call_id and l.n_entries = r.n_entries")
oracle("audit_inclusion", TREE, """
    select d.call_id, d.seq, (t.level + (select count(*) from tops o where o.call_id = d.call_id and o.n_entries = l.n_entries) - 1)::bigint as n_hashes, root
    from digested d join lengths l on l.call_id = d.call_id
    join roots r on r.call_id = d.call_id and r.n_entries = l.n_entries
    join tops t on t.call_id = d.call_id and t.n_entries = l.n_entries
         and (d.seq - 1) >> t.level = (l.n_entries >> (t.level + 1)) * 2""")
oracle("audit_consistency", TREE, """
    select l.call_id, o.n_entries as old_entries, l.n_entries, o.root as old_root, r.root
    from lengths l join roots r on r.call_id = l.call_id and r.n_entries = l.n_entries
    join roots o on o.call_id = l.call_id and o.n_entries = ceil(l.n_entries * 2 / 3)::bigint""")
oracle("audit_kept_roots", ENTRIES, """
    select call_id, count(*)::bigint as n_entries,
           case when count(*) % 5 = 0 then 'cut' when max(spoof_prob) >= 0.99 then 'rewritten' end as problem
    from entries group by call_id""")
oracle("audit_query", ENTRIES, """
    select * from entries
    where tier = 'HIGH' and event_ts >= timestamp '2024-01-10' and event_ts < timestamp '2024-01-20'
      and (event_ts < timestamp '2024-01-19 12:00:00'
           or (event_ts = timestamp '2024-01-19 12:00:00' and event_id < 1099511627776))
    order by event_ts desc, event_id desc limit 100""")
oracle("audit_feed", ENTRIES, "select * from entries order by event_ts desc, event_id desc limit 50")
oracle("audit_reconcile", f"{VERDICTS} confirmations", """
    select event_id, call_id, case when event_type = 'signup' then 'no_entry' else 'unconfirmed' end as reason
    from verdicts where tier = 'HIGH'
      and (event_type = 'signup' or event_id not in (select event_id from confirmations))""")
oracle("content_ref_check", "chunks sightings", """
    select audio_hash, count(*) filter (event_type <> 'view') as n_entries,
           case when any_value(event_type) = 'click' then 'dangling' else 'orphan' end as problem
    from sightings where event_type in ('click', 'view') group by audio_hash""")

# Explainability
oracle("anomaly_cells", CELLS, """
    select call_id, window_no, frame_no, mel_bin, round(db, 5) as db, round(z, 5) as z from cells""")
oracle("heatmap_grid", CELLS, "select call_id, frame_no, " + ", ".join(
    f"round(coalesce(max(z) filter (mel_bin = {b}), 0), 5) as band_{b}" for b in range(12))
    + " from cells where abs(z) >= 1 group by call_id, frame_no")
oracle("suspicious_topk", CELLS, """
    select * from (select call_id, window_no, frame_no, mel_bin, round(z, 5) as z,
                          row_number() over (partition by call_id, window_no
                                             order by abs(round(z, 5)) desc, frame_no, mel_bin) as rank from cells)
    where rank <= 5""")

# Trials
oracle("trial_join", TRIALS, """
    select clip_id, truth, generator, round(risk_score, 8) as risk_score, tier from trials""")
oracle("confusion_by_generator", TRIALS, """
    select *, round(fp / nullif(fp + tn, 0), 6) as false_reject_rate, round(fn / nullif(fn + tp, 0), 6) as false_accept_rate
    from (select case when grouping(g) = 1 then 'ALL' else g end as generator,
                 count(*) filter (truth = 'synthetic' and risk_score >= 0.5) as tp,
                 count(*) filter (truth = 'synthetic' and risk_score < 0.5) as fn,
                 count(*) filter (truth = 'authentic' and risk_score >= 0.5) as fp,
                 count(*) filter (truth = 'authentic' and risk_score < 0.5) as tn,
                 count(*) filter (risk_score is null) as unscored
          from (select *, coalesce(generator, 'authentic') as g from trials) group by grouping sets ((g), ()))""")
oracle("roc_points", f"{TRIALS} points", """
    select threshold, round(tpr, 6) as tpr, round(fpr, 6) as fpr from points""")
oracle("roc_eer", f"{TRIALS} points", """
    select round(sum((fpr - coalesce(fpr0, 0)) * (tpr + coalesce(tpr0, 0)) / 2), 6) as auc,
           first(threshold order by round(abs(fpr - (1 - tpr)), 9), threshold) as eer_threshold,
           round(first((fpr + 1 - tpr) / 2 order by round(abs(fpr - (1 - tpr)), 9), threshold), 6) as eer
    from (select *, lag(fpr) over (order by threshold desc) as fpr0, lag(tpr) over (order by threshold desc) as tpr0
          from points)""")
RATIO = "(1.01::double / 0.99::double)"
ESTIMATES = ", ".join(f"""round(coalesce(min(cell) filter (upto >= greatest(1, ceil(whole * {p / 100}::double)) and cell = 0),
    pow({RATIO}, min(cell) filter (upto >= greatest(1, ceil(whole * {p / 100}::double))) - 1) * 2 / (1 + {RATIO})), 6) as p{p}"""
                      for p in (50, 95, 99))
oracle("latency_sketches", CHUNKS, f"""
    select month, max(whole)::bigint as n, round(sum(total) / max(whole), 6) as mean, {ESTIMATES}
    from (select *, sum(n) over (partition by month order by cell) as upto, sum(n) over (partition by month) as whole
          from (select date_trunc('month', event_ts)::date as month,
                       case when k = 0 then 0 else ceil(ln(k * 1000.0::double) / ln({RATIO})) + 1 end as cell,
                       count(*) as n, sum(k * 1000) as total
                from chunks group by 1, 2))
    group by month""")
PCT = ", ".join(f"quantile_cont(ms, {p / 100}) as p{p}_ms" for p in (50, 95, 99))
oracle("latency_report", CHUNKS, f"""
    select count(*) as n_verdicts, {PCT}, round(avg((ms <= 60000)::int), 6) as within_budget,
           round(sum(ms) / (count(*) * 3000), 6) as real_time_factor
    from (select k * 1000 as ms from chunks)""")
oracle("confirm_delay", f"{VERDICTS} confirmations", f"""
    select count(*) as n_high, count(*) filter (ms is null) as unconfirmed, {PCT},
           count(*) filter (ms is null or ms > 60000) as breaches
    from (select (epoch_us(confirmed_ts) - epoch_us(event_ts)) // 1000 as ms
          from verdicts left join confirmations using (event_id) where tier = 'HIGH')""")

# The main path
FLAGGED = """
    , w as (select call_id, window_start, window_end, avg(spoof_prob) as spoof_prob, avg(speaker_sim) as speaker_sim,
                   max(sha256(call_id || '|' || seq || '|' || cast(round(amplitude * 100) as bigint))) as audio_hash
            from hop_windows group by call_id, window_start, window_end),
    v as (select *, case when risk >= 0.7 then 'HIGH' when risk >= 0.4 then 'MEDIUM' else 'LOW' end as tier
          from (select *, spoof_prob * 0.7::double + (1 - speaker_sim) * 0.3::double as risk from w))
    select sha256(v.call_id || '|' || epoch_us(window_start)) as event_id, v.call_id, did as caller_did, audio_hash,
           round(spoof_prob, 10) as spoof_prob, tier, window_end as event_ts
    from v left join meta m on m.call_id = v.call_id where tier in ('MEDIUM', 'HIGH')"""
oracle("flagged_windows", "chunks hop_windows meta", FLAGGED)
oracle("flagged_windows_stream", "chunks hop_windows meta", FLAGGED)
oracle("live_holds_stream", "chunks hop_windows txns", """
    , w as (select call_id, window_start, window_end, avg(spoof_prob) * 0.7::double + (1 - avg(speaker_sim)) * 0.3::double as risk
            from hop_windows group by call_id, window_start, window_end)
    select txn_id, account_id, ts, amount, sha256(call_id || '|' || epoch_us(window_start)) as verdict_id, window_end as verdict_ts,
           round(risk, 6) as risk_score, 'high_risk_call' as reason
    from (select t.*, w.*, row_number() over (partition by txn_id order by window_end desc) as age
          from txns t join w on w.call_id = t.account_id and w.risk >= 0.7 and w.window_end between t.ts - interval 1 day and t.ts)
    where age = 1""")
oracle("tier_transition_live", VERDICTS, EDGES)
oracle("call_status_live", VERDICTS, STATUS)
oracle("confirmations_live", f"{VERDICTS} confirmations", """
    select v.event_id, v.call_id, v.event_ts, (epoch_us(c.confirmed_ts) - epoch_us(v.event_ts)) // 1000 as delay_ms
    from verdicts v left join confirmations c on c.event_id = v.event_id where v.tier = 'HIGH'""")
