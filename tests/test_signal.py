"""Properties of framing, spectral and prosodic operators on known signals."""

import math

import pytest
from pyspark.sql import functions as F

from timbrewatch.config import FrameSpec
from timbrewatch.operators import detect, prosody, spectral, windows
from timbrewatch.sources.chunks import dedup_chunks

SPEC = FrameSpec()


def tone(spark, hz, n, rate=16_000, call="c"):
    at = F.sequence(F.lit(0), F.lit(n - 1))
    wave = F.transform(at, lambda i: F.sin(i * (2 * math.pi * hz / rate)))
    return spark.range(1).select(F.lit(call).alias("call_id"), wave.alias("samples"))


def tone_frames(spark, hz, n=8000):
    return windows.frames(tone(spark, hz, n), SPEC.length, SPEC.hop).withColumnRenamed("sub_frame", "frame_no")


def test_frame_count_and_content(spark):
    rows = windows.frames(spark.sql("select array(1,2,3,4,5) as samples"), 3, 2).collect()
    assert [(r["offset"], r["samples"]) for r in rows] == [(0, [1, 2, 3]), (2, [3, 4, 5])]
    assert windows.frames(spark.sql("select array(1,2) as samples"), 3, 2).count() == 0


@pytest.mark.parametrize("hz", [200.0, 1000.0, 4000.0])
def test_spectrum_peaks_at_the_tone(spark, hz):
    powers = [r["power"] for r in spectral.power_spectrum(tone_frames(spark, hz)).collect()]
    assert {p.index(max(p)) for p in powers} == {round(hz / SPEC.bin_hz(1))}


def test_parseval(spark):
    frames = tone_frames(spark, 777.0)
    power = spectral.power_spectrum(frames, taper=False).orderBy("frame_no").first()["power"]
    energy = sum(x * x for x in frames.orderBy("frame_no").first()["samples"])
    assert power[0] + power[-1] + 2 * sum(power[1:-1]) == pytest.approx(energy)


def test_steady_tone_keeps_its_phase(spark):
    # The floor leaves the tone's own bin and not those it leaks into.
    spectrum = spectral.power_spectrum(tone_frames(spark, 1000.0))
    values = [r["phase_dev"] for r in spectral.phase_deviation(spectrum, SPEC, floor=10.0).collect()]
    assert values.count(None) == 1 and max(v for v in values if v is not None) < 1e-6


def test_noise_is_flatter_than_a_tone(spark):
    noise = spark.range(1).select(F.lit("n").alias("call_id"), F.transform(
        F.sequence(F.lit(0), F.lit(3999)), lambda i: F.pmod(F.xxhash64(i), F.lit(1000)) / 500.0 - 1).alias("samples"))
    frames = windows.frames(noise, SPEC.length, SPEC.hop).withColumnRenamed("sub_frame", "frame_no")
    rough = spectral.vocoder_artifacts(spectral.power_spectrum(frames), SPEC).agg(F.min("flatness")).first()[0]
    pure = spectral.vocoder_artifacts(spectral.power_spectrum(tone_frames(spark, 500.0)), SPEC)
    assert rough > 0.2 > pure.agg(F.max("flatness")).first()[0]


@pytest.mark.parametrize("hz", [100.0, 200.0, 320.0])
def test_pitch_of_a_tone(spark, hz):
    rows = prosody.f0_contour(tone_frames(spark, hz), SPEC).collect()
    assert all(r["voiced"] and abs(r["f0"] - hz) / hz < 0.02 for r in rows)


def test_silence_is_unvoiced(spark):
    silent = spark.range(1).select(F.lit("s").alias("call_id"), F.array_repeat(F.lit(0.0), 1000).alias("samples"))
    frames = windows.frames(silent, SPEC.length, SPEC.hop).withColumnRenamed("sub_frame", "frame_no")
    assert all(not r["voiced"] and r["f0"] is None for r in prosody.f0_contour(frames, SPEC).collect())


def test_constant_period_has_no_jitter_or_shimmer(spark):
    contour = prosody.f0_contour(tone_frames(spark, 200.0), SPEC)
    assert prosody.jitter(contour).first()["jitter"] == 0.0
    assert prosody.shimmer(contour).first()["shimmer"] < 1e-3


def test_pauses_of_a_known_pattern(spark):
    # Speech 5, silence 3, speech 4, silence 1, speech 2; segments of two seconds split every run.
    levels = [30.0] * 5 + [1.0] * 3 + [30.0] * 4 + [1.0] + [30.0] * 2
    rows = spark.createDataFrame([("c", i, v) for i, v in enumerate(levels)], "call_id string, seq bigint, amplitude double")
    rows = rows.withColumn("event_ts", F.timestamp_seconds("seq"))
    found = prosody.micro_pauses(rows, 20.0, 2, segment_seconds=2).collect()
    assert [(r["pause_start"].second, r["pause_end"].second, r["n_chunks"]) for r in found] == [(5, 7, 3)]


def chunked(spark, pieces):
    rows = [("c", i, start, data) for i, (start, data) in enumerate(pieces)]
    return spark.createDataFrame(rows, "call_id string, seq bigint, us bigint, samples array<double>").select(
        "call_id", "seq", F.timestamp_micros("us").alias("event_ts"), F.timestamp_micros("us").alias("ingest_ts"),
        F.lit(1000).alias("sample_rate"), "samples")


def test_windows_cross_chunk_borders(spark):
    signal = [float(i) for i in range(40)]
    cuts = [0, 7, 9, 26, 40]
    pieces = [(a * 1000, signal[a:b]) for a, b in zip(cuts, cuts[1:])]
    chunks = chunked(spark, pieces + pieces[:2])  # two chunks arrive again
    chunks = dedup_chunks(chunks.withColumn("seq", F.unix_micros("event_ts")))
    got = windows.window_chunks(chunks, 20, 10).where("complete").orderBy("window_start").collect()
    assert [r["samples"] for r in got] == [signal[i:i + 20] for i in (0, 10, 20)]


def test_fractional_cells_keep_the_clock(spark):
    rate, day = 22_050, 1_704_067_200
    rows = spark.createDataFrame([("c", day * 10**6, rate, [float(i) for i in range(rate)])],
                                 "call_id string, us bigint, sample_rate int, samples array<double>")
    chunks = rows.withColumn("event_ts", F.timestamp_micros("us")).drop("us")
    got = windows.window_chunks(chunks, 20, 10).where("complete").orderBy("window_start").collect()
    assert len(got) == 99 and [r["samples"][0] for r in got] == [float(i * 441 // 2) for i in range(99)]
    assert got[-1]["samples"][-1] == rate - 1


def test_overlap_does_not_hide_a_hole(spark):
    signal = [float(i) for i in range(20)]
    torn = chunked(spark, [(0, signal[:10]), (5_000, signal[5:10]), (15_000, signal[15:])])
    row = windows.window_chunks(torn, 20, 20).first()
    assert not row["complete"] and row["samples"] == signal[:10] + signal[15:]
    twice = chunked(spark, [(0, signal[:10]), (5_000, signal[5:])])
    row = windows.window_chunks(twice, 20, 20).first()
    assert row["complete"] and row["samples"] == signal


def test_ragged_frames_are_refused():
    import pyarrow as pa

    from timbrewatch.functions.spectral import matrix

    with pytest.raises(ValueError):
        matrix(pa.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0, 8.0]]))


def test_missing_chunk_leaves_windows_incomplete(spark):
    signal = [float(i) for i in range(40)]
    chunks = chunked(spark, [(0, signal[:12]), (15_000, signal[15:40])])
    got = windows.window_chunks(chunks, 10, 10).orderBy("window_start").collect()
    assert [r["complete"] for r in got] == [True, False, True, True]


def test_gap_check(spark):
    rows = spark.createDataFrame([("c", t, s) for t, s in enumerate([1, 2, 5, 4, 4, 5])], "call_id string, t bigint, seq bigint")
    found = windows.gaps(rows.withColumn("event_ts", F.timestamp_seconds("t")), 2).orderBy("t").collect()
    assert [(r["t"], r["step"], r["problem"]) for r in found] == [
        (2, 3, "missing"), (3, -1, "disorder"), (4, 0, "disorder")]


def test_decayed_mean_halves(spark):
    scores = spark.createDataFrame([("c", 0, 1.0), ("c", 3600, 0.0)], "call_id string, s bigint, spoof_prob double")
    row = detect.call_spoof_rollup(scores.withColumn("window_end", F.timestamp_seconds("s")), 3600, segment_seconds=60).first()
    assert row["decayed_prob"] == pytest.approx(1 / 3) and row["latest_prob"] == 0.0 and row["mean_prob"] == 0.5
