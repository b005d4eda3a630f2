"""Clips of any length in byte ranges, and frame measures without spectra in a shuffle."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows_of
from timbrewatch.catalog.queries import QUERIES
from timbrewatch.config import FrameSpec
from timbrewatch.operators import linked, spectral
from timbrewatch.sources import wav

SPEC = FrameSpec(sample_rate=8000, length=64, hop=24, n_mels=8, fmin=200.0, fmax=1000.0, voicing=0.2)


def riff(pcm, rate=8000, fmt=None, before=b"", declared=None, mark=b"RIFF", after=b""):
    body = pcm.astype("<i2").tobytes()
    fmt = fmt or struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    data = b"data" + struct.pack("<I", len(body) if declared is None else declared) + body
    inner = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + data + after
    return mark + struct.pack("<I", min(len(inner), 0xFFFFFFFF)) + inner


def header(content):
    return wav.read_header(lambda at, n: content[at: at + n], len(content), 16000)


def noise(n, seed=1):
    return (np.sin(np.arange(n) / 5.0) * 9000 + np.random.default_rng(seed).integers(-3000, 3000, n)).astype(np.int16)


def test_headers():
    pcm = noise(11)
    assert header(riff(pcm)) == wav.Header(8000, 44, 11)
    assert header(riff(pcm, before=b"LIST" + struct.pack("<I", 3) + b"abc\0")).data_at == 56
    assert header(riff(pcm, after=b"LIST" + struct.pack("<I", 2) + b"ab")).n_samples == 11
    assert header(riff(pcm, declared=0xFFFFFFFF)).n_samples == header(riff(pcm, declared=9999)).n_samples == 11
    assert header(riff(pcm, declared=0)).n_samples == 0
    long = b"ds64" + struct.pack("<IQQQI", 28, 0, 22, 11, 0)
    assert header(riff(pcm, declared=0xFFFFFFFF, before=long, mark=b"RF64", after=b"more")).n_samples == 11
    extensible = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 4) + struct.pack("<H", 1) + b"\0" * 14
    assert header(riff(pcm, fmt=extensible)).n_samples == 11
    assert header(pcm.tobytes() + b"\x01") == wav.Header(16000, 0, 11) and header(b"") == wav.Header(16000, 0, 0)
    for bad in (riff(pcm, fmt=struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)), riff(pcm)[:36]):
        with pytest.raises(ValueError):
            header(bad)


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("clips")
    sizes = {"a": 5000, "b": 0, "c": 63, "d": 64, "e": 65, "f": 1441}
    pcm = {name: noise(n, n) for name, n in sizes.items()}
    (folder / "deep").mkdir()
    for name, x in pcm.items():
        place = folder / "deep" if name == "f" else folder
        (place / f"{name}.wav").write_bytes(riff(x, before=b"junk" + struct.pack("<I", 300) + b"\0" * 300 if name == "a" else b""))
    (folder / "_left.wav").write_bytes(b"not read")
    (folder / "notes.txt").write_text("not read")
    return str(folder), pcm


@pytest.mark.parametrize("split", [37, 500, 1 << 20])
def test_blocks_are_owned_once_however_files_are_cut(spark, clips, split):
    folder, pcm = clips
    rows = wav.read_blocks(spark, folder, 100, before=30, after=7, split_bytes=split).collect()
    names = [(r["clip"].rsplit("/", 1)[1][0], r["start_sample"]) for r in rows]
    assert sorted(names) == [(n, s) for n, x in pcm.items() for s in range(0, len(x), 100)]
    for (name, start), r in zip(names, rows):
        assert r["lead"] == min(start, 30)
        assert r["samples"] == pcm[name][start - r["lead"]: start + 107].tolist()


def test_small_files_share_a_part_and_long_ones_are_cut(clips):
    folder, pcm = clips
    whole = wav.BlockReader({"path": folder}).partitions()
    assert len(whole) == 1 and len(whole[0].ranges) == len(pcm)
    cut = wav.BlockReader({"path": f"{folder}/a.wav", "split_bytes": "1000"}).partitions()
    assert [p.ranges[0][2:] for p in cut][:2] == [(0, 1000), (1000, 2000)] and len(cut) == -(-(10000 + 352) // 1000)


def test_clip_above_two_gigabytes_is_read_in_parts(tmp_path):
    """A sparse file of 3 GB: parts around the 2 GB mark hold their samples, and the parts together every block."""
    path, n, block = tmp_path / "long.wav", 1_600_000_000, 1_000_000
    with open(path, "wb") as f:
        f.write(riff(np.zeros(0), declared=2 * n))
        f.truncate(44 + 2 * n)
        mark = (1 << 30) + 5
        f.seek(44 + 2 * mark)
        f.write(struct.pack("<h", 1234))
    reader = wav.BlockReader({"path": str(path), "block": str(block), "before": "10", "split_bytes": str(64 << 20)})
    parts = reader.partitions()
    assert len(parts) == 48
    around = [p for p in parts if p.ranges[0][2] <= 44 + 2 * mark < p.ranges[0][3] + 2 * block]
    seen = {}
    for p in [*around, parts[-1]]:
        for batch in reader.read(p):
            for r in batch.select(["start_sample", "lead"]).to_pylist():
                assert r["start_sample"] not in seen
                seen[r["start_sample"]] = r["lead"]
            values = batch["samples"].values.to_numpy()
            for at in np.flatnonzero(values):
                row = np.searchsorted(batch["samples"].offsets.to_numpy(), at, "right") - 1
                start = batch["start_sample"][row].as_py() - batch["lead"][row].as_py()
                assert (start + at - batch["samples"].offsets[row].as_py(), values[at]) == (mark, 1234)
                seen["mark"] = True
    assert seen.pop("mark") and max(seen) == n - block and mark // block * block in seen


def frames_of(pcm, spec):
    return [(name, k, (x[k * spec.hop: k * spec.hop + spec.length] / 32768.0).tolist())
            for name, x in pcm.items() for k in range((len(x) - spec.length) // spec.hop + 1)]


@pytest.mark.parametrize("frames", [1, 7, 1000])
def test_frames_of_blocks_equal_frames_of_whole_clips(spark, clips, monkeypatch, frames):
    folder, pcm = clips
    monkeypatch.setattr(linked, "FRAMES_PER_BATCH", 5)
    got = linked.measure_blocks(wav.read_frame_blocks(spark, folder, SPEC, frames, split_bytes=700), SPEC)
    got = got.withColumn("call_id", F.regexp_extract("clip", r"(\w)\.wav$", 1)).drop("clip")
    rows = spark.createDataFrame(frames_of(pcm, SPEC), "call_id string, frame_no bigint, samples array<double>")
    monkeypatch.setattr(linked, "FRAMES_PER_SEGMENT", 8)
    want = linked.measure_frames(rows, SPEC)
    # Matrix products of other shapes differ in their last digits.
    near = lambda v: round(v, 8) if isinstance(v, float) else [near(x) for x in v] if isinstance(v, (list, tuple)) else v
    assert near(rows_of(got, *want.columns)) == near(rows_of(want, *want.columns))


def test_measures_equal_the_separate_operators_across_segments_and_holes(spark, clips, monkeypatch):
    monkeypatch.setattr(linked, "FRAMES_PER_SEGMENT", 4)
    rows = [(None if n == "f" else n, k, x) for n, k, x in frames_of(clips[1], SPEC) if k not in (6, 12, 13)]
    frames = spark.createDataFrame(rows, "call_id string, frame_no bigint, samples array<double>").repartition(5)
    got = {(r["call_id"], r["frame_no"]): r for r in linked.measure_frames(frames, SPEC).collect()}
    assert len(got) == len(rows)
    power = spectral.power_spectrum(frames)
    flux = {(r["call_id"], r["frame_no"]): r["flux"] for r in spectral.spectral_flux(
        spectral.mel_spectrogram(power, SPEC)).collect()}
    phase = {(r["call_id"], r["frame_no"]): r["phase_dev"] for r in spectral.phase_deviation(power, SPEC).collect()}
    for key, r in got.items():
        near = lambda a, b: a is b is None or a == pytest.approx(b, abs=1e-9)
        assert near(r["flux"], flux[key]) and near(r["phase_dev"], phase[key])
        assert (r["flux"] is None) == (key[1] in (0, 7, 14)) == (r["_prev"] is None)


def test_empty_frames(spark):
    none = spark.createDataFrame([], "call_id string, frame_no bigint, samples array<double>")
    assert linked.measure_frames(none, SPEC).count() == 0


@pytest.mark.parametrize("name", ["mel_irregularity", "phase_deviation", "spoof_score", "clip_verdicts"])
def test_no_spectra_in_a_shuffle(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffled = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert shuffled and not any(re.search(r"power|phase#|mel_db", line) for line in shuffled)
    if name == "clip_verdicts":
        assert len(shuffled) == 1 and "samples" not in shuffled[0]
