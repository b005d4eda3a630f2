"""Frame measures that need the frame before, without spectra in a shuffle.

Raw samples are dealt by (call, segment of frames) and sorted there; the last
frame of a segment also goes to the next one. One Arrow pass then holds each
frame beside its predecessor, so spectra, phases and bands of one frame meet
those of the other inside a batch and never leave the task. Clips read in blocks
bring the frame before along (``sources.wav``) and need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from timbrewatch.config import FrameSpec
from timbrewatch.functions import spectral as fs
from timbrewatch.functions.prosody import pitch_of
from timbrewatch.plans.segments import SEG, index_segment

FRAMES_PER_SEGMENT = 4096
#: Frames of a block are measured so many at a time.
FRAMES_PER_BATCH = 4096
MEASURES = (
    "flux double, phase_dev double, flatness double, high_ratio double, rolloff_hz double, peak double, f0 double, "
    "voiced boolean, mel_db array<double>, _prev struct<f0:double,peak:double,voiced:boolean>"
)


class Measures:
    """All measures of a matrix of frames in which a row may follow from the row before it."""

    def __init__(self, spec: FrameSpec, high_hz: float = 4000.0, share: float = 0.85, floor: float = 1e-6) -> None:
        self.spec, self.share, self.floor = spec, share, floor
        self.bank = fs.filterbank(spec)
        self.step = spec.sample_rate / spec.length
        self.first_high = int(np.ceil(high_hz / self.step))

    def of(self, x: np.ndarray, linked: np.ndarray) -> pa.StructArray:
        """Columns of ``MEASURES``; those against the row before are null unless ``linked``."""
        power, phase = fs.spectra_of(x)
        mel = fs.decibels_of(power, self.bank)
        flatness, high, rolloff = fs.vocoder_of(power, self.first_high, self.share, self.step)
        _, peak, f0, _, unvoiced = pitch_of(x, self.spec)
        flux, dev = np.zeros(len(x)), np.full(len(x), np.nan)
        flux[1:] = fs.flux_of(mel)
        dev[1:] = fs.phase_dev_of(power, phase, self.spec, self.floor)
        back = np.maximum(np.arange(len(x)) - 1, 0)
        before = pa.StructArray.from_arrays(
            [pa.array(f0[back], mask=unvoiced[back]), pa.array(peak[back]), pa.array(~unvoiced[back])],
            ["f0", "peak", "voiced"], mask=pa.array(~linked))
        columns = {
            "flux": pa.array(flux, mask=~linked), "phase_dev": pa.array(dev, mask=~linked | np.isnan(dev)),
            "flatness": pa.array(flatness), "high_ratio": pa.array(high), "rolloff_hz": pa.array(rolloff),
            "peak": pa.array(peak), "f0": pa.array(f0, mask=unvoiced), "voiced": pa.array(~unvoiced),
            "mel_db": fs.arrow_lists(mel), "_prev": before,
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _same(column: pa.Array) -> np.ndarray:
    """Whether each row but the first equals the row before; nulls are equal."""
    a, b = column[1:], column[:-1]
    equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return equal.to_numpy(zero_copy_only=False)


def measure_frames(frames: DataFrame, spec: FrameSpec, *by: str) -> DataFrame:
    """``call_id, frame_no, *by`` and ``MEASURES`` of each frame; frame numbers are unique in a call.

    One shuffle, of samples. A group is at most ``FRAMES_PER_SEGMENT`` frames
    and a neighbour, and a task holds one Arrow batch and one row at a time. A
    frame whose predecessor is absent has null changes. Frames of unequal
    length or null samples raise ValueError.
    """
    kept = ["call_id", "frame_no", *by]
    seg = index_segment("frame_no", FRAMES_PER_SEGMENT)
    own = F.struct(seg.alias("at"), F.lit(False).alias("copy"))
    following = F.struct((seg + 1).alias("at"), F.lit(True).alias("copy"))
    is_last = F.pmod(F.col("frame_no"), F.lit(FRAMES_PER_SEGMENT)) == FRAMES_PER_SEGMENT - 1
    placed = (
        frames.select(*kept, "samples", F.explode(
            F.when(is_last, F.array(own, following)).otherwise(F.array(own))).alias("_c"))
        .select(*kept, "samples", F.col("_c.at").alias(SEG), F.col("_c.copy").alias("_copy"))
        .repartition("call_id", SEG).sortWithinPartitions("call_id", SEG, "frame_no")
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*kept).schema]
    measures = Measures(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch if last is None else pa.concat_batches([last, batch])
            number = joined["frame_no"].to_numpy(zero_copy_only=False)
            linked = np.zeros(joined.num_rows, bool)
            linked[1:] = _same(joined["call_id"]) & _same(joined[SEG]) & (np.diff(number) == 1)
            emit = ~joined["_copy"].to_numpy(zero_copy_only=False)
            if last is not None:
                emit[0] = False
            found = measures.of(fs.matrix(joined["samples"]), linked)
            whole = pa.RecordBatch.from_arrays(
                [*(joined[c] for c in kept), *found.flatten()], names=[*kept, *(f.name for f in found.type)])
            yield whole.filter(pa.array(emit))
            last = batch.slice(batch.num_rows - 1)

    return placed.mapInArrow(run, ", ".join([*fields, MEASURES]))


def measure_blocks(blocks: DataFrame, spec: FrameSpec) -> DataFrame:
    """``clip, frame_no`` and ``MEASURES`` of each full frame that begins in a block. Map-only.

    ``blocks`` come from ``sources.wav.read_frame_blocks`` with the same
    ``spec``: each brings the frame before its first one and the rest of its
    last one. A clip of another sample rate raises ValueError.
    """
    measures = Measures(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip, rate, start, lead, samples in zip(*(batch[c] for c in (
                    "clip", "sample_rate", "start_sample", "lead", "samples"))):
                if rate.as_py() != spec.sample_rate:
                    raise ValueError(f"{clip.as_py()} has {rate.as_py()} samples a second, not {spec.sample_rate}")
                pcm = samples.values.to_numpy(zero_copy_only=False)
                if len(pcm) < spec.length:
                    continue
                cuts = np.lib.stride_tricks.sliding_window_view(pcm, spec.length)[::spec.hop]
                skip, first = lead.as_py() // spec.hop, start.as_py() // spec.hop
                for lo in range(skip, len(cuts), FRAMES_PER_BATCH):
                    with_before = max(lo - 1, 0)
                    x = cuts[with_before: lo + FRAMES_PER_BATCH] / fs.FULL_SCALE
                    linked = np.arange(len(x)) > 0
                    found = measures.of(x, linked).slice(lo - with_before)
                    number = np.arange(len(found), dtype=np.int64) + (first + lo - skip)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([clip.as_py()] * len(found), pa.string()), pa.array(number), *found.flatten()],
                        names=["clip", "frame_no", *(f.name for f in found.type)])

    return blocks.mapInArrow(run, f"clip string, frame_no bigint, {MEASURES}")
