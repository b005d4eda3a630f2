"""Spectral measures of equal-length frames as Arrow functions.

A transform of one frame is too long for interpreted lambda expressions, so each
Arrow batch becomes one matrix and is handled by one numpy call. Spark decides
the batches; no function here sees more than one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from timbrewatch.config import FrameSpec

POWER_FLOOR = 1e-10
#: 16-bit samples are scaled to [-1, 1).
FULL_SCALE = 32768.0


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix; other rows raise ValueError, however they fall into batches."""
    if len(column) == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("frames must not be null")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("frames must have equal length")
    return flat.reshape(len(column), -1)


def arrow_lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), type=pa.float64()))


def hann(n: int) -> np.ndarray:
    """Periodic Hann taper."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def spectra_of(x: np.ndarray, taper: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Power and phase per frame and bin."""
    n = x.shape[1]
    z = np.fft.rfft(x * hann(n) if taper else x, axis=1) if n else np.zeros((0, 0), complex)
    return np.abs(z) ** 2 / max(n, 1), np.angle(z)


def decibels_of(power: np.ndarray, bank: np.ndarray) -> np.ndarray:
    return 10.0 * np.log10(np.maximum(power @ bank, POWER_FLOOR))


def vocoder_of(power: np.ndarray, first_high: int, share: float, step: float) -> tuple[np.ndarray, ...]:
    """Flatness, energy share from bin ``first_high`` on, and roll-off in hertz."""
    p = np.maximum(power, POWER_FLOOR)
    total = p.sum(axis=1)
    return (np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1), p[:, first_high:].sum(axis=1) / total,
            (p.cumsum(axis=1) >= share * total[:, None]).argmax(axis=1) * step)


def flux_of(mel: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row from the row before it."""
    return np.sqrt((np.diff(mel, axis=0) ** 2).sum(axis=1))


def phase_dev_of(power: np.ndarray, phase: np.ndarray, spec: FrameSpec, floor: float) -> np.ndarray:
    """Mean deviation of the phase advance from each row before from a steady tone's; NaN where no bin counts."""
    bins, turn = np.arange(power.shape[1]), 2 * np.pi
    raw = np.diff(phase, axis=0) - bins * (turn * spec.hop / spec.length)
    usable = (power[1:] >= floor) & (power[:-1] >= floor) & (bins > 0) & (bins < spec.length / 2)
    total = np.where(usable, np.abs(raw - turn * np.rint(raw / turn)), 0.0).sum(axis=1)
    n = usable.sum(axis=1)
    return np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)


def spectrum(samples: Column, taper: bool = True) -> Column:
    """``struct<power, phase>`` per bin: squared magnitude over length, and angle."""

    @F.arrow_udf("struct<power:array<double>,phase:array<double>>")
    def transform(frames: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(
            [arrow_lists(v) for v in spectra_of(matrix(frames), taper)], ["power", "phase"])

    return transform(samples)


def mel(hz):
    return 2595.0 * np.log10(1.0 + np.asarray(hz) / 700.0)


def mel_to_hz(m):
    return 700.0 * (10.0 ** (np.asarray(m) / 2595.0) - 1.0)


def filterbank(spec: FrameSpec) -> np.ndarray:
    """Triangular filters spaced evenly in mel from 0 Hz to half the sample rate."""
    edges = mel_to_hz(np.linspace(0.0, mel(spec.sample_rate / 2), spec.n_mels + 2))
    hz = np.arange(spec.n_bins)[:, None] * spec.sample_rate / spec.length
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0.0, np.minimum((hz - lo) / (mid - lo), (hi - hz) / (hi - mid)))


def mel_db(power: Column, spec: FrameSpec) -> Column:
    """Mel-band energies in decibels; one matrix product per batch."""
    bank = filterbank(spec)

    @F.arrow_udf("array<double>")
    def project(powers: pa.Array) -> pa.Array:
        p = matrix(powers)
        return arrow_lists(decibels_of(p, bank) if p.size else np.zeros((len(powers), 0)))

    return project(power)


def vocoder_measures(power: Column, spec: FrameSpec, high_hz: float, share: float) -> Column:
    """``struct<flatness, high_ratio, rolloff_hz>`` of each power spectrum."""
    step = spec.sample_rate / spec.length
    first_high = int(np.ceil(high_hz / step))

    @F.arrow_udf("struct<flatness:double,high_ratio:double,rolloff_hz:double>")
    def measure(powers: pa.Array) -> pa.Array:
        p = matrix(powers)
        columns = vocoder_of(p, first_high, share, step) if p.size else [np.zeros(0)] * 3
        return pa.StructArray.from_arrays(
            [pa.array(c, type=pa.float64()) for c in columns], ["flatness", "high_ratio", "rolloff_hz"])

    return measure(power)
