"""Pitch and loudness of equal-length frames as one Arrow function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from timbrewatch.config import FrameSpec
from timbrewatch.functions.spectral import matrix


def pitch_of(x: np.ndarray, spec: FrameSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Root mean square, peak, pitch, strength and whether unvoiced, per frame."""
    rows, n = x.shape
    padded = 1 << int(2 * n - 1).bit_length()
    z = np.fft.rfft(x, padded, axis=1)
    r = np.fft.irfft(np.abs(z) ** 2, padded, axis=1)[:, : n]
    energy = (x * x).sum(axis=1)
    # Rounding makes equal peaks compare equal whatever the FFT noise.
    relative = np.round(r[:, spec.lag_lo: min(spec.lag_hi, n - 1) + 1] / np.where(energy > 0, energy, 1.0)[:, None], 9)
    best = relative.argmax(axis=1)
    strength = relative[np.arange(rows), best]
    f0 = spec.sample_rate / (best + spec.lag_lo).astype(np.float64)
    return np.sqrt(energy / n), np.abs(x).max(axis=1), f0, strength, (energy <= 0) | (strength < spec.voicing)


def pitch_track(samples: Column, spec: FrameSpec) -> Column:
    """``struct<rms, peak, f0, strength>``; ``f0`` is null below the voicing threshold.

    Pitch is the lag with the largest autocorrelation relative to lag zero, the
    smallest lag on ties. The autocorrelation of a batch is one zero-padded FFT.
    """

    @F.arrow_udf("struct<rms:double,peak:double,f0:double,strength:double>")
    def track(frames: pa.Array) -> pa.Array:
        x = matrix(frames)
        if not x.size:
            empty = pa.array(np.zeros(0), type=pa.float64())
            return pa.StructArray.from_arrays([empty] * 4, ["rms", "peak", "f0", "strength"])
        rms, peak, f0, strength, unvoiced = pitch_of(x, spec)
        return pa.StructArray.from_arrays(
            [pa.array(rms), pa.array(peak), pa.array(f0, mask=unvoiced), pa.array(strength)],
            ["rms", "peak", "f0", "strength"])

    return track(samples)
