"""Risk settings: a small table of named numbers, read once and folded into the plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class RiskConfig:
    """Tier bounds, factor weights and the speaker-mismatch threshold."""

    medium: float = 0.4
    high: float = 0.7
    mismatch_threshold: float = 0.5
    w_spoof: float = 0.7
    w_mismatch: float = 0.3
    w_context: float = 0.0

    @classmethod
    def from_table(cls, table: DataFrame) -> "RiskConfig":
        """Read ``risk_config(param, value)``.

        Only known parameter names are fetched and each is reduced to one row
        first, so the driver receives at most one number per field whatever
        the table holds.
        """
        names = [f.name for f in fields(cls)]
        rows = (
            table.where(F.col("param").isin(names))
            .groupBy("param").agg(F.max("value").alias("value"))
            .collect()
        )
        return replace(cls(), **{r["param"]: r["value"] for r in rows})

    @property
    def weights(self) -> Mapping[str, float]:
        return {
            name: w for name, w in (
                ("spoof", self.w_spoof), ("mismatch", self.w_mismatch), ("context", self.w_context),
            ) if w > 0
        }


@dataclass(frozen=True)
class FrameSpec:
    """Geometry of analysis frames; the defaults are 25 ms frames every 10 ms."""

    sample_rate: int = 16_000
    length: int = 400
    hop: int = 160
    n_mels: int = 40
    fmin: float = 60.0
    fmax: float = 400.0
    voicing: float = 0.3

    @property
    def n_bins(self) -> int:
        return self.length // 2 + 1

    def bin_hz(self, b: int) -> float:
        return b * self.sample_rate / self.length

    @property
    def lag_lo(self) -> int:
        return -(-self.sample_rate // int(self.fmax))

    @property
    def lag_hi(self) -> int:
        return self.sample_rate // int(self.fmin)


@dataclass(frozen=True)
class LogisticModel:
    """Named weights and intercept of the default spoof scorer."""

    weights: Mapping[str, float] = field(default_factory=dict)
    intercept: float = 0.0
