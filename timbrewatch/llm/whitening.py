"""Whitening of embeddings: exact scatter in one pass, eigenvectors from a triangular factor.

Rows of a batch are handled in numpy inside Arrow tasks; what leaves a task is one
sum per dimension or pair of dimensions. The driver sees the scatter matrix only,
whose size is that of the dimension squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timbrewatch.llm.common import materialise

# Fixed values of the integer grid.
SCALE, OFFSET = 64, 1_000_000
#: Grid values beyond this count as this, so that they stay longs.
LIMIT = 1 << 62
EXACT = 1 << 53
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``components`` has a unit row per component."""

    dim: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part of S/n is taken off in integers first."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def _grid(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the vectors of each length that are whole and finite; rows are their places."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets, values = vectors.offsets.to_numpy(), vectors.values
    length = np.diff(offsets)
    length[np.asarray(vectors.is_null())] = -1
    flat = values.to_numpy(zero_copy_only=False).astype(float)
    flat[np.asarray(values.is_null())] = np.nan
    for size in np.unique(length[length >= 0]):
        rows = np.flatnonzero(length == size)
        c = flat[offsets[rows][:, None] + np.arange(size)]
        fine = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * c[fine]), -float(LIMIT), float(LIMIT)).astype(np.int64) + OFFSET
        yield rows[fine], x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list] = {}
    for batch in batches:
        for _, x in _grid(batch.column(0)):
            if len(x):
                n, sums, low, high = seen.setdefault(x.shape[1], [0, [0] * x.shape[1], LARGEST, -LARGEST])
                part = x.astype(object).sum(axis=0) if x.size and np.abs(x).max() > 1 << 40 else x.sum(axis=0)
                seen[x.shape[1]] = [n + len(x), [a + int(b) for a, b in zip(sums, part)],
                                    min(low, int(x.min(initial=LARGEST))), max(high, int(x.max(initial=-LARGEST)))]
    rows = [(size, i, n, str(s), low, high) for size, (n, sums, low, high) in seen.items() for i, s in enumerate(sums)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(col, kind) for col, kind in zip(zip(*rows) if rows else [[]] * 6, (
            pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["dim", "i", "n", "s", "low", "high"])


def _cells(whole: np.ndarray, approx: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(whole))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(whole[i, j]), pa.array(approx[i, j])],
                                      ["i", "j", "whole", "approx"])


def scatter(vectors: DataFrame, column: str, dim: int, shift: list[int], exact: bool) -> dict[tuple[int, int], tuple[int, float]]:
    """Sums of products of the shifted entries, for each pair of dimensions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, approx = np.zeros((dim, dim), np.int64), np.zeros((dim, dim))
        for batch in batches:
            for _, x in _grid(batch.column(0)):
                if x.shape[1] != dim or not len(x):
                    continue
                y = x - np.array(shift, np.int64)
                if not exact:
                    approx += y.astype(float).T @ y.astype(float)
                    continue
                # A product of doubles is exact while its sums stay below 2**53.
                step = max(1, int(EXACT // max(1, int(np.abs(y).max())) ** 2))
                for at in range(0, len(y), step):
                    part = y[at:at + step].astype(float)
                    whole += (part.T @ part).astype(np.int64)
        yield _cells(whole, approx)

    parts = vectors.select(column).mapInArrow(task, "i int, j int, whole long, approx double")
    return {(r.i, r.j): (r.whole, r.approx) for r in parts.groupBy("i", "j").agg(
        F.sum("whole").alias("whole"), F.sum("approx").alias("approx")).collect()}


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with ``v = L L'``, a column per rank; rows stay in the order of ``v``.

    Each step takes the largest remaining diagonal entry, so that in pivot order L is
    lower triangular and its columns fall in size.
    """
    d = len(v)
    left, rest = np.zeros((d, d)), np.diag(v).astype(float).copy()
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    taken = np.zeros(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(taken, -np.inf, rest)))
        if rest[p] <= least:
            return left[:, :k]
        column = v[:, p] - left[:, :k] @ left[p, :k]
        column[taken] = 0.0
        left[:, k] = column / np.sqrt(rest[p])
        left[p, k] = np.sqrt(rest[p])
        taken[p] = True
        rest -= left[:, k] ** 2
    return left


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times a rotation that makes its columns orthogonal, largest first.

    A sweep meets each pair of columns once, in rounds of disjoint pairs.
    """
    a = factor.T.copy()
    r = len(a)
    seats = list(range(r)) + ([-1] if r % 2 else [])
    rounds = []
    for _ in range(len(seats) - 1 if r > 1 else 0):
        half = len(seats) // 2
        pairs = [(p, q) for p, q in zip(seats[:half], reversed(seats[half:])) if p >= 0 and q >= 0]
        rounds.append(tuple(np.array(pairs).T))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > 1e-16 * size
            worst = max(worst, float(np.max(np.abs(xy) / np.where(size > 0, size, 1.0))))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn & np.isfinite(t), t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if worst <= 1e-15:
            break
    return a[np.argsort(-(a * a).sum(1), kind="stable")].T


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = 32) -> Whitening | None:
    """The transform fitted to all usable vectors; None if there are none.

    Vectors that are null, hold null or non-finite entries, or are shorter than the
    longest usable one (they lack entries) are left out. Entries are put on an
    integer grid, so sums and products are exact and do not depend on
    the order of rows. Directions without variance are no components, so equal
    vectors alone give none. Repeated rows count each time.
    """
    parts = vectors.select(column).mapInArrow(_sums, "dim int, i int, n long, s string, low long, high long")
    totals = materialise(parts.groupBy("dim", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"),
        F.max("high").alias("high")), "whitening-sums")
    dim = totals.agg(F.max("dim")).first()[0]
    if dim is None:
        return None
    rows = sorted(totals.filter(F.col("dim") == dim).collect(), key=lambda r: r.i)
    n, sums = rows[0].n, [int(r.s) for r in rows]
    widest = max(r.high for r in rows) - min(r.low for r in rows) + 1
    exact = n * widest ** 2 < LARGEST and widest ** 2 < EXACT
    shift = [(2 * s + n) // (2 * n) for s in sums]
    cells = scatter(vectors, column, dim, shift, exact)
    left = [s - n * m for s, m in zip(sums, shift)]
    v = np.zeros((dim, dim))
    for (i, j), (whole, approx) in cells.items():
        if exact:  # n*sum(y y') - T T' in whole numbers
            v[i, j] = v[j, i] = (n * whole - left[i] * left[j]) / (n * n)
        else:
            v[i, j] = v[j, i] = approx / n - (left[i] / n) * (left[j] / n)
    turned = one_sided_jacobi(pivoted_cholesky(v))
    e = (turned * turned).sum(0)
    fine = e > dim * np.finfo(float).eps * e.max(initial=0.0)
    turned, e = turned[:, fine][:, :components], e[fine][:components]
    units = (turned / np.sqrt(e)).T
    if len(units):
        units *= np.sign(units[np.arange(len(units)), np.abs(units).argmax(1)])[:, None]
    return Whitening(dim, n, tuple(sums), units, e, float(np.trace(v)))


def identity_error(vectors: DataFrame, fit: Whitening, column: str = "embedding") -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured on all of them."""
    r = len(fit.eigenvalues)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((r, r)), np.zeros(r)
        for batch in batches:
            for _, x in _grid(batch.column(0)):
                if x.shape[1] == fit.dim:
                    w = fit.whiten(x)
                    products, sums = products + w.T @ w, sums + w.sum(0)
        i, j = np.triu_indices(r)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, np.arange(r)]), pa.int32()), pa.array(np.concatenate([j, np.full(r, -1)]), pa.int32()),
                                          pa.array(np.concatenate([products[i, j], sums]))], ["i", "j", "s"])

    parts = vectors.select(column).mapInArrow(task, "i int, j int, s double")
    got = {(x.i, x.j): x.s / fit.n for x in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = [got[i, -1] for i in range(r)]
    return max((abs(s - mean[i] * mean[j] - (i == j)) for (i, j), s in got.items() if j >= 0), default=0.0)


def whiten_rows(vectors: DataFrame, fit: Whitening, error: float, column: str = "embedding") -> DataFrame:
    """vec_id, n, deviation and the whitened vector (with what each component explains) of each usable row.

    ``deviation`` is null where the exact sum does not fit a long.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    n, sums = fit.n, np.array(fit.sums, object)

    def deviations(x: np.ndarray) -> list[int | None]:
        whole = np.array([s // n for s in fit.sums], np.int64)
        rest = [s % n for s in fit.sums]
        y = x - whole  # n*x - S = n*y - rest
        if fit.dim * (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 <= LARGEST:
            return ((n * y - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        sums_ = ((n * x.astype(object) - sums) ** 2).sum(1)
        return [s if s <= LARGEST else None for s in sums_]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _grid(batch.column(1)):
                if x.shape[1] != fit.dim or not len(x):
                    continue
                w = fit.whiten(x)
                flat = pa.array(w.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(deviations(x), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    out = vectors.select("vec_id", column).mapInArrow(task, f"vec_id {kind}, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(float(x)) for x in fit.explained]).cast("array<double>")
    return out.withColumns({"n": F.lit(n).cast("long"), "explained": explained, "identity_error": F.lit(float(error))})


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component, as the fitted transform gives it.

    See `fit_whitening` for the vectors left out. Null and repeated vec_ids are kept.
    No usable vector, or none that differs from another, gives no row.
    """
    fit = fit_whitening(vectors, column, components)
    if fit is None or not len(fit.eigenvalues):
        empty = vectors.select("vec_id").limit(0)
        return empty.withColumns({"component": F.lit(0), "n": F.lit(0).cast("long"), "deviation": F.lit(0).cast("long"),
                                  "whitened": F.lit(0.0), "explained": F.lit(0.0), "identity_error": F.lit(0.0)})
    rows = whiten_rows(vectors, fit, identity_error(vectors, fit, column), column)
    return rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode_outer("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("_at")).alias("explained"), "identity_error")
