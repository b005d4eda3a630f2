"""Exact k best matches by cosine, without a cross join and without pair rows.

A small registry is one matrix on every executor; "small" is checked by counting
it. A larger one is cut into cells around pivot vectors. For unit vectors the
cosine order is the order of distance, so the triangle inequality tells which
cells can hold a match of a probe; only those are visited. Probes and cells are
packed into tiles of bounded size, one row of the join is one pair of tiles, and
a tile pair yields at most k rows per probe. A large cell is many tiles, so no
task depends on how the vectors are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from timbrewatch.functions.spectral import arrow_lists, matrix

TILE = 1024
PIVOTS = 64
# Distances carry rounding noise; bounds are widened by this much.
SLACK = 1e-6
# Similarities are compared after rounding, so ties do not depend on summation order.
DIGITS = 6


def unit_rows(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(lengths > 0, lengths, 1.0)


def best(sims: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the k largest per row; smaller name first on equal values."""
    by_name = np.argsort(names, kind="stable")
    rounded = np.round(sims, DIGITS)[:, by_name]
    order = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
    values = np.take_along_axis(rounded, order, axis=1)
    rows = np.repeat(np.arange(len(sims)), order.shape[1])
    return rows, by_name[order].ravel(), values.ravel()


def _hits(ids: pa.Array, names: np.ndarray, sims: np.ndarray, k: int) -> list[pa.Array]:
    rows, cols, values = best(sims, names, k)
    return [ids.take(pa.array(rows)), pa.array(names[cols], type=pa.string()),
            pa.array(values, type=pa.float64())]


def _result_type(probes: DataFrame, probe_id: str) -> str:
    return f"{probe_id} {probes.schema[probe_id].dataType.simpleString()}, did string, similarity double"


COLUMNS = ("did", "similarity")


def _merge(partial: DataFrame, probe_id: str, k: int) -> DataFrame:
    """Final k of the per-tile bests: a few rows per probe."""
    rank = Window.partitionBy(probe_id).orderBy(F.desc("similarity"), "did")
    return (
        partial.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def nearest_in_matrix(probes: DataFrame, registry: DataFrame, probe_id: str, k: int) -> DataFrame:
    """Compare each batch of probes with the whole registry as one matrix product.

    The caller has checked that the registry fits. Map-only.
    """
    rows = registry.select("did", F.col("embedding").cast("array<double>").alias("e")).orderBy("did").toArrow()
    names = np.array(rows["did"].to_pylist(), dtype=object)
    vectors = unit_rows(matrix(rows["e"].combine_chunks())) if len(names) else np.zeros((0, 0))
    shared = probes.sparkSession.sparkContext.broadcast((names, vectors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dids, reg = shared.value
        for batch in batches:
            if not len(batch) or not len(dids):
                continue
            sims = unit_rows(matrix(batch.column(1))) @ reg.T
            columns = _hits(batch.column(0), dids, sims, k)
            rank = np.tile(np.arange(1, min(k, len(dids)) + 1), len(batch))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(rank)], names=[probe_id, *COLUMNS, "rank"])

    return probes.select(probe_id, F.col("embedding").cast("array<double>")).mapInArrow(
        search, _result_type(probes, probe_id) + ", rank bigint")


def _cells_of(pivots: np.ndarray):
    @F.arrow_udf("struct<cell:int,distance:double,unit:array<double>>")
    def assign(vectors: pa.Array) -> pa.Array:
        x = unit_rows(matrix(vectors))
        d = distances(x, pivots)
        cell = d.argmin(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(cell, type=pa.int32()), pa.array(d[np.arange(len(x)), cell]), arrow_lists(x)],
            ["cell", "distance", "unit"])

    return assign


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _cells_to_visit(pivots: np.ndarray, cells: np.ndarray, counts: np.ndarray,
                    inner: np.ndarray, outer: np.ndarray, k: int):
    """Cells that may hold one of the k nearest of a probe.

    ``inner`` and ``outer`` are the least and greatest distance of a cell's
    vectors to its pivot. Enough vectors lie within the bound once the cells
    sorted by their farthest possible vector count k.
    """

    @F.arrow_udf("array<int>")
    def visit(vectors: pa.Array) -> pa.Array:
        d = distances(unit_rows(matrix(vectors)), pivots)[:, cells]
        farthest = d + outer
        order = np.argsort(farthest, axis=1)
        reached = counts[order].cumsum(axis=1) >= min(k, counts.sum())
        first = reached.argmax(axis=1)
        bound = np.take_along_axis(farthest, order, axis=1)[np.arange(len(d)), first]
        nearest = np.maximum(0.0, np.maximum(d - outer, inner - d))
        chosen = [cells[row <= b + SLACK].tolist() for row, b in zip(nearest, bound)]
        return pa.array(chosen, type=pa.list_(pa.int32()))

    return visit


def nearest_by_tiles(probes: DataFrame, registry: DataFrame, probe_id: str, k: int,
                     tile: int = TILE, n_pivots: int = PIVOTS) -> DataFrame:
    """The same result for a registry of any size.

    The driver sees the pivots and one line of bounds per pivot, both fixed in
    number. Pivots are the vectors with the smallest name hashes, so a re-run
    task sees the same ones.
    """
    vectors = registry.select("did", F.col("embedding").cast("array<double>").alias("e"))
    chosen = vectors.orderBy(F.xxhash64("did"), "did").limit(n_pivots).select("e").toArrow()
    if not chosen.num_rows:
        return probes.select(probe_id, F.lit("").alias("did"), F.lit(0.0).alias("similarity"),
                             F.lit(0).cast("bigint").alias("rank")).where(F.lit(False))
    pivots = unit_rows(matrix(chosen["e"].combine_chunks()))
    placed = vectors.select("did", _cells_of(pivots)(F.col("e")).alias("_p")).select("did", "_p.*")
    bounds = (
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("lo"),
                                   F.max("distance").alias("hi"))
        .orderBy("cell").toArrow()
    )
    cells = bounds["cell"].to_numpy()
    counts = bounds["n"].to_numpy()
    inner = bounds["lo"].to_numpy() - SLACK
    outer = bounds["hi"].to_numpy() + SLACK

    # Registry tiles: the split of a cell follows its counted size, up to hashing.
    parts = {int(c): int(-(-n // tile)) for c, n in zip(cells, counts)}
    part_count = F.element_at(F.lit(np.array([parts.get(c, 1) for c in range(n_pivots)])), F.col("cell") + 1)
    tiles = (
        placed.withColumn("_part", F.pmod(F.xxhash64("did"), part_count).cast("int"))
        .groupBy("cell", "_part")
        .agg(F.collect_list("did").alias("dids"), F.flatten(F.collect_list("unit")).alias("registry"))
    )
    # Probe tiles are formed after routing, from hashed ids, within (cell, slice).
    p = probes.select(probe_id, F.col("embedding").cast("array<double>").alias("e"))
    routed = p.select(probe_id, "e", F.explode(
        _cells_to_visit(pivots, cells, counts, inner, outer, k)(F.col("e"))).alias("cell"))
    load = routed.groupBy("cell").count().withColumn(
        "slices", F.ceil(F.col("count") / F.lit(tile)).cast("int")).select("cell", "slices")
    slices = {r["cell"]: r["slices"] for r in load.collect()}
    slice_count = F.element_at(F.lit(np.array([slices.get(c, 1) for c in range(n_pivots)])), F.col("cell") + 1)
    packs = (
        routed.withColumn("_slice", F.pmod(F.xxhash64(probe_id), slice_count).cast("int"))
        .groupBy("cell", "_slice")
        .agg(F.collect_list(probe_id).alias("ids"), F.flatten(F.collect_list("e")).alias("probes"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), (part_count - 1).cast("int"))))
    )
    width = pivots.shape[1]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                cut = batch.slice(row, 1)
                ids, dids = cut.column(0).flatten(), cut.column(2).flatten().to_numpy(zero_copy_only=False)
                left = unit_rows(cut.column(1).flatten().to_numpy().reshape(-1, width))
                right = cut.column(3).flatten().to_numpy().reshape(-1, width)
                sims = left @ right.T
                yield pa.RecordBatch.from_arrays(
                    _hits(ids, dids, sims, k), names=[probe_id, *COLUMNS])

    pairs = packs.join(tiles, ["cell", "_part"]).select("ids", "probes", "dids", "registry")
    return _merge(pairs.mapInArrow(match, _result_type(probes, probe_id)), probe_id, k)
