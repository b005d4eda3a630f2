import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from timbrewatch.operators import identity
from timbrewatch.plans.nearest import nearest_by_tiles, nearest_in_matrix


def vectors(spark, n, id_col, seed, width=8):
    """Vectors around a few centres, so that cells differ in size."""
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (
        F.sin(F.pmod(F.col("id") * F.col("id"), F.lit(5)) * 2 + i)
        + F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1000)) / 4000.0))
    return spark.range(n).select(F.concat(F.lit(id_col), F.col("id")).alias(id_col), values.alias("embedding"))


@pytest.mark.parametrize("tile,pivots", [(16, 8), (1024, 3)])
def test_tiles_equal_matrix(spark, tile, pivots):
    probes, registry = vectors(spark, 150, "probe", 1), vectors(spark, 400, "did", 2)
    want = nearest_in_matrix(probes, registry, "probe", 4)
    got = nearest_by_tiles(probes, registry, "probe", 4, tile=tile, n_pivots=pivots)
    columns = ("probe", "rank", "did", "similarity")
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert got.count() == 600


def test_matrix_equals_all_pairs(spark):
    import numpy as np
    probes, registry = vectors(spark, 40, "probe", 1), vectors(spark, 60, "did", 2)
    p, r = probes.toPandas(), registry.toPandas()
    a, b = np.stack(p["embedding"]), np.stack(r["embedding"])
    sims = np.round((a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None], 6)
    want = sorted((p["probe"][i], did, k + 1) for i in range(40) for k, (_, did) in enumerate(
        sorted(zip(-sims[i], r["did"]))[:3]))
    got = nearest_in_matrix(probes, registry, "probe", 3)
    assert sorted((x["probe"], x["did"], x["rank"]) for x in got.collect()) == want


def test_size_check_picks_tiles(spark):
    probes, registry = vectors(spark, 20, "probe", 1), vectors(spark, 30, "did", 2)
    small = identity.identify(probes, registry, 2, "probe")
    large = identity.identify(probes, registry, 2, "probe", matrix_cells=10)
    assert rows_of(small, "probe", "did", "rank") == rows_of(large, "probe", "did", "rank")


def test_self_match_is_one_and_unknown_is_mismatch(spark):
    enrolled = vectors(spark, 5, "did", 3)
    probes = enrolled.withColumnRenamed("did", "claimed_did").unionByName(
        enrolled.limit(1).select(F.lit("nobody").alias("claimed_did"), "embedding"))
    rows = {r["claimed_did"]: r for r in identity.verify(probes, enrolled, 0.9).collect()}
    assert all(abs(r["speaker_sim"] - 1) < 1e-12 and not r["mismatch"] for k, r in rows.items() if k != "nobody")
    assert rows["nobody"]["speaker_sim"] is None and rows["nobody"]["mismatch"]


def test_enrolment_is_unit_length(spark):
    twice = vectors(spark, 10, "did", 3).withColumn("did", F.lit("d"))
    v = identity.enroll(twice).first()["embedding"]
    assert sum(x * x for x in v) == pytest.approx(1.0)
