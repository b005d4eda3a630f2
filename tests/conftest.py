import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from timbrewatch.session import local_session

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def skewed(spark):
    """900 rows; one key holds a third of them. Times rise unevenly; some values are missing."""
    from pyspark.sql import functions as F

    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 20).cast("bigint").alias("call_id"),
        F.timestamp_micros(F.col("id") * 700_000 + F.pmod(F.xxhash64("id"), F.lit(600_000))).alias("event_ts"),
        F.col("id").alias("seq"),
        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)).alias("v"),
        F.when(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)) == 0, F.col("id")).alias("known"))


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
