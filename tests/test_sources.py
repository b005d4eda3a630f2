import numpy as np
from pyspark.sql import functions as F

from tests.conftest import rows_of
from timbrewatch.session import scratch_dir
from timbrewatch.sources import clips
from timbrewatch.sources.enrollment import latest_enrollment


def test_wav_round_trip_in_blocks(spark):
    folder = clips.qualified(spark, scratch_dir(spark, "wav"))
    df = spark.range(3).select(
        F.concat(F.lit("clip"), "id").alias("name"), F.lit(8000).alias("sample_rate"),
        F.transform(F.sequence(F.lit(0), F.col("id") * 10 + 24), lambda i: (i * 1000 - 12000).cast("int")).alias("pcm"))
    assert rows_of(clips.write_clips(df, folder), "name", "n_samples") == [("clip0", 25), ("clip1", 35), ("clip2", 45)]
    found = clips.read_clips(spark, folder)
    assert found.count() == 3
    blocks = clips.unpack_pcm(found, block_samples=10).orderBy("clip", "start_sample").collect()
    assert max(len(b["samples"]) for b in blocks) == 10 and {b["sample_rate"] for b in blocks} == {8000}
    first = [x * 32768 for b in blocks if "clip0" in b["clip"] for x in b["samples"]]
    assert first == [i * 1000 - 12000 for i in range(25)]


def test_headerless_pcm():
    rate, pcm = clips.decode(np.array([1, -2, 300], dtype="<i2").tobytes() + b"\x01", 16000)
    assert rate == 16000 and pcm.tolist() == [1, -2, 300]


def test_references_are_appended_once(spark):
    path = f"{scratch_dir(spark, 'refs')}/refs"
    seen = spark.range(20).select(
        F.sha2((F.col("id") % 5).cast("string"), 256).alias("audio_hash"), F.concat(F.lit("u"), "id").alias("uri"),
        F.lit(9).cast("bigint").alias("n_bytes"), F.timestamp_seconds("id").alias("first_seen"))
    clips.append_refs(seen.where("id < 3"), path)
    clips.append_refs(seen, path)
    clips.append_refs(seen, path)
    assert rows_of(spark.read.parquet(path), "uri") == [("u0",), ("u1",), ("u2",), ("u3",), ("u4",)]


def test_latest_enrollment_breaks_ties_by_hash(spark):
    rows = spark.sql("select * from values ('d', 'a', 1), ('d', 'c', 2), ('d', 'b', 2) as t(did, embedding_hash, s)")
    got = latest_enrollment(rows.withColumn("registered_at", F.timestamp_seconds("s")).drop("s")).collect()
    assert [(r["did"], r["embedding_hash"]) for r in got] == [("d", "c")]
