"""Bulk audio clips: binary files to blocks of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from timbrewatch.schemas import PCM_BLOCK

FULL_SCALE = 32768.0


def read_clips(spark: SparkSession, path: str, glob: str = "*.wav", recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of every clip below ``path``.

    The files are listed by Spark and read where their rows are needed;
    ``content`` is not loaded by queries that do not ask for it.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


def decode(content: bytes, default_rate: int) -> tuple[int, np.ndarray]:
    """Sample rate and samples of a mono PCM16 WAV file or of headerless PCM16."""
    if content[:4] == b"RIFF":
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2 or w.getnchannels() != 1:
                raise ValueError("only mono 16-bit PCM is handled")
            return w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
    return default_rate, np.frombuffer(content, dtype="<i2", count=len(content) // 2)


def unpack_pcm(clips: DataFrame, block_samples: int = 160_000, default_rate: int = 16_000) -> DataFrame:
    """``clip, sample_rate, start_sample, samples``: clips cut into blocks, scaled to [-1, 1).

    A clip becomes many rows of bounded size, so later steps do not depend on
    clip length.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rate, pcm = decode(content.as_py(), default_rate)
                for start in range(0, len(pcm), block_samples):
                    samples = pcm[start: start + block_samples] / FULL_SCALE
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()]), pa.array([rate], type=pa.int32()),
                         pa.array([start], type=pa.int64()),
                         pa.array([samples], type=pa.list_(pa.float64()))],
                        names=["clip", "sample_rate", "start_sample", "samples"])

    return clips.select("path", "content").mapInArrow(blocks, PCM_BLOCK)


def write_clips(df: DataFrame, folder: str) -> DataFrame:
    """Write ``name, sample_rate, pcm`` (array of 16-bit integers) as WAV files from the tasks.

    Returns the lazy manifest ``name, n_samples``; running it writes the files.
    A repeated task overwrites its files with the same bytes. ``folder`` must be
    reachable from all executors.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for name, rate, pcm in zip(batch["name"], batch["sample_rate"], batch["pcm"]):
                buffer = io.BytesIO()
                with wave.open(buffer, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(int(rate))
                    w.writeframes(np.asarray(pcm, dtype="<i2").tobytes())
                with target.open_output_stream(f"{root}/{name}.wav") as out:
                    out.write(buffer.getvalue())
            yield pd.DataFrame({"name": batch["name"], "n_samples": batch["pcm"].map(len)})

    return df.select("name", "sample_rate", "pcm").mapInPandas(write, "name string, n_samples bigint")


def content_refs(clips: DataFrame) -> DataFrame:
    """``audio_hash, uri, n_bytes, first_seen``: one row per distinct content.

    Only digests are shuffled. The earliest sighting names the reference.
    """
    seen = clips.select(
        F.sha2("content", 256).alias("audio_hash"), F.col("path").alias("uri"),
        F.col("length").alias("n_bytes"), F.col("modificationTime").alias("first_seen"))
    return reduce_refs(seen)


def reduce_refs(seen: DataFrame) -> DataFrame:
    order = F.struct("first_seen", "uri")
    return seen.groupBy("audio_hash").agg(
        F.min_by("uri", order).alias("uri"), F.max("n_bytes").alias("n_bytes"),
        F.min("first_seen").alias("first_seen"))


def new_refs(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """References to append: distinct contents that ``stored`` does not hold yet."""
    return reduce_refs(seen).join(stored.select("audio_hash"), "audio_hash", "left_anti")


def append_refs(seen: DataFrame, path: str) -> None:
    """Append the new references to the Parquet store at ``path``."""
    spark = seen.sparkSession
    schema = reduce_refs(seen).schema
    stored = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    new_refs(seen, stored).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is present on its Hadoop file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the default file system where it has none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
