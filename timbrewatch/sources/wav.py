"""WAV clips of any length as blocks of samples: a data source that splits files by bytes.

Spark's binary source makes a clip one value, below 2 GB. Here the driver lists
files and cuts them by length alone, as Spark does with its own formats. A task
reads the header of each file of its part, and takes the blocks whose first byte
lies in its part, so every block is owned once wherever the header ends.
"""

from __future__ import annotations

import fnmatch
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from timbrewatch.config import FrameSpec

BLOCKS = "clip string, sample_rate int, start_sample bigint, lead int, samples array<smallint>"
SAMPLE_BYTES = 2
#: Opening a file is weighed like reading so many bytes when small files are put together.
OPEN_BYTES = 4 << 20
READ_BYTES = 8 << 20
HEAD_BYTES = 64 << 10
# Fixed values of the format: PCM, the tag whose sub-format follows, and "length not known or elsewhere".
PCM, EXTENSIBLE, ELSEWHERE = 1, 0xFFFE, 0xFFFFFFFF


@dataclass(frozen=True)
class Header:
    sample_rate: int
    data_at: int
    n_samples: int


def read_header(peek: Callable[[int, int], bytes], size: int, default_rate: int, name: str = "clip") -> Header:
    """Where the samples of a file of ``size`` bytes lie; ``peek(at, n)`` gives up to ``n`` of its bytes.

    RIFF and RF64 (lengths of 64 bits) with mono 16-bit PCM, else ValueError.
    Chunks may come in any order before the samples. A length that is not
    known, or beyond the end of the file, means up to the end. Files without
    either mark are headerless samples at ``default_rate``.
    """
    mark = peek(0, 12)
    if mark[:4] not in (b"RIFF", b"RF64") or mark[8:12] != b"WAVE":
        return Header(default_rate, 0, size // SAMPLE_BYTES)
    at, rate, long_length = 12, None, None
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", peek(at, 8))
        if kind == b"ds64":
            long_length = struct.unpack("<Q", peek(at + 16, 8))[0]
        elif kind == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", peek(at + 8, 16))
            if tag == EXTENSIBLE and length >= 26:
                tag = struct.unpack("<H", peek(at + 32, 2))[0]
            if (tag, channels, bits) != (PCM, 1, 16):
                raise ValueError(f"{name}: only mono 16-bit PCM is handled")
        elif kind == b"data":
            if rate is None:
                raise ValueError(f"{name}: samples without a format")
            if length == ELSEWHERE:
                length = size if long_length is None else long_length
            return Header(rate, at + 8, min(length, size - at - 8) // SAMPLE_BYTES)
        at += 8 + length + length % 2
    raise ValueError(f"{name}: no samples found")


@dataclass
class Part(InputPartition):
    """Byte ranges ``(path, size, from, to)`` that one task reads."""

    ranges: list[tuple[str, int, int, int]]


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; the names that Hadoop gives S3 are those of S3 itself."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9+.-]+:", path) else f"file://{path}")


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.wav")
        self.block, self.before, self.after, self.split, self.default_rate = (
            int(options.get(name, default)) for name, default in (
                ("block", 160_000), ("before", 0), ("after", 0), ("split_bytes", 64 << 20), ("default_rate", 16_000)))
        if min(self.block, self.split) <= 0 or min(self.before, self.after) < 0 or self.before > self.block:
            raise ValueError("block and split_bytes must be positive, before and after not negative, before within a block")

    def partitions(self) -> list[Part]:
        system, root = _located(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else [
            f for f in system.get_file_info(fs.FileSelector(root, recursive=True))
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)
            and not f.base_name.startswith((".", "_"))]
        parts, load = [Part([])], 0
        for f in sorted(files, key=lambda f: f.path):
            for start in range(0, f.size, self.split):
                end = min(start + self.split, f.size)
                weight = end - start + OPEN_BYTES
                if parts[-1].ranges and load + weight > self.split + OPEN_BYTES:
                    parts.append(Part([]))
                    load = 0
                parts[-1].ranges.append((f.path, f.size, start, end))
                load += weight
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _located(self.path)
        for path, size, start, end in part.ranges:
            with system.open_input_file(path) as file:
                yield from self._blocks(file, path, size, start, end)

    def _blocks(self, file: pa.NativeFile, path: str, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        head = file.read_at(min(HEAD_BYTES, size), 0)
        header = read_header(lambda at, n: head[at: at + n] if at + n <= len(head) else file.read_at(n, at),
                             size, self.default_rate, path)
        width = self.block * SAMPLE_BYTES
        first = max(0, -(-(start - header.data_at) // width))
        stop = min(-(-(end - header.data_at) // width), -(-header.n_samples // self.block))
        per_read = max(1, READ_BYTES // width)
        for lo in range(first, stop, per_read):
            hi = min(lo + per_read, stop)
            origin = max(0, lo * self.block - self.before)
            reach = min(header.n_samples, hi * self.block + self.after)
            pcm = np.frombuffer(
                file.read_at((reach - origin) * SAMPLE_BYTES, header.data_at + origin * SAMPLE_BYTES), dtype="<i2")
            starts = [k * self.block for k in range(lo, hi)]
            leads = [min(s, self.before) for s in starts]
            cuts = [pcm[s - lead - origin: min(reach, s + self.block + self.after) - origin] for s, lead in zip(starts, leads)]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(cuts), pa.string()), pa.array([header.sample_rate] * len(cuts), pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(leads, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cuts), pa.int16()))],
                names=["clip", "sample_rate", "start_sample", "lead", "samples"])


class PcmBlocks(DataSource):
    """``spark.read.format("pcm_blocks")``.

    Options: ``path`` (a file, or a folder read recursively), ``glob``,
    ``block`` (samples a block owns), ``before`` and ``after`` (samples of the
    neighbours it brings along), ``split_bytes`` (of a task), ``default_rate``.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def read_blocks(spark: SparkSession, path: str, block: int = 160_000, **options: object) -> DataFrame:
    """``clip, sample_rate, start_sample, lead, samples``: 16-bit samples of clips of any length, in blocks.

    ``samples`` begin ``lead`` samples before ``start_sample``. Files without
    samples give no row; a file that is no mono 16-bit PCM fails the read.
    """
    spark.dataSource.register(PcmBlocks)
    reader = spark.read.format("pcm_blocks").option("block", block)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def read_frame_blocks(spark: SparkSession, path: str, spec: FrameSpec, frames: int = 1000, **options: object) -> DataFrame:
    """Blocks of ``frames`` frames for ``linked.measure_blocks``: with the frame before and the rest of the last one."""
    return read_blocks(spark, path, frames * spec.hop, before=spec.hop, after=max(0, spec.length - spec.hop), **options)
