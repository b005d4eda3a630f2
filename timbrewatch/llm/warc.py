"""Legacy ARC records, their conversion to WARC, and the archives' way through storage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from timbrewatch.llm.common import join_counted, materialise
from timbrewatch.session import scratch_dir

# Fixed field lists of the two ARC versions, as their version lines give them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
NAMESPACE = uuid.NAMESPACE_URL
ARC_DATE = "20080101000000"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_version_block(version: int, name: str) -> bytes:
    """The record that opens an ARC file: its own header, the version line and the field list."""
    body = f"{version} 0 timbrewatch\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": ARC_DATE, "Content-type": "text/plain",
              "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, name: str, offset: int) -> bytes:
    """One ARC record. Signs that would end a header field are percent-encoded in the URL."""
    safe = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "unknown:"
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    values = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": ARC_DATE, "Content-type": "text/html", "Result-code": "200",
              "Checksum": hashlib.md5(payload).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name,
              "Archive-length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file. Its version line names the fields; lengths are declared.

    A header with a wrong number of fields or a length past the end raises ValueError.
    """
    def header(at: int, names: list[str]) -> tuple[dict[str, str], int]:
        end = data.index(b"\n", at)
        values = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if len(values) != len(names):
            raise ValueError(f"ARC header at {at} has {len(values)} fields instead of {len(names)}")
        fields = dict(zip(names, values))
        if end + 1 + int(fields["Archive-length"]) > len(data):
            raise ValueError(f"ARC record at {at} ends after the file")
        return fields, end + 1

    if not data:
        return
    first = data[:data.index(b"\n")].split(b" ")
    version = 1 if len(first) == len(ARC_FIELDS[1]) else 2
    fields, at = header(0, ARC_FIELDS[version])
    block = data[at:at + int(fields["Archive-length"])].split(b"\n")
    if int(block[0].split(b" ")[0]) != version:
        raise ValueError("ARC version line and header disagree")
    names = block[1].decode().split(" ")
    at += int(fields["Archive-length"]) + 1
    while at < len(data):
        fields, start = header(at, names)
        end = start + int(fields["Archive-length"])
        yield ArcRecord(fields, data[start:end])
        at = end + 1


def warc_record(arc: ArcRecord, page_key: str, refers_to: str | None) -> bytes:
    """The equivalent WARC record. Identifier, time, type and digests are synthesised.

    A record with ``refers_to`` is a revisit: it keeps the HTTP header and the
    digest and length of the payload it leaves out.
    """
    http, _, payload = arc.body.partition(b"\r\n\r\n")
    d = arc.fields["Archive-date"].ljust(14, "0")
    block = http + b"\r\n\r\n" + (b"" if refers_to else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(page_key)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {arc.fields['URL']}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-Key: {page_key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record, by declared lengths; digests are checked."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not re.fullmatch(r"WARC/1\.[01]", version):
            raise ValueError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        at, size = end + 4, int(head["Content-Length"])
        block = data[at:at + size]
        if len(block) != size or head["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"damaged WARC record {head['WARC-Record-ID']}")
        yield head, block
        at += size + 4


def resolve(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(page_id, row, refers_to): which page each row revisits, without moving payloads.

    Of equal payloads of ``min_revisit`` bytes or more the largest page_id is the
    response. ``row`` tells repeated page_ids apart by payload.
    """
    narrow = materialise(pages.select(
        F.col("page_id"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"),
        F.octet_length(F.coalesce("html", F.lit(""))).alias("size")), "page-digests")
    totals = materialise(narrow.groupBy("sha", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("n_rows")), "page-best")
    return join_counted(narrow, totals, ["sha", "size"]).filter(
        (F.col("size") >= min_revisit) & (F.col("page_id") != F.col("best"))).select("page_id", "sha", F.col("best").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0, records_per_file: int = 2000) -> None:
    """Write pages as WARC files through Spark's own writer, by way of ARC records.

    Each batch becomes an ARC file (version 2 where the digest of its first
    page is odd, else 1) and is converted. Records are UTF-8 text, so the text
    writer makes gzipped WARC files in any store; a lost task's file is written
    anew. Only payloads travel by page_id, once. Null html is an empty payload,
    null url ``unknown:``; repeated rows are written repeatedly.
    """
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), sha.alias("sha"))
    rows = rows.join(resolve(pages, min_revisit), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at:at + 64]
                ids = [None if pd.isna(x) else int(x) for x in part["page_id"]]
                refs = [None if pd.isna(x) else str(int(x)) for x in part["refers_to"]]
                version, name = 1 + int(hashlib.md5(part["html"].iat[0].encode()).hexdigest(), 16) % 2, f"pages-{ids[0]}.arc"
                pieces, offset = [arc_version_block(version, name)], 0
                for url, html in zip(part["url"], part["html"]):
                    offset += len(pieces[-1])
                    pieces.append(arc_record(version, url, html.encode(), name, offset))
                records = zip(read_arc(b"".join(pieces)), ids, refs)
                # The writer adds the last line feed.
                yield pd.DataFrame({"value": [warc_record(r, "" if i is None else str(i), f).decode()[:-1] for r, i, f in records]})

    (rows.withColumn("page_id", F.col("page_id").cast("decimal(20,0)")).withColumn("refers_to", F.col("refers_to").cast("decimal(20,0)"))
     .mapInPandas(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def read_archives(pages: DataFrame, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, stored) per record."""
    spark = pages.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for head, block in read_warc(gzip.decompress(data)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    sha, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                    if not revisit and digest(payload) != sha:
                        raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                    key = head["X-Page-Key"]
                    rows.append((int(key) if key else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), sha, head["WARC-Type"],
                                 int(head["X-Refers-To-Key"]) if revisit else None, head["WARC-Record-ID"], len(payload)))
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "stored"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long, record_id string, stored long")


def archive_pages(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit)
    return read_archives(pages, path)
