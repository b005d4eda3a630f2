"""Document fingerprints by winnowing."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F, Window

K, WINDOW = 3, 8
POS_BITS = 29
PIECE = r"\S{1,16}"
#: Most ranges the ids are cut into; a range grows with the corpus beyond that.
MAX_CUTS = 1 << 14


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = WINDOW) -> DataFrame:
    """Add ``out``: array<struct<hash,pos>> of winnowed word k-gram hashes, by position.

    Words over 16 characters are cut into pieces of 16. Of every ``w``
    consecutive hashes the smallest is kept, the rightmost of equals, so any
    run of ``w + k - 1`` equal words shares a kept hash. The leading 34 bits and the
    reversed place share one long, whose minimum is the rule; all 64 bits are kept. Fewer than ``k``
    words make one gram; no words, and null, an empty fingerprint.
    """
    gram = lambda x, i: F.xxhash64(x, *(F.get("_t", i + j) for j in range(1, k)))
    packed = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - 34), POS_BITS) + (
        F.lit(2**POS_BITS - 1) - i)
    place = lambda p: (F.lit(2**POS_BITS - 1) - p.bitwiseAND(2**POS_BITS - 1)).cast("int")
    count = F.greatest(F.size("_t") - (k - 1), F.least(F.size("_t"), F.lit(1)))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_h") - (w - 1), F.lit(1)))
    kept = F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice("_h", i, w))))
    return (
        df.withColumn("_t", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)))
        .withColumn("_g", F.slice(F.transform("_t", gram), F.lit(1), count))
        .withColumn("_h", F.transform("_g", packed))
        .withColumn("_m", F.when(F.size("_h") > 0, kept).otherwise(F.array().cast("array<bigint>")))
        .withColumn(out, F.transform("_m", lambda p: F.struct(F.get("_g", place(p)).alias("hash"), place(p).alias("pos"))))
        .drop("_t", "_g", "_h", "_m")
    )


def hashes(fingerprint: str | Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda s: s["hash"]))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either).cast("double")


def _cuts(docs: DataFrame, bucket_rows: int) -> tuple[list[int], dict[int, int], int]:
    """Quantiles of the ids, about ``bucket_rows`` apart but at most ``MAX_CUTS``; ids heavier than
    one distance with the hash bits that split them; the bits for null ids."""
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    wanted = min(MAX_CUTS, n // bucket_rows)
    if not wanted:
        return [], {}, 0
    share = n / (wanted + 1)
    found = docs.agg(F.percentile_approx("doc_id", [i / (wanted + 1) for i in range(1, wanted + 1)], 4 * wanted)).first()[0] or []
    counted = Counter(found)
    return sorted(counted), {k: m.bit_length() for k, m in counted.items() if m > 1}, int(nulls / share).bit_length()


def _place(cuts: list[int], k: Column) -> Column:
    """How many cuts are at most ``k``, in two steps."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= k))
    group = below(F.array(*[F.lit(g[0]) for g in groups]).cast("array<bigint>")) - 1
    inside = F.get(F.array(*[F.array(*[F.lit(c) for c in g]).cast("array<bigint>") for g in groups]), group)
    return F.when(group >= 0, group * step + below(inside)).otherwise(0)


def with_next(docs: DataFrame, bucket_rows: int = 1024) -> DataFrame:
    """Rows (bucket, lead, k, h, text, ghost): every bucket ends with the row that follows it.

    Buckets lie between counted quantiles of the ids, however these are spread. A repeated id or null
    that alone fills more than a bucket is split by leading bits of its texts' hashes (``lead``).
    Only the first row of each bucket is copied, to the end of the bucket before.
    """
    cuts, heavy, null_bits = _cuts(docs, bucket_rows)
    k, null = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()
    bits = F.when(null, F.lit(null_bits))
    if heavy:
        bits = F.coalesce(bits, F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in heavy.items() for x in pair]), k).cast("int"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", k.alias("k"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"),
        F.when(null, -1).otherwise(_place(cuts, k)).alias("bucket"), bits.alias("_bits"))
    lead = F.when(F.col("_bits").isNotNull(), F.call_function("shiftright", "h", 63 - F.col("_bits"))).otherwise(F.lit(1 << 62))
    rows = rows.withColumn("lead", lead).drop("_bits")
    heads = rows.groupBy("bucket", "lead").agg(F.max(F.struct("k", "h")).alias("first"))
    # At most twice MAX_CUTS rows, and as many again for null ids.
    order = Window.orderBy(F.desc("bucket"), F.desc("lead"))
    whole = Window.partitionBy()
    top = F.max(F.struct("bucket", "lead", "first")).over(whole)
    ends = heads.withColumn("_next", F.coalesce(F.lead(F.struct("bucket", "lead", "first")).over(order), top)).select(
        F.col("bucket").alias("to"), F.col("lead").alias("to_lead"), "_next.bucket", "_next.lead", "_next.first.k", "_next.first.h")
    ghosts = rows.join(ends, ["bucket", "lead", "k", "h"]).groupBy("to", "to_lead").agg(F.min("text").alias("text")).select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"),
        F.col("to").alias("bucket"), F.col("to_lead").alias("lead"), F.lit(1).alias("ghost"))
    return rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)


def fingerprint_edits(docs: DataFrame, bucket_rows: int = 1024) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's start.

    The order is descending doc_id, then a hash of the text; null ids come last. Text is
    shuffled once, by id range. Repeated rows stay; a lone row follows itself. Null
    text is empty; texts may have any length Spark's strings allow. Extra columns are ignored.
    """
    order = Window.partitionBy("bucket", "lead").orderBy("ghost", F.desc("k"), F.desc("h"), F.desc("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs, bucket_rows).withColumn("next_text", F.lead("text").over(order)).withColumn(
        "n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring("next_text", F.lit(1), half))))
    rows = with_fingerprint(with_fingerprint(rows, "text", "f"), "edited", "e")
    rows = rows.select("bucket", "lead", "ghost", "k", "h", "text", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       hashes("f").alias("f"), hashes("e").alias("e"), F.size("f").alias("n_kept"))
    rows = rows.withColumn("g", F.lead("f").over(order)).filter("ghost = 0")
    spelt = lambda c: F.array_join(F.transform(c, lambda h: F.lower(F.hex(h))), " ")
    return rows.select("doc_id", "n_chars", "edited_sha256", spelt("f").alias("fingerprint"),
                       spelt("e").alias("edited_fingerprint"), likeness("f", "e").alias("near_edited"),
                       likeness("f", "g").alias("near_next"), "n_kept")
