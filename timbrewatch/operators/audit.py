"""Tamper-evident audit log: records, chain, seals, verification and queries.

A hash chain is serial, so one chain per call would put a long call into one
task. Entries are numbered per call and chained in blocks of ``BLOCK``; a seal
per call, a hash tree over the heads of its blocks, ties the blocks together.
Every group has at most ``BLOCK`` members. A table cannot forbid changes; chain
and seal make them visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from timbrewatch.functions.hashing import GENESIS, entry_digest, link
from timbrewatch.plans.segments import Segments, position, time_segment

BLOCK = 256
# Levels of the tree above the blocks: BLOCK**(SEAL_LEVELS + 1) entries per call.
SEAL_LEVELS = 3
FLAGGED = ("MEDIUM", "HIGH")
ENTRY = ["event_id", "call_id", "caller_did", "audio_hash", "spoof_prob", "tier", "event_ts"]


def audit_record(verdicts: DataFrame, meta: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """Flagged verdicts as audit entries, with the audio hash and the caller.

    ``audio`` is ``call_id, seq, audio_hash``, unique per chunk; leave it out
    where the verdicts carry ``audio_hash`` already, as on a stream.
    """
    flagged = verdicts.where(F.col("tier").isin(*FLAGGED))
    if audio is not None:
        flagged = flagged.join(audio, ["call_id", "seq"])
    dids = meta.select("call_id", F.col("did").alias("caller_did"))
    return flagged.join(dids, "call_id", "left").select(*ENTRY)


def block_of(seq: Column, block: int = BLOCK) -> Column:
    return F.floor((seq - 1) / F.lit(block)).cast("bigint")


def chain(events: DataFrame, heads: DataFrame | None = None, block: int = BLOCK,
          segment_seconds: int = 3600) -> DataFrame:
    """Add ``seq``, ``prev_hash`` and ``entry_hash``.

    Within a block each hash covers the one before it; a block starts from a
    fixed word, and an entry's position is part of what is hashed. ``heads``
    (``call_id, seq, entry_hash`` of each call's last stored entry) continues
    stored chains; new entries then follow in arrival order.
    """
    spec = Segments(["call_id"], ["event_ts", "event_id"], time_segment("event_ts", segment_seconds))
    numbered = position(events, spec, "seq")
    if heads is not None:
        stored = heads.select("call_id", F.col("seq").alias("_seq"), F.col("entry_hash").alias("_hash"))
        numbered = numbered.join(stored, "call_id", "left").withColumn(
            "seq", F.col("seq") + F.coalesce("_seq", F.lit(0)))
        continues = block_of(F.col("seq"), block) == block_of(F.col("_seq"), block)
        start = F.coalesce(F.when(continues, F.col("_hash")), F.lit(GENESIS))
    else:
        start = F.lit(GENESIS)
    digested = numbered.withColumn("_digest", entry_digest()).withColumn("_start", start)
    payload = ["seq", "_digest", *[c for c in events.columns if c != "call_id"]]
    groups = digested.groupBy("call_id", block_of(F.col("seq"), block).alias("_block")).agg(
        F.first("_start").alias("_start"),
        F.array_sort(F.collect_list(F.struct(*payload))).alias("_entries"))
    hashes = F.aggregate("_entries", F.array("_start"), lambda acc, e: F.concat(
        acc, F.array(link(F.element_at(acc, -1), e["_digest"]))))
    linked = F.transform("_entries", lambda e, i: F.struct(
        e.alias("e"), F.get("_hashes", i).alias("prev_hash"), F.get("_hashes", i + 1).alias("entry_hash")))
    rows = (
        groups.withColumn("_hashes", hashes)
        .select("call_id", F.explode(linked).alias("_l"))
        .select("call_id", "_l.e.*", "_l.prev_hash", "_l.entry_hash")
    )
    return rows.select(*events.columns, "seq", "prev_hash", "entry_hash")


def heads_of(stored: DataFrame) -> DataFrame:
    """The last stored entry of each call."""
    return stored.groupBy("call_id").agg(
        F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))


def seal(chained: DataFrame, block: int = BLOCK) -> DataFrame:
    """``call_id, n_entries, seal``: a hash tree over each call's block heads.

    Keeping the seal elsewhere makes cutting off the end of a chain visible too.
    """
    level = (
        chained.groupBy("call_id", block_of(F.col("seq"), block).alias("_at"))
        .agg(F.count("*").alias("_n"), F.max_by("entry_hash", "seq").alias("_hash"))
    )
    for _ in range(SEAL_LEVELS):
        level = _fold(level, F.floor(F.col("_at") / F.lit(block)).cast("bigint"))
    return _fold(level, F.lit(0).cast("bigint")).select(
        "call_id", F.col("_n").alias("n_entries"), F.col("_hash").alias("seal"))


def _fold(level: DataFrame, parent: Column) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("_at", "_hash")))
    joined = F.array_join(F.transform(children, lambda c: c["_hash"]), "")
    return level.withColumn("_parent", parent).groupBy("call_id", "_parent").agg(
        F.sum("_n").alias("_n"), F.sha2(joined, 256).alias("_hash")
    ).withColumnRenamed("_parent", "_at")


def _checked(stored: DataFrame, block: int) -> DataFrame:
    """Entries with ``_block`` and the ``reason`` they are faulty, judged inside their block."""
    rows = stored.withColumn("_block", block_of(F.col("seq"), block))
    order = Window.partitionBy("call_id", "_block").orderBy("seq")
    first = (F.col("seq") - 1) % block == 0
    last_seq, last_hash = F.lag("seq").over(order), F.lag("entry_hash").over(order)
    gap = F.when(last_seq.isNull(), ~first).otherwise(F.col("seq") != last_seq + 1)
    expected = F.when(first, F.lit(GENESIS)).otherwise(last_hash)
    reason = (
        F.when(link(F.col("prev_hash"), entry_digest()) != F.col("entry_hash"), "altered")
        .when(gap, "missing_before")
        .when(F.col("prev_hash") != expected, "unlinked")
    )
    return rows.withColumn("reason", reason)


def _blocks(checked: DataFrame, block: int) -> DataFrame:
    """One row per block: its first entry, its faults, and whether the block before lost its end.

    The only step ordered by call; it sees one row per ``block`` entries.
    """
    summary = checked.groupBy("call_id", "_block").agg(
        F.count("*").alias("_n"), F.count("reason").alias("_faulty"),
        F.min("seq").alias("_seq"), F.max("seq").alias("_last"), F.min_by("event_id", "seq").alias("_event_id"),
        F.min(F.struct("seq", "reason"))["reason"].alias("_first_reason"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))).alias("_fault"))
    order = Window.partitionBy("call_id").orderBy("_block")
    follows = F.coalesce(F.lag("_last").over(order), F.lit(0)) == F.col("_block") * block
    torn = ~follows & F.col("_first_reason").isNull()
    return summary.withColumn("_torn", torn)


def faults(stored: DataFrame, block: int = BLOCK) -> DataFrame:
    """Entries that break their chain, with the reason.

    ``altered``: the hash does not fit the fields. ``unlinked``: the previous
    hash is not that of the entry before. ``missing_before``: entries before
    this one are gone.
    """
    checked = _checked(stored, block)
    inside = checked.where(F.col("reason").isNotNull()).select("call_id", "seq", "event_id", "reason")
    between = _blocks(checked, block).where("_torn").select(
        "call_id", F.col("_seq").alias("seq"), F.col("_event_id").alias("event_id"),
        F.lit("missing_before").alias("reason"))
    return inside.unionByName(between)


def verify_chain(stored: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per call: entries checked, faulty entries, and the first of them (null if sound).

    One pass over the log and one shuffle of it, on (call, block).
    """
    torn = F.when(F.col("_torn"), F.struct(F.col("_seq").alias("seq"), F.lit("missing_before").alias("reason")))
    return (
        _blocks(_checked(stored, block), block)
        .withColumn("_fault", F.least("_fault", torn))
        .groupBy("call_id")
        .agg(F.sum("_n").alias("n_entries"),
             F.sum(F.col("_faulty") + F.col("_torn").cast("bigint")).alias("n_broken"),
             F.min("_fault").alias("_fault"))
        .select("call_id", "n_entries", "n_broken",
                F.col("_fault.seq").alias("first_broken_seq"), F.col("_fault.reason").alias("reason"))
    )


def audit_query(events: DataFrame, n: int, caller: str | None = None, tier: str | None = None,
                since=None, until=None, after: tuple | None = None) -> DataFrame:
    """One page of log rows, newest first.

    ``after`` is the (event_ts, event_id) of the previous page's last row. Time
    bounds also apply to ``event_date`` where the table is partitioned by it.
    """
    rows = events
    if caller is not None:
        rows = rows.where(F.col("caller_did") == caller)
    if tier is not None:
        rows = rows.where(F.col("tier") == tier)
    if since is not None:
        rows = rows.where(F.col("event_ts") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("event_ts") < F.lit(until))
    if "event_date" in events.columns:
        if since is not None:
            rows = rows.where(F.col("event_date") >= F.to_date(F.lit(since)))
        if until is not None:
            rows = rows.where(F.col("event_date") <= F.to_date(F.lit(until)))
    if after is not None:
        ts, event_id = after
        rows = rows.where((F.col("event_ts") < F.lit(ts)) | (
            (F.col("event_ts") == F.lit(ts)) & (F.col("event_id") < F.lit(event_id))))
    return audit_feed(rows, n)


def audit_feed(events: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` log rows across calls, as a top-n and not a full sort."""
    return events.orderBy(F.desc("event_ts"), F.desc("event_id")).limit(n)


def unconfirmed(verdicts: DataFrame, events: DataFrame, confirmations: DataFrame) -> DataFrame:
    """High-risk verdicts without an audit entry, or without its confirmation."""
    high = verdicts.where(F.col("tier") == "HIGH").select("event_id", "call_id")
    logged = events.select("event_id")
    missing = high.join(logged, "event_id", "left_anti").withColumn("reason", F.lit("no_entry"))
    pending = (
        high.join(logged, "event_id", "left_semi")
        .join(confirmations.select("event_id"), "event_id", "left_anti")
        .withColumn("reason", F.lit("unconfirmed"))
    )
    return missing.unionByName(pending)


def ref_check(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Audit hashes without a stored reference, and references no entry uses.

    Entries are reduced to one row per hash before the join, so many copies of
    the same audio cost nothing there.
    """
    used = events.groupBy("audio_hash").agg(F.count("*").alias("n_entries"))
    stored = refs.groupBy("audio_hash").agg(F.min("uri").alias("uri"))
    return (
        used.join(stored, "audio_hash", "full_outer")
        .where(F.col("n_entries").isNull() | F.col("uri").isNull())
        .select("audio_hash", F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
                F.when(F.col("uri").isNull(), "dangling").otherwise("orphan").alias("problem"))
    )
