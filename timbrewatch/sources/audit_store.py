"""Append-only audit log on Parquet: entries, their Merkle nodes, and the heads of calls.

Each of the three tables has a folder per writer and batch. A batch writes entries
and nodes first and its heads last, and counts once these are there. A batch that
broke off half-way is thus not read, and repeating it overwrites what it left.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbrewatch.operators import merkle
from timbrewatch.operators.audit import ENTRY, chain, heads_of
from timbrewatch.sources.clips import exists

BATCH = ["writer", "batch_id"]
LOG, NODES, HEADS = "log", "nodes", "heads"
PEAKS = "array<struct<level:int,at:bigint,hash:string>>"


def _folder(path: str, table: str, writer: str, batch_id: int) -> str:
    return f"{path}/{table}/writer={writer}/batch_id={batch_id}"


def _batches(spark: SparkSession, path: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.withColumns({"writer": F.col("writer").cast("string"), "batch_id": F.col("batch_id").cast("bigint")})


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """Per batch and call: the last entry, the peaks of the tree, and the day of the latest entry."""
    return _batches(spark, path, HEADS)


def _committed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows of batches that have heads."""
    return rows.join(read_heads(spark, path).select(*BATCH).distinct(), BATCH, "left_semi")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All committed entries."""
    return _committed(_batches(spark, path, LOG), spark, path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All committed nodes of the calls' trees."""
    return _committed(_batches(spark, path, NODES), spark, path).select(*merkle.NODE)


def read_roots(spark: SparkSession, path: str) -> DataFrame:
    """``call_id, n_entries, root`` as of now: what to keep elsewhere. Reads the heads only."""
    latest = read_heads(spark, path).groupBy("call_id").agg(F.max_by(F.struct("seq", "peaks"), "seq").alias("_h"))
    return latest.select("call_id", F.col("_h.seq").alias("n_entries"), merkle.bag(F.col("_h.peaks.hash")).alias("root"))


def append_audit(entries: DataFrame, path: str, segment_seconds: int = 3600, max_call_days: int | None = None,
                 writer: str = "batch", batch_id: int | None = None) -> None:
    """Chain the entries not stored yet onto their calls and append them with their tree nodes.

    Safe to repeat: a batch is written under its number, and entries that another batch
    stored are left out by id, for which the id column of the batch's days is
    read. What a call continues comes from the heads, a row per call and batch, and
    not from the log; with ``max_call_days`` only heads of as many days are read. One
    writer per path at a time; without ``batch_id`` the writer's next number is used.
    """
    spark = entries.sparkSession
    # A redelivered verdict within the batch counts once.
    rest = [c for c in ENTRY if c != "event_id"]
    once = entries.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("_e")).select(
        "event_id", "_e.*").select(*ENTRY)
    # Read several times below; a lost copy is computed again from the batch.
    dated = once.withColumn("event_date", F.to_date("event_ts")).persist()
    fresh = dated
    try:
        days = dated.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi")).first()
        if days["lo"] is None:
            return
        heads = peaks = None
        if exists(spark, f"{path}/{HEADS}"):
            stored = read_heads(spark, path)
            if batch_id is None:
                batch_id = (stored.where(F.col("writer") == writer).agg(F.max("batch_id")).first()[0] or 0) + 1
            others = (F.col("writer") != writer) | (F.col("batch_id") != batch_id)
            same_days = read_log(spark, path).where(others & F.col("event_date").between(days["lo"], days["hi"]))
            fresh = dated.join(same_days.select("event_id", "event_date"), ["event_id", "event_date"], "left_anti").persist()
            stored = stored.where(others)
            if max_call_days is not None:
                stored = stored.where(F.col("last_date") >= days["lo"] - timedelta(days=max_call_days))
            latest = stored.join(fresh.select("call_id").distinct(), "call_id", "left_semi").groupBy("call_id").agg(
                F.max_by(F.struct("seq", "entry_hash", "peaks"), "seq").alias("_h"), F.max("last_date").alias("last_date")).select(
                "call_id", "_h.*", "last_date").persist()
            heads = latest.select("call_id", "seq", "entry_hash")
            peaks = latest.select("call_id", F.inline("peaks"))
        if batch_id is None:
            batch_id = 1
        target = {t: _folder(path, t, writer, batch_id) for t in (LOG, NODES, HEADS)}
        # Rebalancing gives a busy day several writers and a quiet one a single file.
        chain(fresh, heads, segment_seconds=segment_seconds).hint("rebalance", "event_date").write.mode(
            "overwrite").partitionBy("event_date").parquet(target[LOG])
        added = spark.read.schema(_log_schema(fresh)).option("basePath", target[LOG]).parquet(target[LOG])
        merkle.tree_nodes(merkle.leaves(added), peaks).write.mode("overwrite").parquet(target[NODES])
        made = spark.read.parquet(target[NODES])
        known = made if peaks is None else made.unionByName(peaks)
        last = heads_of(added).join(added.groupBy("call_id").agg(F.max("event_date").alias("last_date")), "call_id")
        tops = merkle.peaks_of(known, last.select("call_id", F.col("seq").alias("n_entries"))).groupBy("call_id").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("o"), "level", "at", "hash"))).alias("_p"))
        tops = tops.select("call_id", F.transform("_p", lambda p: F.struct(
            p["level"].alias("level"), p["at"].alias("at"), p["hash"].alias("hash"))).cast(PEAKS).alias("peaks"))
        last.join(tops, "call_id").select("call_id", "seq", "entry_hash", "peaks", "last_date").write.mode("overwrite").parquet(target[HEADS])
    finally:
        if fresh is not dated:
            fresh.unpersist()
            latest.unpersist()
        dated.unpersist()


def _log_schema(entries: DataFrame) -> str:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return f"{kinds}, seq bigint, prev_hash string, entry_hash string"
