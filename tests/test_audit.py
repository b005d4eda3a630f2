import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from timbrewatch.operators import audit
from timbrewatch.session import scratch_dir
from timbrewatch.sources.audit_store import append_audit, read_log

BLOCK = 4


@pytest.fixture(scope="module")
def entries(spark):
    return spark.range(60).select(
        F.col("id").alias("event_id"), F.when(F.col("id") < 40, "long").otherwise("short").alias("call_id"),
        F.lit("did:x").alias("caller_did"), F.sha2(F.col("id").cast("string"), 256).alias("audio_hash"),
        (F.col("id") / 100).alias("spoof_prob"), F.lit("HIGH").alias("tier"),
        F.timestamp_seconds(F.col("id") * 50_000).alias("event_ts"))


@pytest.fixture(scope="module")
def log(spark, entries):
    path = f"{scratch_dir(spark, 'test')}/chain"
    audit.chain(entries, block=BLOCK).write.parquet(path)
    return spark.read.parquet(path)


def broken(df):
    return sorted((r["call_id"], r["seq"], r["reason"]) for r in audit.faults(df, BLOCK).collect())


def test_sound_chain_has_no_faults(log):
    assert broken(log) == []
    assert all(r["n_broken"] == 0 and r["first_broken_seq"] is None for r in audit.verify_chain(log, BLOCK).collect())


@pytest.mark.parametrize("seq", [1, 4, 5, 23])
def test_altered_entry_is_the_only_one_reported(log, seq):
    bad = log.withColumn("tier", F.when((F.col("call_id") == "long") & (F.col("seq") == seq), "LOW").otherwise(F.col("tier")))
    assert broken(bad) == [("long", seq, "altered")]
    row = {r["call_id"]: r for r in audit.verify_chain(bad, BLOCK).collect()}["long"]
    assert (row["n_broken"], row["first_broken_seq"], row["reason"]) == (1, seq, "altered")


@pytest.mark.parametrize("gone,reported", [([6], 7), ([5], 6), ([8], 9), ([5, 6, 7, 8], 9), ([1], 2)])
def test_deleted_entries_are_noticed_at_the_next_one(log, gone, reported):
    rest = log.where(~((F.col("call_id") == "long") & F.col("seq").isin(gone)))
    assert broken(rest) == [("long", reported, "missing_before")]
    row = {r["call_id"]: r for r in audit.verify_chain(rest, BLOCK).collect()}["long"]
    assert (row["n_broken"], row["first_broken_seq"]) == (1, reported)


def test_seal_shows_a_cut_end(log):
    def seals(df):
        return {r["call_id"]: (r["n_entries"], r["seal"]) for r in audit.seal(df, BLOCK).collect()}
    whole, cut = seals(log), seals(log.where("not (call_id = 'long' and seq = 40)"))
    assert whole["short"] == cut["short"] and whole["long"] != cut["long"] and whole["long"][0] == 40


def test_continuing_equals_chaining_at_once(entries, log):
    first = audit.chain(entries.where("event_id % 20 < 7"), block=BLOCK)
    rest = audit.chain(entries.where("event_id % 20 >= 7"), audit.heads_of(first), block=BLOCK)
    both = first.unionByName(rest)
    assert broken(both) == [] and both.count() == 60
    early = audit.chain(entries.where("event_id < 6"), block=BLOCK)
    late = audit.chain(entries.where("event_id >= 6"), audit.heads_of(early), block=BLOCK)
    assert rows_of(early.unionByName(late), "event_id", "entry_hash") == rows_of(log, "event_id", "entry_hash")


def test_store_ignores_replays_and_redelivery(spark, entries):
    path = f"{scratch_dir(spark, 'test')}/log"
    append_audit(entries.where("event_id < 30"), path)
    append_audit(entries.where("event_id < 30"), path)
    append_audit(entries.where("event_id between 20 and 59").unionAll(entries.where("event_id > 50")), path, max_call_days=60)
    stored = read_log(spark, path)
    assert stored.count() == 60
    assert audit.faults(stored).count() == 0
    assert rows_of(stored, "event_id", "entry_hash") == rows_of(audit.chain(entries), "event_id", "entry_hash")


def test_pages_follow_each_other(entries):
    seen, after = [], None
    while True:
        page = audit.audit_query(entries, 7, caller="did:x", tier="HIGH", after=after).collect()
        if not page:
            break
        seen += [r["event_id"] for r in page]
        after = (page[-1]["event_ts"], page[-1]["event_id"])
    assert seen == list(range(59, -1, -1))


def test_reconcile_reasons(spark, entries):
    logged = entries.where("event_id <> 3")
    confirmed = entries.where("event_id <> 5").select("event_id")
    got = audit.unconfirmed(entries, logged, confirmed)
    assert rows_of(got, "event_id", "reason") == [(3, "no_entry"), (5, "unconfirmed")]
