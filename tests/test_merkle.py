"""The Merkle log against a plain restatement, and what forgers try."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from timbrewatch.operators import audit, merkle
from timbrewatch.session import scratch_dir
from timbrewatch.sources.audit_store import append_audit, read_heads, read_log, read_nodes, read_roots

SIZES = {"a": 1, "b": 2, "c": 255, "d": 256, "e": 257, "f": 700, "g": 3}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_root(hashes):
    """Split at the largest power of two below the number of leaves."""
    if len(hashes) == 1:
        return hashes[0]
    k = 1 << (len(hashes) - 1).bit_length() - 1
    return sha("1" + tree_root(hashes[:k]) + tree_root(hashes[k:]))


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(f"{c}{i}", c, f"did:{c}", sha(f"{c}{i}"), i / 1000, "HIGH", i * 3000) for c, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(rows, "event_id string, call_id string, caller_did string, audio_hash string, spoof_prob double, tier string, at long").select(
        "event_id", "call_id", "caller_did", "audio_hash", "spoof_prob", "tier", F.timestamp_seconds("at").alias("event_ts"))


@pytest.fixture(scope="module")
def log(spark, entries):
    path = f"{scratch_dir(spark, 'test')}/log"
    audit.chain(entries).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nodes(spark, log):
    path = f"{scratch_dir(spark, 'test')}/nodes"
    merkle.tree_nodes(merkle.leaves(log)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def plain(nodes):
    out = {}
    for r in nodes.where("level = 0").orderBy("at").collect():
        out.setdefault(r.call_id, []).append(r.hash)
    return out


def roots_of(df):
    return {(r.call_id, r.n_entries): r.root for r in df.collect()}


def test_roots_equal_a_plain_tree(spark, log, nodes, plain):
    assert {c: len(h) for c, h in plain.items()} == SIZES
    assert nodes.count() == sum(2 * n - n.bit_count() for n in SIZES.values())
    want = {(c, n): tree_root(plain[c]) for c, n in SIZES.items()}
    assert roots_of(merkle.roots(nodes, merkle.sizes_of(log))) == want
    earlier = spark.createDataFrame([("f", n) for n in (1, 2, 3, 511, 512, 513, 699)], "call_id string, n_entries long")
    assert roots_of(merkle.roots(nodes, earlier)) == {("f", r.n_entries): tree_root(plain["f"][:r.n_entries]) for r in earlier.collect()}
    beyond = spark.createDataFrame([("f", 701)], "call_id string, n_entries long")
    assert roots_of(merkle.roots(nodes, beyond)) == {("f", 701): None}


def test_appending_equals_building_at_once(log, nodes):
    seen, peaks = None, None
    for low, high in ((0, 1), (1, 130), (130, 256), (256, 300), (300, 700)):
        part = log.where(F.col("seq").between(low + 1, high))
        made = merkle.tree_nodes(merkle.leaves(part), peaks)
        seen = made if seen is None else seen.unionByName(made)
        peaks = merkle.peaks_of(seen, merkle.sizes_of(log.where(F.col("seq") <= high))).select(*merkle.NODE)
        seen, peaks = (df.sparkSession.createDataFrame(df.collect(), df.schema) for df in (seen, peaks))
    assert rows_of(seen, *merkle.NODE) == rows_of(nodes, *merkle.NODE)


def test_inclusion_proofs(spark, log, nodes, plain):
    found = merkle.inclusion_proofs(nodes, merkle.sizes_of(log), log)
    got = found.withColumn("root", merkle.proven_root()).collect()
    assert len(got) == sum(SIZES.values())
    for r in got:
        assert r.root == tree_root(plain[r.call_id]) and r.hash == plain[r.call_id][r.at]
        assert len(r.path) + len(r.peaks) - 1 <= 2 * r.n_entries.bit_length()
    forged = found.withColumn("hash", F.sha2(F.lit("other"), 256)).withColumn("root", merkle.proven_root()).collect()
    assert all(r.root != tree_root(plain[r.call_id]) for r in forged)


def test_proofs_read_few_nodes(spark, log, nodes):
    one = log.where("call_id = 'f' and seq = 300")
    (proof,) = merkle.inclusion_proofs(nodes, merkle.sizes_of(log), one).collect()
    assert len(proof.path) + len(proof.peaks) == 9 + 6


def test_consistency_proofs(spark, log, nodes, plain):
    pairs = [(c, m, n) for c, n in SIZES.items() for m in {1, 2, n // 3, n // 2, n - 1, n} if 0 < m <= n]
    for step in range(0, len(pairs), 6):  # one old size per call and run
        chosen = {}
        for c, m, n in pairs[step:step + 6]:
            chosen[c] = (c, m)
        old = spark.createDataFrame(list(chosen.values()), "call_id string, n_entries long")
        got = merkle.consistency_proofs(nodes, old, merkle.sizes_of(log)).withColumns(
            {"was": merkle.old_root(), "is": merkle.proven_root()}).collect()
        assert {(r.call_id, r.old_entries) for r in got} == set(chosen.values())
        for r in got:
            assert r.was == tree_root(plain[r.call_id][:r.old_entries]) and r["is"] == tree_root(plain[r.call_id])


def problems(stored, kept):
    return {r.call_id: r.problem for r in merkle.check_kept(stored, kept).collect() if r.problem}


def test_what_forgers_try(spark, entries, log, nodes):
    kept = merkle.roots(nodes, merkle.sizes_of(log))
    assert problems(log, kept) == {}
    block = F.col("call_id").eqNullSafe("f") & F.col("event_id").isin([f"f{i}" for i in range(256, 512)])
    rewritten = audit.chain(entries.withColumn("tier", F.when(block, "MEDIUM").otherwise(F.col("tier"))))
    assert problems(rewritten, kept) == {"f": "rewritten"} and audit.faults(rewritten).count() == 0
    assert problems(log.where("not (call_id = 'e' and seq > 250)"), kept) == {"e": "cut"}
    assert problems(log.where("not (call_id = 'd' and seq = 9)"), kept) == {"d": "missing"}
    split = F.when(F.col("call_id") == "g", F.concat("caller_did", F.lit("|x"))).otherwise(F.col("caller_did"))
    rest = F.when(F.col("call_id") == "g", F.lit("y")).otherwise(F.lit("x|y"))
    texts = log.withColumns({"caller_did": split, "audio_hash": F.when(F.col("call_id") == "g", rest).otherwise(F.col("audio_hash"))})
    moved = texts.withColumns({"caller_did": F.when(F.col("call_id") == "g", F.regexp_replace("caller_did", r"\|x$", "")).otherwise(F.col("caller_did")),
                               "audio_hash": F.when(F.col("call_id") == "g", F.lit("x|y")).otherwise(F.col("audio_hash"))})
    kept_g = merkle.roots(merkle.tree_nodes(merkle.leaves(texts)), merkle.sizes_of(texts))
    assert problems(moved, kept_g) == {"g": "rewritten"}
    changed = log.withColumn("spoof_prob", F.when((F.col("call_id") == "c") & (F.col("seq") == 77), 0.9).otherwise(F.col("spoof_prob"))).where(
        "not (call_id = 'a')")
    assert rows_of(merkle.changed_entries(changed, nodes), "call_id", "seq", "problem") == [("a", 1, "gone"), ("c", 77, "changed")]


def test_store_keeps_trees_and_heads(spark, entries, nodes, log):
    path = f"{scratch_dir(spark, 'test')}/store"
    for low, high in ((0, 5), (5, 300), (300, 700)):
        append_audit(entries.where(F.col("spoof_prob").between((low - 0.5) / 1000, (high - 0.5) / 1000)), path)
    assert rows_of(read_nodes(spark, path), *merkle.NODE) == rows_of(nodes, *merkle.NODE)
    assert roots_of(read_roots(spark, path)) == roots_of(merkle.roots(nodes, merkle.sizes_of(log)))
    assert read_heads(spark, path).where("call_id = 'f'").count() == 3


def test_broken_off_batch_is_written_again(spark, entries, log):
    import os
    import shutil

    path = f"{scratch_dir(spark, 'test')}/store"
    entries, log = (df.where("call_id in ('b', 'c', 'g')") for df in (entries, log))
    early, late = entries.where("spoof_prob < 0.1"), entries.where("spoof_prob >= 0.1")
    append_audit(early, path, writer="w", batch_id=0)
    append_audit(late, path, writer="w", batch_id=1)
    shutil.rmtree(f"{path}/heads/writer=w/batch_id=1")  # as if the batch had ended before its heads
    assert read_log(spark, path).count() == early.count() and os.path.isdir(f"{path}/log/writer=w/batch_id=1")
    append_audit(late, path, writer="w", batch_id=1)
    append_audit(late, path, writer="w", batch_id=1)
    append_audit(late, path, writer="other", batch_id=1)
    stored = read_log(spark, path)
    assert stored.count() == log.count() and audit.faults(stored).count() == 0
    assert roots_of(read_roots(spark, path)) == roots_of(merkle.roots(merkle.tree_nodes(merkle.leaves(log)), merkle.sizes_of(log)))
