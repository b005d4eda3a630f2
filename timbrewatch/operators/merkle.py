"""The audit log as a Merkle mountain range per call.

Entries are leaves in the order of ``seq``. Node ``(level, at)`` covers the
``2**level`` leaves from ``at * 2**level`` on and exists once all of them do, so appending
adds nodes and changes none. The complete nodes that no other covers are the peaks;
folded from the right they give the root. A root that is kept elsewhere pins every
entry before it: altered, moved, dropped or rewritten ones no longer lead to it, however
consistently the log itself was changed.

Eight levels are built per shuffle, inside groups of 256 nodes; a long call spreads
over its groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.functions.hashing import entry_digest

#: Levels built per shuffle, and shuffles: trees of up to 2**(FOLD * STAGES) leaves per call.
FOLD, STAGES = 8, 4
GROUP = 1 << FOLD
# Fixed values of the stored format: leaves and inner nodes are hashed apart.
LEAF, INNER = "0", "1"
NODE = ["call_id", "level", "at", "hash"]


def leaf_hash(digest: Column) -> Column:
    return F.sha2(F.concat(F.lit(LEAF), digest), 256)


def node_hash(left: Column, right: Column) -> Column:
    """Null where a child is missing."""
    return F.sha2(F.concat(F.lit(INNER), left, right), 256)


def _pow2(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int"))


def _shift(x: Column, by: Column | int) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.call_function("shiftright", x, by.cast("int"))


def leaves(stored: DataFrame) -> DataFrame:
    """Level 0: one node per audit entry."""
    return stored.select("call_id", F.lit(0).alias("level"), (F.col("seq") - 1).alias("at"), leaf_hash(entry_digest()).alias("hash"))


def _levels(lowest: Column, known, base: int) -> Column:
    """Nodes of the ``FOLD`` levels above a group's lowest, as array<struct<level,at,hash>>.

    A fold over levels, since each level as a column of its own would be put into the next
    one twice, and be evaluated anew in every place.
    """
    def named(at: Column, depth: Column) -> Column:
        width = _shift(F.lit(GROUP).cast("bigint"), depth)
        nodes = F.transform(at, lambda h, i: F.struct(
            (depth + base).alias("level"), (F.col("_group") * width + i).alias("at"),
            F.when(known(depth * GROUP + i).isNull(), h).alias("hash")))
        return F.filter(nodes, lambda n: n["hash"].isNotNull())

    def step(acc: Column, depth: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.call_function("div", F.size(acc["at"]), F.lit(2)).cast("int") - 1)
        above = F.transform(pairs, lambda i: F.coalesce(
            node_hash(F.get(acc["at"], i * 2), F.get(acc["at"], i * 2 + 1)), known(depth * GROUP + i)))
        made = F.when(acc["depth"] > 0, named(acc["at"], acc["depth"])).otherwise(acc["made"])
        return F.struct(depth.alias("depth"), above.alias("at"), F.concat(acc["made"], made).alias("made"))

    start = F.struct(F.lit(0).alias("depth"), lowest.alias("at"), F.array().cast("array<struct<level:int,at:bigint,hash:string>>").alias("made"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), start, step, lambda acc: F.concat(acc["made"], named(acc["at"], acc["depth"])))


def tree_nodes(new: DataFrame, peaks: DataFrame | None = None) -> DataFrame:
    """All nodes that the leaves ``new`` complete, themselves included.

    ``peaks`` (``NODE`` columns) are those of the stored log that the leaves continue; only
    they are read of it. Above a missing leaf there are no nodes.
    """
    level = new.select(*NODE)
    nodes = level
    for stage in range(STAGES):
        base = stage * FOLD
        inputs = level.select(*NODE, F.lit(False).alias("_old"))
        if peaks is not None:
            inputs = inputs.unionByName(
                peaks.where(F.col("level").between(base, base + FOLD - 1)).select(*NODE, F.lit(True).alias("_old")))
        depth = F.col("level") - base
        inside = F.col("at") - (_shift(F.col("at"), F.lit(FOLD) - depth) * _pow2(F.lit(FOLD) - depth))
        rows = inputs.groupBy("call_id", _shift(F.col("at"), F.lit(FOLD) - depth).alias("_group")).agg(
            F.array_sort(F.collect_list(F.struct((depth * GROUP + inside).alias("k"), "hash"))).alias("_list"),
            F.bool_or("_old").alias("_mixed"), F.bool_or(~F.col("_old")).alias("_new")).where("_new")
        full = (F.size("_list") == GROUP) & ~F.col("_mixed")
        # Through a generator: a map made in a plain column would be made anew for each look-up.
        rows = rows.select("call_id", "_group", F.inline(F.array(F.struct(
            F.when(full, F.transform("_list", lambda x: x["hash"])).alias("_all"), F.when(~full, F.map_from_entries("_list")).alias("_known")))))
        known = lambda k: F.try_element_at("_known", k.cast("bigint"))
        lowest = F.coalesce("_all", F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), known))
        found = rows.select("call_id", F.explode_outer(_levels(lowest, known, base)).alias("_n")).select(
            "call_id", "_n.*").where("hash IS NOT NULL")
        nodes = nodes.unionByName(found)
        level = found.where(F.col("level") == base + FOLD)
    return nodes


def _mountains(n: Column) -> Column:
    """The peaks of ``n`` leaves, from the largest: array<struct<level,at>>."""
    levels = F.filter(F.sequence(F.lit(FOLD * STAGES), F.lit(0)), lambda b: F.pmod(_shift(n, b), F.lit(2)) == 1)
    return F.transform(levels, lambda b: F.struct(b.alias("level"), (_shift(n, b + 1) * 2).alias("at")))


def bag(hashes: Column) -> Column:
    """The root over peaks given from the largest."""
    return F.aggregate(F.reverse(hashes), F.lit(None).cast("string"), lambda acc, h: F.when(acc.isNull(), h).otherwise(node_hash(h, acc)))


def sizes_of(stored: DataFrame) -> DataFrame:
    return stored.groupBy("call_id").agg(F.max("seq").alias("n_entries"))


def _fetch(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Look up (call_id, level, at); a missing node has a null hash. Keys are unique on the node side."""
    return wanted.join(nodes.select(*NODE), ["call_id", "level", "at"], "left")


def peaks_of(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """The peaks of each call at ``n_entries`` leaves, at most one per binary digit."""
    places = sizes.select("call_id", "n_entries", F.inline_outer(_mountains(F.col("n_entries"))))
    return _fetch(places, nodes).select("call_id", "n_entries", "level", "at", "hash")


def roots(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``call_id, n_entries, root`` at the given sizes, which may be those of an earlier log.

    The root is null where the log has not got that many entries without a hole.
    """
    peaks = peaks_of(nodes, sizes)
    sorted_peaks = F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("o"), "hash")))
    return peaks.groupBy("call_id", "n_entries").agg(
        sorted_peaks.alias("_p"), F.bool_and(F.col("hash").isNotNull()).alias("_whole")).select(
        "call_id", "n_entries", F.when(F.col("_whole"), bag(F.transform("_p", lambda p: p["hash"]))).alias("root"))


def proofs(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Proofs that nodes belong to logs of a size.

    ``wanted``: ``call_id, n_entries, level, at``, unique. Adds ``hash`` (the node), ``path`` (siblings up to
    its peak, array<struct<level,at,hash>>) and ``peaks`` (all peaks, from the largest). Per
    proof, as many hashes are read as the size has binary digits, or fewer.
    """
    n, level, at = F.col("n_entries"), F.col("level"), F.col("at")
    key = ["call_id", "n_entries", "level", "at"]
    first = at * _pow2(level)
    top = F.element_at(F.filter(_mountains(n), lambda m: _shift(first, m["level"]) == m["at"]), 1)
    rows = wanted.select(*key, top["level"].alias("_top"))
    steps = F.when(F.col("_top") > level, F.sequence(level, F.col("_top") - 1)).otherwise(F.array().cast("array<int>"))
    sibling = F.transform(steps, lambda b: F.struct(
        F.lit("path").alias("part"), b.alias("l"), _shift(at, b - level).bitwiseXOR(F.lit(1).cast("bigint")).alias("a")))
    tops = F.transform(_mountains(n), lambda m: F.struct(F.lit("peaks").alias("part"), m["level"].alias("l"), m["at"].alias("a")))
    own = F.array(F.struct(F.lit("own").alias("part"), level.alias("l"), at.alias("a")))
    places = rows.select(*[F.col(c).alias(f"_{c}") if c in ("level", "at") else c for c in key], F.inline_outer(F.concat(own, sibling, tops))).select(
        "call_id", "n_entries", "_level", "_at", "part", F.col("l").alias("level"), F.col("a").alias("at"))
    found = _fetch(places, nodes)
    of = lambda part, order: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct(
        order.alias("o"), "level", "at", "hash"))))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["level"].alias("level"), x["at"].alias("at"), x["hash"].alias("hash")))
    return found.groupBy("call_id", "n_entries", "_level", "_at").agg(
        F.max(F.when(F.col("part") == "own", F.col("hash"))).alias("hash"), of("path", F.col("level")).alias("_path"),
        of("peaks", -F.col("level")).alias("_peaks")).select(
        "call_id", "n_entries", F.col("_level").alias("level"), F.col("_at").alias("at"), "hash",
        plain("_path").alias("path"), plain("_peaks").alias("peaks"))


def climb(hash: Column, path: Column) -> Column:
    """The hash at the top of a path; a sibling with an even place is on the left."""
    return F.aggregate(path, hash, lambda acc, s: F.when(
        F.pmod(s["at"], F.lit(2)) == 0, node_hash(s["hash"], acc)).otherwise(node_hash(acc, s["hash"])))


def proven_root(proof_hash: str = "hash") -> Column:
    """The root that a proof leads to: the climbed peak in its place among the others. Needs no log."""
    top = climb(F.col(proof_hash), F.col("path"))
    level = F.col("level") + F.size("path")
    at = _shift(F.col("at"), F.size("path"))
    return bag(F.transform("peaks", lambda p: F.when((p["level"] == level) & (p["at"] == at), top).otherwise(p["hash"])))


def inclusion_proofs(nodes: DataFrame, sizes: DataFrame, entries: DataFrame) -> DataFrame:
    """Proofs of single entries (``call_id, seq``) against the roots at ``sizes``."""
    wanted = entries.select("call_id", (F.col("seq") - 1).alias("at")).join(sizes, "call_id").where(
        F.col("at") < F.col("n_entries")).select("call_id", "n_entries", F.lit(0).alias("level"), "at")
    return proofs(nodes, wanted)


def consistency_proofs(nodes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Proofs that the log at ``new`` sizes begins with the log at ``old`` sizes.

    The path of the smallest old peak passes, as left siblings, all old peaks of its
    mountain; the larger ones are still peaks. So one path gives both roots: see `old_root`.
    """
    smallest = F.element_at(_mountains(F.col("old_entries")), -1)
    wanted = old.select("call_id", F.col("n_entries").alias("old_entries")).join(new, "call_id").where(
        (F.col("old_entries") > 0) & (F.col("old_entries") <= F.col("n_entries"))).withColumn("_s", smallest).select(
        "call_id", "n_entries", "old_entries", F.col("_s.level").alias("level"), F.col("_s.at").alias("at"))
    return proofs(nodes, wanted).join(wanted.select("call_id", "n_entries", "level", "at", "old_entries"), ["call_id", "n_entries", "level", "at"])


def old_root() -> Column:
    """The root at ``old_entries`` that a consistency proof leads to."""
    level = F.col("level") + F.size("path")
    before = F.filter("peaks", lambda p: (p["level"] > level) & (p["at"] * _pow2(p["level"]) < F.col("old_entries")))
    lefts = F.filter("path", lambda s: F.pmod(s["at"], F.lit(2)) == 0)
    hashes = lambda c: F.transform(c, lambda x: x["hash"])
    return bag(F.concat(hashes(before), F.reverse(hashes(lefts)), F.array("hash")))


def check_kept(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """The log against roots that were kept elsewhere.

    ``kept``: ``call_id, n_entries, root``. Per kept root: how many entries the log has up to that
    size, and the problem if there is one. ``cut``: the end is gone. ``missing``: so are
    entries before it. ``rewritten``: all are there and lead to another root.
    """
    named = kept.select("call_id", "n_entries", F.col("root").alias("kept_root"))
    found = roots(tree_nodes(leaves(stored)), named)
    last = stored.groupBy("call_id").agg(F.max("seq").alias("_last"))
    problem = (
        F.when(F.coalesce("_last", F.lit(0)) < F.col("n_entries"), "cut").when(F.col("root").isNull(), "missing")
        .when(F.col("root") != F.col("kept_root"), "rewritten")
    )
    return named.join(found, ["call_id", "n_entries"], "left").join(last, "call_id", "left").select(
        "call_id", "n_entries", "kept_root", "root", problem.alias("problem"))


def changed_entries(stored: DataFrame, kept_nodes: DataFrame) -> DataFrame:
    """Which entries differ from the leaves kept at an earlier time: changed, gone, or added inside."""
    now = leaves(stored).select("call_id", (F.col("at") + 1).alias("seq"), F.col("hash").alias("_now"))
    then = kept_nodes.where("level = 0").select("call_id", (F.col("at") + 1).alias("seq"), F.col("hash").alias("_then"))
    last = then.groupBy("call_id").agg(F.max("seq").alias("_last"))
    both = then.join(now, ["call_id", "seq"], "full_outer").join(last, "call_id", "left")
    problem = F.when(F.col("_now").isNull(), "gone").when(F.col("_then").isNull() & (F.col("seq") <= F.col("_last")), "added").when(
        F.col("_now") != F.col("_then"), "changed")
    return both.select("call_id", "seq", problem.alias("problem")).where("problem IS NOT NULL")
