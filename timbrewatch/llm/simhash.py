"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from timbrewatch.llm.common import HOT_SHARE, materialise

BITS = 64
#: Node pairs handled at once, and the size up to which a node pair is compared leaf by leaf.
BLOCK, LEAF = 100_000, 64


def simhash(text: str | None, shingle: int, seed: int = 42) -> int:
    """A bit is set if it is in over half the shingle hashes; no words give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - shingle + 1)
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(h[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, mark, fp) per input row: ``mark`` hashes the text, so that rows which share an id can be told apart.

    Null text counts as empty for ``fp``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.fromiter((simhash(t, shingle) for t in batch["text"]), np.uint64, len(batch)).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "mark": batch["mark"], "fp": fps})

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInPandas(run, "doc_id long, mark long, fp long")


def roots(n: int, errors: int, node: int = 1) -> list[tuple[int, list[int]]]:
    """(prefix length, bit order) of each trie for ``n`` fingerprints.

    Of ``b`` blocks of bits, ``b - errors`` are equal in any linked pair, so each
    choice of those blocks, put first, gives a trie whose pairs need be followed
    only below one node of that depth. ``b`` grows until a node has about
    ``node`` members; walks below it prune, and fewer tries shuffle less.
    """
    want = max(1, n // node).bit_length()
    b = errors + 1
    while (b - errors) * BITS // b < want and b < errors + 4:
        b += 1
    edges = [i * BITS // b for i in range(b + 1)]
    blocks = [list(range(edges[i], edges[i + 1])) for i in range(b)]
    out = []
    for chosen in combinations(range(b), b - errors):
        first = [x for i in chosen for x in blocks[i]]
        out.append((len(first), first + [x for i in range(b) if i not in chosen for x in blocks[i]]))
    return out


def permute(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Put bits (0 is the highest) in another order, run by run."""
    out, at = np.zeros_like(fp), 0
    while at < BITS:
        end = at + 1
        while end < BITS and order[end] == order[end - 1] + 1:
            end += 1
        width = end - at
        mask = np.uint64((1 << width) - 1)
        out |= ((fp >> np.uint64(BITS - order[at] - width)) & mask) << np.uint64(BITS - at - width)
        at = end
    return out


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places, starting from earlier labels."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def trie_links(values: np.ndarray, firsts: np.ndarray, depth: int, errors: int) -> np.ndarray:
    """Component labels of sorted distinct ``values``; ``firsts`` are bounds of depth-``depth`` nodes.

    Pairs of nodes go down together, level by level; a pair adds one error when
    its branches differ and is dropped above ``errors``. Blocks of pairs are taken depth first, so memory is bounded.
    """
    n = len(values)
    label = np.arange(n)
    lo, hi = firsts[:-1], firsts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    if not len(lo):
        return label
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    cache: dict[int, np.ndarray] = {}
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > BLOCK:
            m = len(alo) // 2
            stack.append((d, *(x[m:] for x in (alo, ahi, blo, bhi, err))))
            stack.append((d, *(x[:m] for x in (alo, ahi, blo, bhi, err))))
            continue
        own = alo == blo
        work = (ahi - alo) * (bhi - blo)
        small = (work <= LEAF) | (d == BITS)
        if small.any():
            sa, sb, sw = alo[small], blo[small], work[small]
            width = (bhi - blo)[small]
            for at in range(0, len(sa), 8192):
                w = sw[at:at + 8192]
                which = np.repeat(np.arange(len(w)), w)
                k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                i = sa[at:at + 8192][which] + k // width[at:at + 8192][which]
                j = sb[at:at + 8192][which] + k % width[at:at + 8192][which]
                near = np.bitwise_count(values[i] ^ values[j]) <= errors
                label = components(n, i[near], j[near], label)
            keep = ~small
            alo, ahi, blo, bhi, err, own = (x[keep] for x in (alo, ahi, blo, bhi, err, own))
        if not len(alo):
            continue
        if d not in cache:
            cache[d] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1), dtype=np.int64)])
        c = cache[d]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        cross = ~own
        parts.append(tuple(x[cross] for x in (am, ahi, blo, bm, err + 1)))
        nlo, nhi, mlo, mhi, nerr = (np.concatenate(x) for x in zip(*parts))
        live = (nlo < nhi) & (mlo < mhi) & (nerr <= errors) & ~((nlo == mlo) & (nhi - nlo == 1))
        stack.append((d + 1, *(x[live] for x in (nlo, nhi, mlo, mhi, nerr))))
    return label


def trie_edges(classes: DataFrame, n: int, errors: int, node: int = 1) -> DataFrame:
    """(a, b): edges that connect, within each trie node, what the links connect (a < b)."""
    tries = roots(n, errors, node)
    order = [o for _, o in tries]
    depth = tries[0][0]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for t, o in enumerate(order):
                p = permute(fp, o)
                yield pd.DataFrame({"trie": np.int32(t), "node": (p >> np.uint64(BITS - depth)).astype(np.int64), "rest": p.view(np.int64)})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for t, part in frame.groupby("trie"):
                p = np.unique(part["rest"].to_numpy(np.int64).view(np.uint64))
                node = p >> np.uint64(BITS - depth)
                firsts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(p)]])
                label = trie_links(p, firsts, depth, errors)
                i = np.flatnonzero(label != np.arange(len(p)))
                back = np.argsort(order[t]).tolist()
                x, y = permute(p[i], back).view(np.int64), permute(p[label[i]], back).view(np.int64)
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        held = None
        for batch in batches:  # sorted: only the last node may go on in the next batch
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (held["trie"] == held["trie"].iat[-1]) & (held["node"] == held["node"].iat[-1])
            if not last.all():
                yield from links(held[~last])
                held = held[last]
        if held is not None and len(held):
            yield from links(held)

    spread_rows = classes.select("fp").mapInPandas(spread, "trie int, node long, rest long")
    dealt = spread_rows.repartition("trie", "node").sortWithinPartitions("trie", "node", "rest")
    return dealt.mapInPandas(walk, "a long, b long").distinct()


def connect(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """(fp, root): smallest fp of the component, for every fp with an edge.

    Rounds of: each node takes its smallest neighbour as parent, edges move to the
    parents, inner edges go. Parents are looked up by a join whose heavy keys,
    fewer than HOT_SHARE, are broadcast. Each round is a written table; the
    nodes left at least halve.
    """
    links = materialise(edges.filter("a <> b"), f"{name}-edges")
    steps: list[DataFrame] = []
    while links.take(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("parent"), F.count("*").alias("degree")),
                              f"{name}-parents")
        # Parents point to smaller nodes; following them twice shortens chains.
        up = parents.select(F.col("a").alias("parent"), F.col("parent").alias("upper"))
        parents = materialise(lookup(parents, up, "parent", parents.groupBy("parent").count())
                              .select(F.col("a").alias("node"), F.coalesce("upper", "parent").alias("to"), "degree"), f"{name}-up")
        steps.append(parents.select("node", "to"))
        to = parents.select("node", "to")
        degrees = parents.select("node", F.col("degree").alias("count"))
        moved = lookup(links, to.toDF("a", "x"), "a", degrees.toDF("a", "count"))
        moved = materialise(moved.select("b", "x"), f"{name}-half")
        moved = lookup(moved, to.toDF("b", "y"), "b", degrees.toDF("b", "count"))
        links = materialise(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                            f"{name}-edges")
    if not steps:
        return links.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    roots_of = steps[-1]
    for step in reversed(steps[:-1]):  # a node that stayed in later rounds has its root there
        sizes = materialise(step.groupBy("to").count(), f"{name}-sizes")
        later = roots_of.toDF("to", "root")
        roots_of = materialise(lookup(step, later, "to", sizes).select("node", F.coalesce("root", "to").alias("to")), f"{name}-roots")
    return roots_of.toDF("fp", "root")


def lookup(rows: DataFrame, values: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Left join to one row per key; keys above 1/HOT_SHARE of the rows are met by broadcast."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot_keys = materialise(counts.filter(F.col("count") * HOT_SHARE > total).select(key), "hot-keys")
    hot = F.broadcast(hot_keys)
    heavy = F.broadcast(hot_keys.join(values, key, "left"))
    return rows.join(heavy, key).unionByName(rows.join(hot, key, "left_anti").join(values, key, "left"))


def near_duplicates(docs: DataFrame, shingle: int = 5, errors: int = 4, node: int = 1) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) per input row: smallest doc_id reachable over near fingerprints.

    ``root`` names the component even where ids repeat.
    Fingerprints that differ in at most ``errors`` bits are linked; equal ones are
    joined first, so a group of copies is one trie leaf. Null and empty texts
    have fingerprint zero, which links like any other. A null doc_id gets the id
    of its component, and is ignored as a smallest one. Repeated rows stay.
    """
    return link_rows(materialise(fingerprints(docs, shingle), "simhash-rows"), errors, node)


def link_rows(rows: DataFrame, errors: int = 4, node: int = 1) -> DataFrame:
    """`near_duplicates` from written fingerprints."""
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")), "simhash-classes")
    edges = trie_edges(classes, classes.count(), errors, node)
    member = connect(edges)
    rooted = classes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("count"))
    named = materialise(named, "simhash-names")
    ids = materialise(lookup(rooted.select("fp", "root", F.col("count").alias("rows")), named.select("root", "component_id"), "root", named.select("root", "count")), "simhash-ids")
    return lookup(rows, ids.select("fp", "root", "component_id"), "fp", ids.select("fp", F.col("rows").alias("count"))).select(
        "doc_id", "mark", "fp", "root", "component_id")
