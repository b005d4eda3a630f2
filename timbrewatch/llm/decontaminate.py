"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from timbrewatch.llm.common import materialise

WINDOW = 8
#: Benchmark windows up to this many are broadcast (about 200 bytes each); more are shuffled.
BROADCAST_WINDOWS = 500_000
UNITS = frozenset((
    "km m cm mm kg g mg lb lbs l ml mph mile miles meter meters metre metres hour hours minute minutes second seconds "
    "day days year years dollar dollars euro euros usd eur percent").split())
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
SLOT = "\x01"
#: Bits of the map of benchmark windows, code points handled at once, words a task remembers.
MAP_BITS, CHUNK, MEMO = 22, 1_000_000, 500_000
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(SLOT + kind)) for kind in "npu")
FOUND = "id long, text_mark long, stream int, size int, pos int, n_all int, h long, tokens array<string>"


class _Words(dict):
    """Number of each token met, with the hashes of its lower case and placeholders."""

    def __init__(self):
        super().__init__()
        self.plain, self.canon, self.exact, self.units, self.numbers = array("Q"), array("Q"), array("Q"), array("b"), array("b")

    def __missing__(self, token: str) -> int:
        low, number = token.lower(), token[0].isdecimal()
        h = int(NUMBER) if number else xxhash.xxh64_intdigest(low)
        self.plain.append(h)
        self.exact.append(xxhash.xxh64_intdigest(low, 1))
        self.canon.append(int(NAME) if token[0].isupper() else h)
        self.units.append(low in UNITS)
        self.numbers.append(number)
        self[token] = n = len(self.plain) - 1
        return n


def _roll(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` values."""
    m = len(values) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out * FACTOR + values[j:m + j]
    out = (out ^ (out >> np.uint64(29))) * SPREAD
    return out ^ (out >> np.uint64(32))


def _typed(token: str, unit: bool) -> str:
    """Lower case, led by U+0001 and n, u or p if a number, unit or name may be replaced there."""
    kind = "n" if token[0].isdecimal() else "u" if unit else "p" if token[0].isupper() else ""
    return f"{SLOT}{kind}{token.lower()}" if kind else token.lower()


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    sizes = batch["text"].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
    for _, part in batch.groupby(np.cumsum(sizes) // CHUNK, sort=False):
        yield part


def template_windows(df: DataFrame, lengths: list[int], known: bytes | None = None, exact: bool = True) -> DataFrame:
    """Windows of the tokens of (id, text_mark, text), hashed in three forms.

    Stream 0 has numbers, and units behind them, as placeholders; stream 1 has
    capitalised words as name placeholders too, and only windows where that
    makes a difference. Stream 2, if ``exact``, has all tokens as they are. ``known`` is a bit map of hashes: other windows are left
    out. Without it a text gives windows of one length, the greatest of
    ``lengths`` that it has. Texts are handled in chunks, so memory is bounded by the longest text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        seen = None if known is None else np.unpackbits(np.frombuffer(known, np.uint8)).view(bool)
        for batch in batches:
            for part in _chunks(batch):
                tokens: list[str] = []
                ends = []
                for text in part["text"]:
                    tokens += TOKEN.findall(text) if isinstance(text, str) else ()
                    ends.append(len(tokens))
                if not tokens:
                    continue
                if len(words) > MEMO:
                    words = _Words()
                at = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
                ends = np.array(ends)
                counts = np.diff(ends, prepend=0)
                row = np.repeat(np.arange(len(ends)), counts)
                unit = np.frombuffer(words.units, np.int8)[at].astype(bool)
                unit[1:] &= np.frombuffer(words.numbers, np.int8)[at][:-1].astype(bool) & (row[1:] == row[:-1])
                unit[0] = False
                streams = [np.where(unit, UNIT, np.frombuffer(x, np.uint64)[at]) for x in (words.plain, words.canon)]
                if exact:
                    streams.append(np.frombuffer(words.exact, np.uint64)[at])
                ids, marks = part["id"].to_numpy(), part["text_mark"].to_numpy()
                for n in lengths:
                    if len(tokens) < n:
                        continue
                    first = row[:len(tokens) - n + 1]
                    whole = first == row[n - 1:]
                    if seen is None:
                        whole &= n == np.minimum(counts, max(lengths))[first]
                    for stream, values in enumerate(streams):
                        h = _roll(values, n)
                        take = whole & (h != plain) if stream == 1 else whole
                        plain = h
                        if seen is not None:
                            take = take & seen[h & np.uint64((1 << MAP_BITS) - 1)]
                        hits = np.flatnonzero(take)
                        if len(hits):
                            r = row[hits]
                            yield pd.DataFrame({
                                "id": ids[r], "text_mark": marks[r], "stream": stream, "size": n,
                                "pos": hits - (ends - counts)[r] + 1, "n_all": counts[r] - n + 1, "h": h[hits].view(np.int64),
                                "tokens": [[_typed(tokens[k], unit[k]) for k in range(i, i + n)] for i in hits.tolist()]})

    return df.mapInPandas(run, FOUND)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """(id, text_mark, text); a null id is the smallest long."""
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("text_mark"), "text")


def _agreed(hits: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``hit`` (places of the item that were met) and ``at`` (those that count) from windows with their slots.

    A slot pair gets the votes of the windows that hold it. It is agreed if a verbatim window holds
    it, or if it is the best pair of its item value and of its document value: pairs of
    verbatim windows first, then by votes. Counts over the slots, so linear in them but for sorting.
    """
    windows = hits.groupBy(*key, "i_pos", "exact", "slots").agg(F.lit(1).alias("one")).withColumn("slots_mark", F.xxhash64("slots"))
    slots = windows.select(*key, "i_pos", "exact", "slots_mark", F.inline_outer(F.array_distinct("slots"))).repartition(*key)
    pair, item, text = (Window.partitionBy(*key, *c) for c in (("i", "d"), ("i",), ("d",)))
    voted = slots.withColumns({"votes": F.count("*").over(pair), "sure": F.max("exact").over(pair)})
    voted = voted.withColumns({"best_d": F.max(F.struct("sure", "votes", "d")).over(item)["d"],
                               "best_i": F.max(F.struct("sure", "votes", "i")).over(text)["i"]})
    fine = F.col("i").isNull() | F.col("sure") | ((F.col("best_d") == F.col("d")) & (F.col("best_i") == F.col("i")))
    judged = voted.groupBy(*key, "i_pos", "exact", "slots_mark").agg(F.min(fine).alias("fine"))
    return judged.groupBy(*key).agg(
        F.size(F.collect_set("i_pos")).alias("hit"), F.collect_set(F.when(F.col("exact") | F.col("fine"), F.col("i_pos"))).alias("at"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_cover: float = 0.5,
                       min_run: int = 6) -> DataFrame:
    """(id, text_mark, item_id, coverage, n_windows) of the benchmark items found in documents.

    All windows of ``window`` template tokens are hash-joined; an item with fewer
    tokens is one window of its own length. Hits with one offset belong
    together. Windows whose slots hold the item's own values count. Other numbers or names
    may replace the item's where they are consistent with these and each other: equal item values stand for equal
    document values and the reverse. Windows that contradict are left out,
    and decide only where they are not outnumbered at their offset. An item is found where hits cover
    ``min_cover`` of its windows or ``min_run`` of them, each counted once however often it stands in the text. Windows with fewer than
    half plain words are too general for placeholders and count where all their tokens, numbers included, are equal.

    Null and empty texts and items match nothing. Repeated rows and items
    count once; ``text_mark`` is the hash of the text, so rows that share a doc_id stay apart.
    Only windows that meet the bit map of the benchmark's leave the scan, and the
    hash join and the slots decide on them. A null id is the smallest long.
    """
    items = template_windows(_keyed(benchmark, "item_id").distinct(), list(range(1, window + 1)))
    fixed = F.filter("tokens", lambda t: ~t.rlike(f"^{SLOT}[nu]") & ((F.col("stream") == 0) | ~F.startswith(t, F.lit(SLOT))))
    words = F.filter("tokens", lambda t: ~t.rlike(f"^{SLOT}[nu]"))
    kept = F.when(F.col("stream") == 2, F.size(words) * 2 < F.col("size")).otherwise(F.size(fixed) * 2 >= F.col("size"))
    known = materialise(items.filter(kept).select("stream",
        F.col("id").alias("item_id"), F.col("text_mark").alias("i_mark"), "size", F.col("pos").alias("i_pos"), "n_all", "h",
        F.col("tokens").alias("i_tokens")), "benchmark-windows")
    n_known = known.count()
    sizes = known.groupBy("size").agg(F.max("stream").alias("stream")).collect()
    lengths = sorted(r["size"] for r in sizes)
    seen = np.ones(1 << MAP_BITS, np.uint8)
    if n_known <= BROADCAST_WINDOWS:  # a larger benchmark would fill the map: all windows go to the join
        seen[:] = 0
        slots = known.select(F.col("h").bitwiseAND((1 << MAP_BITS) - 1).alias("slot")).distinct().collect()
        seen[[r["slot"] for r in slots]] = 1
        known = F.broadcast(known)
    found = template_windows(_keyed(docs, "doc_id"), lengths, np.packbits(seen).tobytes(), any(r["stream"] == 2 for r in sizes)).select(
        "id", "text_mark", "size", "pos", "h", "tokens")
    value = lambda t: F.when(F.startswith(t, F.lit(SLOT)), F.substring(t, 3, 1 << 20)).otherwise(t)
    kind = lambda t: F.when(F.startswith(t, F.lit(SLOT)), F.substring(t, 1, 2)).otherwise(t)
    pairs = F.zip_with("tokens", "i_tokens", lambda d, i: F.struct(
        value(i).alias("i"), value(d).alias("d"), (kind(i) == kind(d)).alias("alike"),
        (F.startswith(i, F.lit(SLOT)) | F.startswith(d, F.lit(SLOT))).alias("slot")))
    hits = found.join(known, ["h", "size"]).select(
        "stream", "id", "text_mark", "item_id", "i_mark", "n_all", "i_pos", (F.col("pos") - F.col("i_pos")).alias("offset"), pairs.alias("pairs"))
    hits = hits.filter(F.forall("pairs", lambda p: (p["alike"] & (F.col("stream") < 2)) | (p["i"] == p["d"])))
    slots_of = F.transform(F.filter("pairs", lambda p: p["slot"]), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
    key = ["id", "text_mark", "item_id", "i_mark", "n_all", "offset"]
    runs = _agreed(hits.select(*key, "i_pos", F.forall("pairs", lambda p: p["i"] == p["d"]).alias("exact"), slots_of.alias("slots")), key)
    # A dropped or added word moves the offset, so runs at offsets within the item's length of each other count together.
    # Each is put into two overlapping ranges of offsets; a place of the item counts once in a range.
    width = F.greatest(F.col("n_all"), F.lit(window))
    ranges = runs.filter(F.size("at") * 2 > F.col("hit")).withColumn("zone", F.floor(F.col("offset") / width)).withColumn(
        "zone", F.explode(F.array("zone", F.col("zone") + 1)))
    return ranges.groupBy("id", "text_mark", "item_id", "i_mark", "n_all", "zone").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("n_windows")).filter(
        (F.col("n_windows") >= min_run) | (F.col("n_windows") >= min_cover * F.col("n_all"))).groupBy(
        "id", "text_mark", "item_id").agg(F.max(F.col("n_windows") / F.col("n_all")).alias("coverage"), F.max("n_windows").alias("n_windows"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` plus ``items`` (found item_ids) and ``coverage``."""
    found = find_contamination(docs, benchmark).groupBy(F.col("id").alias("_id"), F.col("text_mark").alias("_mark")).agg(
        F.array_sort(F.collect_set("item_id")).alias("_items"), F.max("coverage").alias("_coverage"))
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_mark": F.xxhash64("text")})
    return keyed.join(found, ["_id", "_mark"], "left").select(
        *docs.columns, F.coalesce("_items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("_coverage", F.lit(0.0)).alias("coverage"))
