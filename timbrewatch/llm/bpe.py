"""BPE encoding and decoding with a minimal acyclic word transducer."""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from timbrewatch.llm.common import materialise

# Fixed values of the tokenizer format: white space, and the pattern that finds pieces.
BLANK = r"\t-\r \x85\xa0  -     　"
SPACE = re.compile(f"[{BLANK}]+")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
WORD_END = "</w>"
#: Words compiled into the transducer, and unseen pieces a task remembers.
LEXICON_WORDS = 20_000
MEMO = 300_000


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Merger:
    """The exact merge rule over the vocabulary file. Symbols are ids throughout."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        #: Rank of a pair of ids (the left one in the upper bits), and the id each rank makes.
        self.ranks = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        self.made = [vocab["".join(m)] for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        signs = byte_signs()
        self.inner, self.final = [vocab[s] for s in signs], [vocab[s + WORD_END] for s in signs]

    def encode(self, piece: str) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        data = piece.encode()
        if not data:
            return []
        parts = [self.inner[b] for b in data]
        parts[-1] = self.final[data[-1]]
        if len(parts) > 64:
            return self._merge_long(parts)
        rank_of, none = self.ranks.get, len(self.made)
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            parts[at] = new = self.made[rank]
            del parts[at + 1], ranks[at]
            if at:  # only the pairs beside the new symbol changed
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | new, none)
            if at < len(ranks):
                ranks[at] = rank_of(new << 32 | parts[at + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same rule with a heap and links, for pieces of any length."""
        import heapq

        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.ranks[a << 32 | b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a << 32 | b in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (pair := parts[a] << 32 | parts[b]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], a, parts[a], parts[b]))
        return [p for p, live in zip(parts, alive) if live]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from word bytes to ids, as one flat file.

    States with equal futures are shared; an arc carries how many words sort
    before those behind it, so the sum along a path is the word's number, which
    finds its ids. Layout: counts, arcs of each state, arcs (byte, target, output), id offsets, ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    sizes: list[int] = []

    def settle(node: dict) -> int:
        arcs = tuple((b, child) for b, child in sorted(node["arcs"].items()))
        key = (node["final"], arcs)
        if key not in register:
            register[key] = len(states)
            states.append(key)
            sizes.append(node["final"] + sum(sizes[c] for _, c in arcs))
        return register[key]

    root = {"final": False, "arcs": {}}
    path, last = [root], b""
    ordered = sorted(words)
    for word in [*ordered, b""]:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):  # the last word's tail is complete
            path[depth - 1]["arcs"][last[depth - 1]] = settle(path.pop())
        for b in word[same:]:
            path.append({"final": False, "arcs": {}})
        if word:
            path[-1]["final"] = True
        last = word
    start = settle(root)
    firsts, arcs, finals = array("I", [0]), array("I"), array("I")
    for final, out in states:
        before = int(final)
        for b, child in out:
            arcs.extend((b, child, before))
            before += sizes[child]
        firsts.append(len(arcs) // 3)
        finals.append(int(final))
    offsets, ids = array("I", [0]), array("I")
    for word in ordered:
        ids.extend(words[word])
        offsets.append(len(ids))
    head = struct.pack("<6I", len(states), start, len(arcs), len(offsets), len(ids), 0)
    return head + b"".join(a.tobytes() for a in (firsts, finals, arcs, offsets, ids))


class Lexicon:
    """The compiled file, memory-mapped: pages are shared by the tasks of a host."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        n_states, self.start, n_arcs, n_offsets, n_ids, _ = struct.unpack("<6I", view[:24])
        at, parts = 24, []
        for n in (n_states + 1, n_states, n_arcs, n_offsets, n_ids):
            parts.append(view[at:at + 4 * n].cast("I"))
            at += 4 * n
        self.firsts, self.finals, self.arcs, self.offsets, self.ids = parts
        self.met: dict[int, dict[int, tuple[int, int]]] = {}

    def _arcs(self, state: int) -> dict[int, tuple[int, int]]:
        """A state's arcs by byte, read from the file when it is first met."""
        low, high = 3 * self.firsts[state], 3 * self.firsts[state + 1]
        flat = self.arcs[low:high].tolist()
        self.met[state] = found = dict(zip(flat[::3], zip(flat[1::3], flat[2::3])))
        return found

    def find(self, word: bytes) -> list[int] | None:
        state, number, met = self.start, 0, self.met
        for b in word:
            arcs = met.get(state)
            arc = (self._arcs(state) if arcs is None else arcs).get(b)
            if arc is None:
                return None
            state, before = arc
            number += before
        return self.ids[self.offsets[number]:self.offsets[number + 1]].tolist() if self.finals[state] else None


class _Memo(dict):
    """Pieces met by a task, up to MEMO; longer or further ones are encoded each time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < MEMO and len(piece) < 64:
            self[piece] = ids
        return ids


class Codec:
    """Whole texts to ids and back, for one task."""

    def __init__(self, vocabulary: str, lexicon: str | None = None):
        self.merger = Merger(vocabulary)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.split = re.compile("(" + "|".join(map(re.escape, self.merger.special)) + ")") if self.merger.special else None
        self.memo = _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        ids = (self.lexicon and self.lexicon.find(piece.encode())) or self.merger.encode(piece)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found: list[bytes] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.merger.special:
                found.append(struct.pack("<I", self.merger.special[part]))
            elif part:
                plain = SPACE.sub(" ", unicodedata.normalize("NFC", part)).replace("\u03a3", "\u03c3").lower()
                found.extend(map(self.memo.__getitem__, PIECE.findall(plain)))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.merger.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def _codec(vocabulary: str, lexicon: str) -> Codec:
    return Codec(vocabulary, SparkFiles.get(lexicon))


def build_lexicon(docs: DataFrame, vocabulary: str, n_words: int = LEXICON_WORDS) -> str:
    """Count words over all texts, compile the most frequent and hand the file to every executor.

    ``n_words`` bounds what reaches the driver, as the most frequent are picked out on executors and written; it changes
    speed and no result. Words of one count are in or out together. Returns the file's name.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,60}"), F.lit(0))).alias("w"))
    counts = materialise(words.groupBy("w").count(), "word-counts")
    # The count behind which more than n_words lie, from a histogram: nothing is sorted but that.
    sizes = counts.groupBy("count").agg(F.count("*").alias("n"))
    least = sizes.withColumn("_from", F.sum("n").over(Window.orderBy(F.desc("count")))).filter(
        F.col("_from") > n_words).agg(F.max("count")).first()[0] or 0
    top = materialise(counts.filter(F.col("count") > least), "lexicon-words").select("w").collect()
    merger = Merger(vocabulary)
    data = compile_lexicon({r["w"].encode(): merger.encode(r["w"]) for r in top})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    with open(path, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)  # Spark ships it; executors never read the driver's folder
    return name


def encode_documents(docs: DataFrame, vocabulary: str, n_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) per input row, over whole texts.

    ``ids`` is binary (unsigned 32-bit, little-endian). Null and empty texts
    have no ids. Special tokens written in a text are those tokens. Repeated rows are all
    returned. No shuffle but the word count. ``vocabulary`` must be a path on every host.
    """
    lexicon = build_lexicon(docs, vocabulary, n_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(vocabulary, lexicon)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids, "decoded": [codec.decode(x) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str, n_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests made beside the codec."""
    lexicon = build_lexicon(docs, vocabulary, n_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(vocabulary, lexicon)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = codec.encode(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(spark: SparkSession) -> str:
    import public_tokenizers

    return spark.conf.get("timbrewatch.vocabulary", public_tokenizers.path("word_bpe_49k.json"))
