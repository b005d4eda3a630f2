"""Conversation structure repair by a run-length dynamic program.

A conversation is a string of symbols (role initial and fault of each row), kept as
runs of equal ones. A row's effect on the cost of the four grammar states is a 4 x 4
min-plus matrix; a run of k rows applies its k-th power, built from cached binary
powers. Matrices are associative, so a long conversation is cut into pieces: costs are
carried backwards over the pieces' matrices, states forwards over their mappings,
and each piece unrolls its own edits. No step holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.llm.common import HOT_SHARE, materialise

BLANKS = " \t\n\x0b\f\r"
# Fixed values of the contract: costs and the role grammar (s?(ua)+)?.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
START, SYSTEM, USER, END = range(4)  # nothing yet, after s, after u, after a
STATES = range(4)
FOLLOWS = {START: USER, SYSTEM: USER, USER: END, END: USER}
ACCEPTED = (START, END)
INITIALS = "sua"
KEPT_AT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, END: USER}, "a": {USER: END}}
#: Symbols: 0-3 for initials s, u, a and others, 4-7 the same truncated, 8 a row that must go.
MUST_GO = 8
INF = 1 << 60
#: Runs per piece of a conversation, and rows unrolled at a time.
PIECE = 1 << 16
BLOCK = 1 << 12

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that use up a row; Insert is not among them."""
    edits = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol >= 4 else 0
        kept = KEPT_AT.get(INITIALS[symbol % 4], {}) if symbol % 4 < 3 else {}
        if state in kept:
            edits.append(("K", extra, kept[state]))
        edits.append(("R", REROLE + extra, FOLLOWS[state]))
    return edits


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in STATES) for i in STATES)


UNIT: Matrix = tuple(tuple(0 if i == j else INF for j in STATES) for i in STATES)
_ONE_INSERT: Matrix = tuple(tuple(INSERT if FOLLOWS[i] == j else UNIT[i][j] for j in STATES) for i in STATES)
#: Any number of inserts; more than three reach no other state.
INSERTS = times(_ONE_INSERT, times(_ONE_INSERT, _ONE_INSERT))
#: Cost still to come at the end of a conversation.
LAST: Vector = apply(INSERTS, tuple(0 if s in ACCEPTED else INF for s in STATES))


_POWERS: dict[tuple[int, int], Matrix] = {}


def power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2**bit rows of a symbol, inserts before each included."""
    if (symbol, bit) not in _POWERS:
        if bit:
            matrix = times(power(symbol, bit - 1), power(symbol, bit - 1))
        else:
            rows = [[INF] * 4 for _ in STATES]
            for state in STATES:
                for _, cost, to in _row_edits(symbol, state):
                    rows[state][to] = min(rows[state][to], cost)
            matrix = times(INSERTS, tuple(map(tuple, rows)))
        _POWERS[symbol, bit] = matrix
    return _POWERS[symbol, bit]


def run_powers(symbol: int, count: int) -> Iterator[Matrix]:
    return (power(symbol, bit) for bit in range(count.bit_length()) if count >> bit & 1)


def back_over(symbol: int, count: int, after: Vector) -> Vector:
    """Cost to come before a run, from that after it."""
    for matrix in run_powers(symbol, count):
        after = apply(matrix, after)
    return after


def piece_matrix(symbols: Iterable[int], counts: Iterable[int]) -> Matrix:
    total = UNIT
    for symbol, count in zip(symbols, counts):
        for matrix in run_powers(symbol, count):
            total = times(total, matrix)
    return total


def _shifted(v: Vector) -> Vector:
    least = min(v)
    return tuple(min(x - least, INF) for x in v)


#: Rows repeat few shapes of costs to come, as these are relative to the least.
_CHOICES: dict[tuple[int, Vector], tuple] = {}


def _choices(symbol: int, after: Vector) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """Before one row, from the costs after it: costs, and each state's edits and next state.

    The least initial among the edits of least cost is taken each time, which gives the
    ASCII-least audit, since costs are exact and no edit but Keep is free.
    """
    if (symbol, after) in _CHOICES:
        return _CHOICES[symbol, after]
    before = apply(power(symbol, 0), after)
    moves = []
    for state in STATES:
        edits = ""
        at, left = state, before[state]
        edit = "I"
        while edit == "I":
            options = [(e, to) for e, cost, to in _row_edits(symbol, at) if cost + after[to] == left]
            if INSERT + before[FOLLOWS[at]] == left:
                options.append(("I", FOLLOWS[at]))
            edit, at = min(options)
            edits += edit
            left -= INSERT
        moves.append((edits, at))
    _CHOICES[symbol, after] = _shifted(before), tuple(moves)
    return _CHOICES[symbol, after]


def unroll(symbols: list[int], counts: list[int], after: Vector, starts: Iterable[int]) -> list[tuple[str, int]]:
    """For each start state the audit of a piece and the state it ends in.

    ``after`` is the cost to come behind the piece. Costs before each run are found by powers, those inside a run a block at a time.
    """
    behind = [_shifted(after)]
    for symbol, count in zip(reversed(symbols), reversed(counts)):
        behind.append(_shifted(back_over(symbol, count, behind[-1])))
    behind.reverse()
    states, parts = list(starts), [[] for _ in starts]

    def take(moves):
        for k, state in enumerate(states):
            edits, states[k] = moves[state]
            parts[k].append(edits)

    for at, (symbol, count) in enumerate(zip(symbols, counts)):
        while count:
            block = min(BLOCK, count)
            count -= block
            v, steps = _shifted(back_over(symbol, count, behind[at + 1])), []
            for _ in range(block):
                v, moves = _choices(symbol, v)
                steps.append(moves)
            for moves in reversed(steps):
                take(moves)
    return [("".join(p), s) for p, s in zip(parts, states)]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(conv_id:turn) % 20, plus ``copies``: 0 for a dropped row.

    Null role, text, and null id or turn inside the hashed string, are one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def with_keys(rows: DataFrame) -> DataFrame:
    """Add ``h`` and ``h2``, 128 bits of the text."""
    return rows.withColumns({"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


#: The order of rows in a conversation; rows of one turn go by role and a hash of the text.
ORDER = ["conv_id", "turn", "role", "h", "h2"]


def symbols_of(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: ORDER, n (copies), symbol, and whether an equal row came earlier."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank, cut = shown == "", ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(
        F.col("role").startswith("a"), 2).otherwise(3)
    narrow = with_keys(rows.filter("copies > 0")).select(
        *ORDER, "copies", F.when(blank, MUST_GO).otherwise(initial + F.when(cut, 4).otherwise(0)).alias("symbol"))
    # Equal rows meet before the shuffle; a row repeated a million times is one row with a count.
    table = materialise(narrow.groupBy(*ORDER, "symbol").agg(F.sum("copies").alias("n")), "structure-symbols")
    key = ["conv_id", "role", "h", "h2"]
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = table.filter(F.col("symbol") != MUST_GO).groupBy(*key).agg(F.min(turn).alias("first"), F.count("*").alias("n_rows"))
    seen = materialise(seen.filter("n_rows > 1"), "structure-repeats")
    later = lambda found: found.select(*[table[c] for c in table.columns], F.coalesce(
        F.col("first").isNotNull() & (F.struct(table["turn"].isNotNull().alias("known"), table["turn"]) > F.col("first"))
        & (table["symbol"] != MUST_GO), F.lit(False)).alias("repeat"))
    same = lambda other: [table[c].eqNullSafe(other[c]) for c in key]
    total = seen.agg(F.sum("n_rows")).first()[0] or 0
    hot = F.broadcast(seen.filter(F.col("n_rows") * HOT_SHARE > total))  # fewer than HOT_SHARE keys
    cold = seen.filter(F.col("n_rows") * HOT_SHARE <= total)
    light = table.join(hot, same(hot), "left_anti")
    return later(table.join(hot, same(hot))).unionByName(later(light.join(cold, [light[c].eqNullSafe(cold[c]) for c in key], "left")))


RUNS = "part int, no long, symbols array<int>, counts array<long>, repeats long"


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``size`` runs from rows that come in order; memory is one piece."""
    schema = None
    conv, part, no, symbols, counts, repeats = None, 0, 0, [], [], 0
    started, out = False, []

    def batch_of(rows):
        return pa.RecordBatch.from_pydict({name: [r[k] for r in rows] for k, name in enumerate(schema.names)}, schema)

    for batch in batches:
        if schema is None:
            schema = pa.schema([batch.schema.field("conv_id"), ("part", pa.int32()), ("no", pa.int64()), ("symbols", pa.list_(pa.int32())),
                                ("counts", pa.list_(pa.int64())), ("repeats", pa.int64())])
        for c, p, n, symbol, repeat in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "n", "symbol", "repeat"))):
            full = len(symbols) >= size
            if started and (c != conv or full):
                out.append((conv, part, no, symbols, counts, repeats))
                no = no + 1 if c == conv else 0
                symbols, counts, repeats = [], [], 0
            conv, part, started = c, p, True
            gone = n if symbol == MUST_GO or repeat else n - 1
            repeats += 0 if symbol == MUST_GO else gone
            for s, k in ((symbol, n - gone), (MUST_GO, gone)):
                if not k:
                    continue
                if symbols and symbols[-1] == s:
                    counts[-1] += k
                else:
                    symbols.append(s)
                    counts.append(k)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if started:
        yield batch_of([*out, (conv, part, no, symbols, counts, repeats)])


def pieces_of(symbols: DataFrame, size: int) -> DataFrame:
    """Conversations as pieces: part and no give their order.

    Rows are dealt by ranges of the whole order, not of conversations, so a long conversation
    lies in many partitions; the result is written, so that ranges are drawn once.
    """
    sort = symbols.select(*ORDER, "n", "symbol", "repeat").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows = sort.select("conv_id", F.spark_partition_id().alias("part"), "n", "symbol", "repeat")
    kind = symbols.schema["conv_id"].dataType.simpleString()
    return materialise(rows.mapInArrow(lambda batches: _runs(batches, size), f"conv_id {kind}, {RUNS}"), "structure-pieces")


LONGS = pa.list_(pa.int64())
ADDED = {"matrix": LONGS, "after": LONGS, "ends": pa.list_(pa.int32()), "start": pa.int32(), "audit": pa.string(), "end": pa.int32(),
         **dict.fromkeys(("cost", "blank", "repeats", "truncated", "gaps", "duplicate", "illegal"), pa.int64()), "repaired_sha256": pa.string(),
         "at": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
PLACE = ["conv_id", "part", "no"]


def _batch(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    kinds = [(n, ADDED[n] if n in ADDED else like.field(n).type) for n in rows[0]]
    return pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n, _ in kinds}, pa.schema(kinds))


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """Keys and the columns ``function`` makes of each row, a batch at a time."""
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield _batch([{n: r[n] for n in PLACE} | function(r) for r in batch.to_pylist()], batch.schema)
    return df.mapInArrow(task, schema)


def _scan(df: DataFrame, step, schema: str, descending: bool) -> DataFrame:
    """Carry a value along the pieces of each conversation; ``step(row, carried)`` gives the columns made and the next value."""
    place = [F.desc(c) if descending else F.col(c) for c in PLACE[1:]]

    def task(batches):
        conv, carried, started = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r["conv_id"] != conv:
                    conv, carried, started = r["conv_id"], None, True
                made, carried = step(r, carried)
                out.append({n: r[n] for n in PLACE} | made)
            if out:
                yield _batch(out, batch.schema)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *place).mapInArrow(task, schema)


def audits_of(pieces: DataFrame) -> DataFrame:
    """Of every piece: conv_id, part, no, audit, end (its last state), cost, and how many rows have each fault.

    Conversations of one piece are unrolled at once. For the others only 16 costs and 4
    states per piece travel; a conversation's are carried along in order. The
    inserts behind the last row are not in the audit; they follow from ``end``.
    """
    key = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, part int, no long"
    many = materialise(pieces.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1"), "structure-long")
    same = pieces["conv_id"].eqNullSafe(many["conv_id"])
    short, long = pieces.join(many, same, "left_anti"), pieces.join(many, same, "left_semi")

    def add(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        met = [left[c].eqNullSafe(right[c]) for c in PLACE]
        return left.join(right, met).select(*[left[c] for c in left.columns], column)

    def whole(r):
        return {"matrix": [x for row in piece_matrix(r["symbols"], r["counts"]) for x in row]}

    def back(r, after):
        after = LAST if after is None else after
        return {"after": list(after)}, apply(tuple(tuple(r["matrix"][4 * i:4 * i + 4]) for i in STATES), after)

    def ends(r):
        return {"ends": [s for _, s in unroll(r["symbols"], r["counts"], tuple(r["after"]), STATES)]}

    def forth(r, state):
        state = START if state is None else state
        return {"start": state}, r["ends"][state]

    def written(r):
        (audit, end), = unroll(r["symbols"], r["counts"], tuple(r["after"]), [r["start"]])
        before = after = tuple(r["after"])
        for symbol, count in zip(reversed(r["symbols"]), reversed(r["counts"])):
            before = back_over(symbol, count, before)
        of = lambda *kinds: sum(n for s, n in zip(r["symbols"], r["counts"]) if s in kinds)
        return {"audit": audit, "end": end, "cost": before[r["start"]] - after[end], "repeats": r["repeats"],
                "blank": of(MUST_GO) - r["repeats"], "truncated": of(4, 5, 6, 7)}

    costs = materialise(_scan(_mapped(long, whole, f"{key}, matrix array<long>"), back, f"{key}, after array<long>", True), "structure-costs")
    priced = add(long, costs, "after")
    starts = materialise(_scan(_mapped(priced, ends, f"{key}, ends array<int>"), forth, f"{key}, start int", False), "structure-states")
    ready = add(priced, starts, "start").unionByName(short.withColumns(
        {"after": F.array(*[F.lit(x).cast("long") for x in LAST]), "start": F.lit(START)}))
    return _mapped(ready, written, f"{key}, audit string, end int, cost long, repeats long, blank long, truncated long")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations row by row, their audits first: ('new', conv_id, audit rows), ('row', turn, role) as read,
    (edit, role, text) as repaired, and ('end', conv_id). Nothing but the audit of one conversation is held."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for conv, group in groupby(rows, key=lambda r: (r["conv_id"],)):
        audits, edits, state = [], None, START
        output = lambda: "user" if FOLLOWS[state] == USER else "assistant"
        for r in group:
            if r["audit"] is not None:
                audits.append(r)
                continue
            if edits is None:
                yield "new", conv[0], audits
                edits = iter("".join(a["audit"] for a in audits))
            for _ in range(r["copies"]):
                yield "row", r["turn"], r["role"]
                for edit in edits:
                    if edit == "D":
                        yield edit, None, None
                    elif edit == "K":
                        state = KEPT_AT[r["role"][0]][state]
                        yield edit, r["role"], r["text"]
                    else:
                        yield edit, output(), "" if edit == "I" else r["text"]
                        state = FOLLOWS[state]
                    if edit != "I":
                        break
        while state not in ACCEPTED:
            yield "I", output(), ""
            state = FOLLOWS[state]
        yield "end", conv[0], None


def _together(rows: DataFrame, piece: int) -> DataFrame:
    """Audits and texts of each conversation in order, in one partition."""
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    audits = audits_of(pieces_of(symbols_of(rows), piece))
    both = audits.unionByName(with_keys(rows), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "part", "no", "turn", "role", "h", "h2")


def repair_rows(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The repaired conversations: conv_id, at (from 0), edit (K, R or I), role, text. See `repair_report`."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def task(batches):
        out, conv, at, like = [], None, 0, None

        def watched():
            nonlocal like
            for batch in batches:
                like = batch.schema
                yield batch

        for what in _walk(watched()):
            if what[0] == "new":
                conv, at = what[1], 0
            elif what[0] in ("K", "R", "I"):
                out.append({"conv_id": conv, "at": at, "edit": what[0], "role": what[1], "text": what[2]})
                at += 1
            if len(out) >= 1000:
                yield _batch(out, like)
                out = []
        if out:
            yield _batch(out, like)

    return _together(rows, piece).mapInArrow(task, f"conv_id {kind}, at long, edit string, role string, text string")


def repair_report(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per conversation: faults found, the cheapest edits and a digest of the result.

    ``rows`` has conv_id, turn, role, text (no nulls in the last two) and copies, how often
    the row stands there; a conversation of which all rows have 0 copies is empty.
    Other columns are ignored. Rows go by turn (nulls first), then role and a hash
    of the text. A null conv_id is a conversation of its own. Roles that begin with none of
    s, u, a can only be reroled or deleted.

    Symbols need no texts, so these are shuffled once, for the digest: it is fed row by
    row, as SHA-256 is serial. The audit of one conversation is a value in memory.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def task(batches):
        out, like = [], None

        def watched():
            nonlocal like
            for batch in batches:
                like = batch.schema
                yield batch

        for what in _walk(watched()):
            if what[0] == "new":
                audits, edits, digest, first = what[2], [], hashlib.sha256(), True
                low = high = last = before = None
                turns = illegal = 0
            elif what[0] == "row":
                _, turn, role = what
                if turn is not None and turn != last:
                    low, high, last, turns = turn if low is None else low, turn, turn, turns + 1
                illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
            elif what[0] == "end":
                total = lambda c: sum(a[c] for a in audits)
                out.append({
                    "conv_id": what[1], "gaps": 0 if low is None else high - low + 1 - turns, "blank": total("blank"),
                    "duplicate": total("repeats"), "truncated": total("truncated"), "illegal": illegal,
                    "cost": total("cost") + (LAST[audits[-1]["end"]] if audits else 0), "audit": "".join(edits),
                    "repaired_sha256": digest.hexdigest()})
            else:
                edit, role, text = what
                edits.append(edit)
                if edit != "D":
                    digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False
            if len(out) >= 1000:
                yield _batch(out, like)
                out = []
        if out:
            yield _batch(out, like)

    return _together(rows, piece).mapInArrow(task, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                            "cost long, audit string, repaired_sha256 string")
