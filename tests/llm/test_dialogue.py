"""Chat formatting and structure repair against plain restatements."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from timbrewatch.llm import chat, queries, structure

CHATS = "conv_id long, turn long, role string, text string, seq string, kind string, audit string"


def chats(spark, rows):
    """With extra columns that share names with those used inside."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CHATS)


def brute_repair(rows):
    """The contract's faults, cheapest edits and digest, for one conversation at a time."""
    by = {}
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns, faults, seen, n = {t for t, _, _ in found if t is not None}, [], set(), [0, 0, 0]
        for _, role, text in found:
            shown = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else 3
            seen.add((role, text))
            faults.append(fault)
            if fault < 3:
                n[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        best = {}

        def rest(i, state, inserts=0):
            if (i, state, inserts) in best:
                return best[i, state, inserts]
            options, after = [], {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            if i == len(found) and state in ("", "a"):
                options.append((0, "", ""))
            if inserts < 3:
                options.append((5, "I", (i, after, inserts + 1)))
            if i < len(found):
                options.append((2, "D", (i + 1, state)))
                if faults[i] > 1:
                    extra = 5 if faults[i] == 2 else 0
                    if found[i][1][:1] == after or state == "" and found[i][1][:1] == "s":
                        options.append((extra, "K", (i + 1, found[i][1][:1])))
                    options.append((extra + 1, "R", (i + 1, after)))
            best[i, state, inserts] = min((c + (t := rest(*to) if to else (0, ""))[0], e + t[1]) for c, e, to in options) if options else (10**9, "")
            return best[i, state, inserts]

        cost, audit = rest(0, "")
        repaired, left, before = [], list(found), None
        for e in audit:
            _, role, text = left.pop(0) if e != "I" else (None, None, "")
            if e != "D":
                role = role if e == "K" else "assistant" if before and before[0] == "u" else "user"
                repaired.append(f"{role}:{text}")
                before = role
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit,
                     hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(df):
    return {r["conv_id"]: tuple(r[c] for c in REPORT) for r in df.collect()}


def dialogues(n, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            rows.append((conv, turn + 2 * (turn > 3), role, r.choice(["Yes.", "Well", "so it is! ", " \t", "é?\n", f"no {turn}.", ""])))
    return rows


@pytest.mark.parametrize("piece", [structure.PIECE, 2])
def test_repair_equals_brute_force(spark, piece):
    rows = dialogues(120, 3)
    rows += [(500, None, None, None), (None, 4, "user", "a."), (None, 5, "assistant", None), (501, 1, "user", "x." * 20_000), (501, 2, "assistant", "y.")]
    rows += [(502, 7, "user", "same.")] * 3 + [(503, None, "user", "same.")] * 2 + [(503, 1, "user", "same."), (503, 2, "assistant", "b.")]
    assert reported(structure.repair_report(structure.damage(chats(spark, rows)), piece)) == brute_repair(rows)


def test_conversation_of_dropped_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    got = reported(structure.repair_report(structure.damage(chats(spark, [(9, turn, "user", "a.")]))))
    assert got == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert reported(structure.repair_report(structure.damage(chats(spark, [])))) == {}


def test_long_conversation_in_pieces(spark):
    """Runs far longer than a block, over many pieces, and the repaired rows themselves."""
    r = random.Random(8)
    rows, turn = [], 0
    while turn < 3000:
        role, text = r.choice([("user", "q"), ("assistant", "a."), ("user", "q."), ("system", "s."), ("tool", "t.")])
        for _ in range(r.choice([1, 1, 2, 40])):
            rows.append((1, turn, role, f"{turn}{text}"))
            turn += 1
    undamaged = chats(spark, rows).withColumn("copies", F.lit(1))
    whole, parts = (structure.repair_report(undamaged, p).collect() for p in (structure.PIECE, 5))
    assert whole == parts
    repaired = structure.repair_rows(undamaged, 5).orderBy("at").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in repaired))
    text = "\n".join(f"{x.role}:{x.text}" for x in repaired)
    assert hashlib.sha256(text.encode()).hexdigest() == whole[0].repaired_sha256
    assert [x.edit for x in repaired] == [e for e in whole[0].audit if e != "D"]


def test_run_powers_and_blocks(monkeypatch):
    monkeypatch.setattr(structure, "BLOCK", 3)
    r = random.Random(1)
    for _ in range(200):
        symbols = [r.randrange(9) for _ in range(r.randrange(1, 5))]
        counts = [r.randrange(1, 12) for _ in symbols]
        flat = [s for s, n in zip(symbols, counts) for _ in range(n)]
        assert structure.unroll(symbols, counts, structure.LAST, [0]) == structure.unroll(flat, [1] * len(flat), structure.LAST, [0])
        assert structure.piece_matrix(symbols, counts) == structure.piece_matrix(flat, [1] * len(flat))


def brute_fold(events):
    """One event at a time."""
    by = {}
    for e in sorted({(c, s, m, k, t or "", r) for c, s, k, m, r, t in events}, key=lambda e: e[:5]):
        by.setdefault(e[0], []).append(e)
    out = {}
    for conv, log in by.items():
        texts, opened, gone, roles, last = {}, {}, set(), {}, None
        for _, seq, m, kind, text, role in log:
            if seq == last:
                continue
            last = seq
            opened.setdefault(m, seq)
            roles.setdefault(m, role)
            if kind in ("edit", "regenerate"):
                gone |= {x for x in opened if opened[x] > opened[m]}
            texts[m] = text if kind != "delta" else texts.get(m, "") + text
        out[conv] = [(roles[m], texts[m]) for m in sorted(opened, key=opened.get) if m not in gone]
    return out


def test_event_log_is_folded(spark):
    r = random.Random(4)
    events = []
    for conv in range(60):
        opened = []
        for seq in range(r.randrange(1, 40)):
            if not opened or r.random() < 0.4:
                opened.append(len(opened))
                events.append((conv, seq, "open", opened[-1], r.choice(["user", "assistant", "system"]), r.choice(["", "hi", None])))
            else:
                kind = r.choice(["delta", "delta", "delta", "edit", "regenerate"])
                events.append((conv, seq, kind, r.choice(opened[-3:]), None, f"<{seq}>\\</s>"))
    events += events[::7]  # redelivered
    df = spark.createDataFrame([(*e, 1) for e in events], "conv_id long, seq long, kind string, message long, role string, text string, opened long")
    want = brute_fold(events)
    got = {}
    for x in chat.fold_events(df).orderBy("conv_id", "opened").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert got == want
    shown = chat.format_chats(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"),
                                         "formatted", "loss").collect()
    for x in shown:
        assert [(t.role, t.text) for t in x.t] == want[x.conv_id]
        assert list(x.l) == [text for role, text in want[x.conv_id] if role == "assistant"]
        assert [x.formatted[s.start:s.end] for s in x.loss] == [re.sub(r"<(\\*/s>)", r"<\\\1", text) for text in x.l]


def test_late_and_nameless_events(spark):
    rows = [(1, 5, "delta", 1, "assistant", "b"), (1, None, "delta", 1, None, "a"), (1, 9, "odd", 1, None, "c"), (None, 1, "open", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {(x.conv_id, x.role, x.text) for x in chat.fold_events(df).collect()}
    assert got == {(1, "assistant", "abc"), (None, None, "")}
    assert chat.format_chats(df.limit(0)).collect() == []


def test_control_strings_come_back(spark):
    r = random.Random(6)
    bits = ["<", "s>", "/s>", "<s>", "</s>", "[", "INST]", "[INST] ", " [/INST]", "\\", "\\\\", "<<SYS>>\n", "\n<</SYS>>", "<<ROLE>>", "<</ROLE>>", "$1", "é", "😀", "\n", " "]
    rows = [(conv, turn, r.choice(["user", "assistant", "system", "tool", "", None, "<</ROLE>>", "</s>"]), "".join(r.choices(bits, k=r.randrange(8))))
            for conv in range(150) for turn in range(4)]
    rows += [(900, None, "user", None), (900, 1, "assistant", "x\n" * 20_000), (901, 1, "assistant", "same")] + [(901, 1, "assistant", "same")]
    out = chat.format_chats(chat.events_of(chats(spark, rows))).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {x.conv_id: [(t.role, t.text) for t in x.t] for x in out} == want
    assert {x.conv_id: list(x.l) for x in out} == {c: [t for role, t in turns if role == "assistant"] for c, turns in want.items()}
    assert all(x.formatted.count("</s>") == len(want[x.conv_id]) for x in out)


def test_chat_query_equals_sql(spark, duck):
    df = queries.QUERIES["op11_chat_format"](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({queries.ORACLES['op11_chat_format']})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want)


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(queries.QUERIES["op13_structure_repair"](spark, "/root/testdata/sf0.001")) == brute_repair(rows)
