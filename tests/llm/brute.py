"""Plain restatements of the contracts, one document at a time."""

import base64
import hashlib
import re
import unicodedata

import xxhash

from timbrewatch.llm import licenses

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs):
    out = {}
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for j in range(len(words) - len(p) + 1):
                if words[j:j + len(p)] == p:
                    at.append(j)
                    labels.add(label)
        out[i] = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    return out


def op2_edits(docs):
    docs = sorted(((i, t or "") for i, t in docs), reverse=True)
    out = {}
    for j, (i, t) in enumerate(docs):
        n, after = len(t), docs[(j + 1) % len(docs)][1]
        out[i] = (n, sha(t[:n - n // 2] + after[:n // 2]))
    return out


def winnow(tokens, k, w, h):
    grams = [h(tokens[i:i + k]) for i in range(max(len(tokens) - k + 1, min(1, len(tokens))))]
    kept = []
    for at in range(max(len(grams) - w, 0) + 1 if grams else 0):
        part = grams[at:at + w]
        j = max(x for x in range(len(part)) if part[x] == min(part))
        if (part[j], at + j) not in kept:
            kept.append((part[j], at + j))
    return kept


def op4(docs):
    kinds = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    least = {"access": 16, "hex": 32}
    out = {}
    for i, t in docs:
        found, n = [], dict.fromkeys(kinds, 0)
        for rank, (kind, p) in enumerate(kinds.items()):
            for m in re.finditer(p, t or ""):
                if len(m[1]) >= 8 if kind == "assign" else len(m[0]) >= least[kind]:
                    found.append((m.start(), rank, m.end(), kind))
                    n[kind] += 1
        out[i] = (*n.values(), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))))
    return out


def op5(docs):
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate(LOW)
    owners = {}
    for i, t in docs:
        for s in (t or "").split("\n"):
            owners.setdefault(key(s), set()).add(i)
    out = {}
    for i, t in docs:
        rows = (t or "").split("\n")
        kept = [s for s in rows if len(key(s)) < 10 or min(owners[key(s)]) == i]
        out[i] = (len(rows), len(rows) - len(kept), sha("\n".join(kept)))
    return out


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def op7(docs):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    out = {}
    for i, t in docs:
        found, counts = [], []
        for kind, (p, ok) in kinds.items():
            hits = [m for m in re.finditer(p, t or "") if ok(m[0])]
            counts.append(len(hits))
            found += [f"{kind}:{m.start()}:{m.end()}" for m in hits]
        out[i] = (*counts, sha(",".join(found)))
    return out


def op8(docs, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out = {}
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(),
                  sha(tok.decode(ids, skip_special_tokens=False)))
    return out


def op9(docs, size=4, errors=4):
    fps = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        grams = [" ".join(w[j:j + size]) for j in range(max(1, len(w) - size + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= errors:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def op10(pages):
    best = {}
    for i, h in pages:
        best[h or ""] = max(best.get(h or "", i), i)
    return {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, h in pages}


def op1_notices(text, min_share=0.7, drift=3):
    """(labels, score) of the notices: runs of neighbouring diagonals, then the longest rising chain in each span."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    labels, top = set(), 0.0
    for notice, label in licenses.NOTICES.items():
        want = notice.split()
        n = len(want) - 1
        places = [(i, t) for i in range(len(words) - 1) for t in range(n) if words[i:i + 2] == want[t:t + 2]]
        diagonals, runs = sorted({i - t for i, t in places}), []
        for d in diagonals:
            runs.append([d]) if not runs or d - runs[-1][-1] > drift else runs[-1].append(d)
        for run in runs:
            mine, best = sorted(p for p in places if p[0] - p[1] in run), 0
            for first, _ in mine:
                near = [p for p in mine if first <= p[0] < first + n + (n + 1) // 2]
                longest = {}
                for i, t in near:
                    longest[i, t] = 1 + max((c for (j, u), c in longest.items() if j < i and u < t), default=0)
                best = max(best, *longest.values())
            if best / n >= min_share:
                labels.add(label)
                top = max(top, best / n)
    return labels, top


def op6(docs, items, window=8, min_cover=0.5, min_run=6):
    """{doc_id: items found}, a document and an item at a time; ids are unique."""
    from collections import Counter, defaultdict

    from timbrewatch.llm.decontaminate import TOKEN, UNITS

    def typed(text):
        out = []
        for t in TOKEN.findall(text or ""):
            number = t[0].isdecimal()
            out.append((t.lower(), "n" if number else "u" if t.lower() in UNITS and out and out[-1][1] == "n" else "p" if t[0].isupper() else ""))
        return out

    forms = [lambda t: "#" + t[1] if t[1] in ("n", "u") else t[0], lambda t: "#" + t[1] if t[1] else t[0], lambda t: t[0]]
    out = {}
    for doc, text in docs:
        d, found = typed(text), []
        for item, other in items:
            i = typed(other)
            n = min(window, len(i))
            if not n:
                continue
            hits = defaultdict(set)
            for at in range(len(i) - n + 1):
                a = i[at:at + n]
                for stream, form in enumerate(forms):
                    wordy = sum(t[1] not in ("n", "u") and (stream != 1 or t[1] != "p") for t in a)
                    if stream == 2 and 2 * sum(t[1] not in ("n", "u") for t in a) >= n or stream < 2 and 2 * wordy < n:
                        continue
                    for place in range(len(d) - n + 1):
                        b = d[place:place + n]
                        if [form(t) for t in a] != [form(t) for t in b] or stream < 2 and any(x[1] != y[1] and x[0] != y[0] for x, y in zip(a, b)):
                            continue
                        slots = frozenset((x[0], y[0]) for x, y in zip(a, b) if x[1] or y[1])
                        hits[place - at].add((at, [t[0] for t in a] == [t[0] for t in b], slots))
            zones = defaultdict(set)
            total = len(i) - n + 1
            for offset, windows in hits.items():
                votes, sure = Counter(), {p for _, exact, slots in windows if exact for p in slots}
                for _, _, slots in windows:
                    votes.update(slots)
                rank = lambda p: (p in sure, votes[p])
                best_d, best_i = {}, {}
                for p in votes:
                    if p[0] not in best_d or (*rank(p), p[1]) > (*rank((p[0], best_d[p[0]])), best_d[p[0]]):
                        best_d[p[0]] = p[1]
                    if p[1] not in best_i or (*rank(p), p[0]) > (*rank((best_i[p[1]], p[1])), best_i[p[1]]):
                        best_i[p[1]] = p[0]
                agreed = {p for p in votes if p in sure or best_d[p[0]] == p[1] and best_i[p[1]] == p[0]}
                good = {at for at, exact, slots in windows if exact or slots <= agreed}
                if 2 * len(good) > len({at for at, _, _ in windows}):
                    width = max(total, window)
                    for zone in (offset // width, offset // width + 1):
                        zones[zone] |= good
            if any(len(z) >= min_run or len(z) >= min_cover * total for z in zones.values()):
                found.append(item)
        out[doc] = found
    return out


def _spark_hash(*values):
    """Spark's xxhash64 of long, (int,) and string values; null leaves the seed as it is."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def op3(docs, labels, temperature=0.25, seed=7, smooth=5.0, rare=16.0):
    """{(doc_id, text): (log_weight, key, copies)} and the cut, by dictionaries."""
    import math
    from collections import Counter

    import numpy as np
    import regex

    def grams(text):
        words = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", (text or "").lower())
        return [_spark_hash(*w) % (1 << 17) for w in [*((w,) for w in words), *zip(words, words[1:])]]

    rated = {}
    for i, q, t in labels:
        if i is not None:
            a, b = rated.get(i, (True, True))
            rated[i] = (a and q == 1, b and not t)
    fitted = [(_signed(_spark_hash(t, (5,))) % 5, *rated[i], grams(t)) for i, t in docs if i in rated]
    uses, fine, rows, clean = Counter(), Counter(), Counter(), Counter()
    n_fit = n_clean = 0
    for fold, is_fine, is_clean, g in fitted:
        if fold < 3:
            n_fit, n_clean = n_fit + 1, n_clean + is_clean
            uses.update(g)
            rows.update(set(g))
            fine.update(g if is_fine else [])
            clean.update(set(g) if is_clean else [])
    share = sum(fine.values()) / max(1, sum(uses.values())) or 1.0
    clean_share = n_clean / max(1, n_fit) or 1.0

    def quality(c):
        return math.log((fine[c] + smooth * share) / (share * (uses[c] + smooth)))

    def toxic(c):
        n = rows[c]
        z2 = (clean[c] - n * clean_share) ** 2 / (n * clean_share * (1 - clean_share) + 1e-9)
        return math.log((clean[c] + 0.5 * clean_share) / (clean_share * (n + 0.5))) * (z2 / (z2 + rare)) ** 2

    def means(g):
        return [sum(map(f, g)) / len(g) for f in (quality, toxic)] if g else None

    side = np.array([means(g) for fold, a, b, g in fitted if fold == 3 and a and b and g])
    center = np.median(side, axis=0)
    spread = np.maximum(center - np.quantile(side, 0.02, axis=0), 1e-3)

    def score(g):
        m = means(g)
        return round(float(min((np.array(m) - center) / spread)) * len(g) / (len(g) + 50), 6) if m else 0.0

    tune = [(score(g), a and b) for fold, a, b, g in fitted if fold == 3]
    best, cut = 0.0, -math.inf
    for at in sorted({s for s, _ in tune}):
        gain = [sum(s < at for s, good in tune if good == on) / max(1, sum(good == on for _, good in tune)) for on in (False, True)]
        if gain[0] - gain[1] > best:
            best, cut = gain[0] - gain[1], at
    out = {}
    for (i, t), copies in Counter(docs).items():
        u = ((_spark_hash(_signed(_spark_hash(i, t)), (seed,)) >> 11) + 0.5) / float(1 << 53)
        weight = score(grams(t))
        out[i, t] = (weight, weight / temperature - math.log(-math.log(u)), copies)
    return out, cut
