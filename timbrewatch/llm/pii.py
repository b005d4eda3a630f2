"""Personal data: candidates scored by boosted trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.llm.common import materialise, spans, spell

# Fixed patterns of the base scan, in the order of kinds. Repeats that end a
# pattern are possessive, which changes no match and needs no stack; a local
# part is tried only where a run starts or the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"  # shorter runs fail in any case
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# High-recall generators: each may overlap a base kind or another.
WIDE = {
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "spelt_email": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}\x20?[(\[](?:at|@)[)\]]\x20?[a-z0-9.-]{1,253}",
    "bank_number": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
}
#: How often a random string of the kind's form passes `plausible`: two check digits, or shares of the numbers that are given out.
CHANCE = {"local_phone": 0.72, "id_number": 0.889, "spelt_email": 0.5, "bank_number": 1 / 97}
KINDS = ["email", "ip", "card", "phone", *WIDE]
FEATURES = ["long", "signs", "led", "lettered", "zeroes", "varied", "near_other"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string passes; only for short strings."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    n = lambda s: F.length(_digits(s["value"]))
    return {
        "email": spans(text, EMAIL, "email"),
        "ip": F.filter(spans(text, IP, "ip"), lambda s: s["value"].rlike(rf"^({PART}\.){{3}}{PART}$")),
        "card": F.filter(spans(text, CARD, "card"), lambda s: n(s).between(13, 19) & luhn(_digits(s["value"]))),
        "phone": F.filter(spans(text, PHONE, "phone"), lambda s: n(s).between(9, 15)),
    }


def plausible(s: Column) -> Column:
    """Whether a wide candidate passes what its kind's issuer demands: ranges, check digits or the form of a domain.

    Features and lead words play no part, so this is evidence apart from what the trees see, and
    about this very span.
    """
    value, digits = s["value"], _digits(s["value"])
    whole = F.regexp_replace(value, r"\x20", "")
    turned = F.split(F.concat(F.substring(whole, F.lit(5), F.lit(64)), F.substring(whole, 1, 4)), "")
    number = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c >= "A", 100).otherwise(10) + number(c)) % 97))
    return (F.when(s["kind"] == "local_phone", digits.rlike("^[2-9][0-9]{2}[1-9][0-9]{6}$"))
            .when(s["kind"] == "id_number", digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))
            .when(s["kind"] == "spelt_email", value.rlike(r"(?i)[)\]]\x20?[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}[.-]*$"))
            .when(s["kind"] == "bank_number", rest == 1).otherwise(F.lit(True)))


def pattern_of(s: Column, text: Column) -> Column:
    """Binary format and context features of a candidate as one small number."""
    value = s["value"]
    before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    flags = {
        "long": F.length(value) >= 14,
        "signs": value.rlike(r"[()@.+-]"),
        "led": before.rlike(r"(?i)(phone|tel|call|mail|contact|card|account|iban|ssn|id|ip|address)[:#. ]*$"),
        "lettered": value.rlike("[A-Za-z]"),
        "zeroes": value.rlike("0000|1234|555-?01|example"),
        "varied": F.size(F.array_distinct(F.split(_digits(value), ""))) >= 5,
        "near_other": before.rlike(r"[@0-9]"),
    }
    number = F.lit(0)
    for bit, name in enumerate(FEATURES):
        number = number + F.when(flags[name], 1 << bit).otherwise(0)
    return number


def boost(counts: list[tuple[int, int, float, float]], rounds: int = 24, rate: float = 0.3) -> dict[tuple[int, int], float]:
    """Boosted two-split trees on logistic loss over (kind, pattern, positives, negatives).

    There are at most ``len(KINDS) * 2**len(FEATURES)`` patterns, so the table is
    a bounded, complete statistic of all candidates. Returns each pattern's probability.
    """
    cells = [(k, p, pos, neg, [float(k == j) for j in range(len(KINDS))] + [float(p >> b & 1) for b in range(len(FEATURES))])
             for k, p, pos, neg in counts]
    margin = [0.0] * len(cells)
    n_feats = len(KINDS) + len(FEATURES)
    for _ in range(rounds):
        grads = []
        for (_, _, pos, neg, _), m in zip(cells, margin):
            q = 1 / (1 + math.exp(-m))
            grads.append((pos - (pos + neg) * q, (pos + neg) * q * (1 - q)))
        value = lambda ix: (sum(grads[i][0] for i in ix), sum(grads[i][1] for i in ix) + 1.0)
        gain = lambda ix: value(ix)[0] ** 2 / value(ix)[1]

        def split(ix: list[int]) -> list[list[int]]:
            options = [([i for i in ix if cells[i][4][f] == 0], [i for i in ix if cells[i][4][f] == 1]) for f in range(n_feats)]
            return list(max(options, key=lambda o: gain(o[0]) + gain(o[1]), default=(ix, [])))

        for leaf in (x for half in split(list(range(len(cells)))) for x in split(half)):
            g, h = value(leaf)
            for i in leaf:
                margin[i] += rate * g / h
    return {(k, p): 1 / (1 + math.exp(-m)) for (k, p, *_), m in zip(cells, margin)}


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per input row: base spans with counts, and wide spans that the trees select.

    The trees tell from format and context how often such candidates hold; as there are no
    true labels, base spans that hold are positive, and wide candidates as they are ``plausible``. Counts cover all
    candidates, and probabilities are shrunk to the observed rate of their pattern (calibration). The decision is about each span: its
    own check digits or ranges turn that rate into the span's probability, by how often a
    random string would pass them (`CHANCE`); one that fails is never selected, and one that passes is if it meets ``threshold``.

    Null text is empty. Repeated rows are all returned, extra columns ignored.
    Nothing is shuffled but pattern counts.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base_spans(F.col("text"))
    held = text.select("doc_id", "text", *(c.alias(f"_{k}") for k, c in base.items()),
                       F.concat(*(spans(F.col("text"), p, k) for k, p in WIDE.items())).alias("_wide"))
    code = lambda k: F.array_position(F.array(*(F.lit(x) for x in KINDS)), k) - 1
    slim = lambda s: F.struct(code(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
                              s["kind"].alias("kind"), pattern_of(s, F.col("text")).alias("pattern"),
                              plausible(s).cast("int").alias("sound"))
    rows = materialise(held.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in base),
        F.transform(F.concat(*(f"_{k}" for k in base)), slim).alias("base"),
        F.transform("_wide", slim).alias("wide")), "pii-spans")

    seen = rows.select(F.explode(F.concat("base", "wide")).alias("s")).groupBy("s.rank", "s.pattern").agg(
        F.sum("s.sound").alias("sound"), F.count("*").alias("n")).collect()
    counts = [(r["rank"], r["pattern"], float(r["sound"]), float(r["n"] - r["sound"])) for r in seen]
    odds = boost(counts)
    chosen = []
    for k, p, pos, neg in counts:
        calibrated = (odds[k, p] * 20 + pos) / (20 + pos + neg)
        if k >= len(base) and calibrated / (calibrated + (1 - calibrated) * CHANCE[KINDS[k]]) >= threshold:
            chosen.append(k * 1000 + p)
    pick = F.array(*(F.lit(c) for c in chosen)).cast("array<bigint>")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    extra = F.filter("wide", lambda s: (s["sound"] == 1) & F.array_contains(pick, (s["rank"] * 1000 + s["pattern"]).cast("long")) & free(s))
    return rows.select("doc_id", *(f"n_{k}" for k in base), F.sha2(spell(F.sort_array("base")), 256).alias("base_sha256"),
                       spell(F.sort_array(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_more"))
