"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.llm.common import join_counted, materialise, spans, spell

# Fixed patterns of the base scan, in the order of kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Wider candidates: long tokens of mixed signs. They count only with one owner.
WIDE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"


def candidates(text: Column) -> list[tuple[str, Column]]:
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    wide = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    # Runs under 32 or 16 characters fail in any case, so the matcher skips them itself.
    return [
        ("assign", F.filter(spans(text, ASSIGN, "assign"), lambda s: F.length(value(s)) >= 8)),
        ("access", spans(text, "AKIA[A-Z0-9]{12,}+", "access")),
        ("hex", spans(text, "[0-9a-f]{32,}+", "hex")),
        ("wide", F.filter(spans(text, WIDE, "wide"), wide)),
    ]


def scan_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = 4,
                 max_repos: int = 100) -> DataFrame:
    """One row per input row: counts and spans of base kinds, plus owner-specific wide spans.

    The value of every candidate is hashed and counted over the corpus by
    distinct owners and distinct repositories. Values seen with more than ``max_owners`` owners, each
    in a text of its own, or in more than ``max_repos`` repositories are copied examples
    (``n_example``); the rest look live (``n_live``). Exact copies of a text are one repository and one owner, the smallest. Wide candidates are kept only where live; base
    spans always. ``repo`` defaults to the document.

    Null text is empty. Null owners are one owner. Repeated rows are all
    returned and count as one repository, as do equal texts. Only narrow rows are shuffled.
    """
    cols = {name: docs[name] for name in dict.fromkeys(["doc_id", owner, repo])}
    base = docs.select(*cols.values(), F.coalesce("text", F.lit("")).alias("text"))
    found = base.select(*cols, F.xxhash64("text").alias("copy"), F.xxhash64(F.lit(1), "text").alias("copy2"), *(c.alias(f"_{kind}") for kind, c in candidates(F.col("text"))))
    order = {"assign": 0, "access": 1, "hex": 2, "wide": 3}
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 1)).otherwise(s["value"])
    every = F.sort_array(F.transform(F.concat(*(f"_{k}" for k in order)), lambda s: F.struct(
        s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        F.xxhash64(value(s)).alias("h"), F.xxhash64(F.lit(1), value(s)).alias("h2"))))
    rows = materialise(found.select(
        F.monotonically_increasing_id().alias("row"), "copy", "copy2", "doc_id", F.col(owner).alias("owner"), F.col(repo).alias("repo"),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in order), every.alias("every")), "secret-spans")

    seen = rows.select(
        "row", "copy", "copy2", "owner", "repo", F.explode("every").alias("s")).select("row", "copy", "copy2", "owner", "repo", "s", "s.h", "s.h2")
    key = ["h", "h2"]
    # Equal texts stand for their smallest owner and repository; the rows still count for the join.
    texts = seen.groupBy(*key, "copy", "copy2").agg(F.min(F.struct("owner", "repo")).alias("first"), F.count("*").alias("n"))
    totals = (
        texts.groupBy(*key, "first.owner", "first.repo").agg(F.sum("n").alias("n"))
        .groupBy(*key, "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
        .groupBy(*key).agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n_rows"))
    )
    judged = join_counted(seen, materialise(totals, "secret-owners"), key)
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    marks = judged.groupBy("row").agg(
        F.count_if(live & (F.col("s.kind") != "wide")).alias("n_live"),
        F.count_if(~live & (F.col("s.kind") != "wide")).alias("n_example"),
        F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"),
        F.collect_list(F.when(live & (F.col("s.kind") == "wide"), F.col("s"))).alias("more"))
    kept = F.filter("every", lambda s: s["kind"] != "wide")
    both = F.sort_array(F.concat(kept, F.coalesce("more", F.expr("filter(every, s -> false)"))))
    return rows.join(marks, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spell(kept), 256).alias("base_sha256"),
        spell(both).alias("spans"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example", "most_owners", "most_repos")))
