"""Line dedup over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timbrewatch.llm.common import ascii_lower, join_counted, materialise

BLANKS = " \t\n\x0b\f\r"
NO_ID = -(1 << 63)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` plus n_lines, n_dropped and ``kept`` (the text left).

    Lines are exploded, normalised and hashed (128 bits); each document counts
    once per hash. A hash in ``min_docs`` or more documents loses its lines
    everywhere but in the smallest doc_id, and texts are put together by
    position. Line hashes are shuffled; heavy ones are met by broadcast.

    Null text is one empty line. A null doc_id is below all others. Repeated
    rows are all returned and count as one document.
    """
    rows = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NO_ID)), "_lines": F.split(F.coalesce("text", F.lit("")), "\n", -1)})
    rows = rows.withColumn("_mark", F.xxhash64("text"))
    keys = rows.select("_id", "_mark", F.posexplode_outer("_lines").alias("pos", "line")).withColumn(
        "line", F.btrim("line", F.lit(BLANKS))).filter(F.length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    hashed = materialise(keys.select("_id", "_mark", "pos", F.xxhash64("line").alias("h"),
                                     F.xxhash64(F.lit(1), "line").alias("h2")), "line-hashes")
    if min_docs == 2:  # two documents differ: their least and greatest ids do
        totals = hashed.groupBy("h", "h2").agg(
            F.min("_id").alias("owner"), F.max("_id").alias("last"), F.count("*").alias("n_rows"))
        totals = totals.filter("owner <> last")
    else:
        totals = hashed.groupBy("h", "h2", "_id").agg(F.count("*").alias("n")).groupBy("h", "h2").agg(
            F.min("_id").alias("owner"), F.count("*").alias("docs"), F.sum("n").alias("n_rows")).filter(F.col("docs") >= min_docs)
    shared = materialise(totals.select("h", "h2", "owner", "n_rows"), "line-shared")
    drops = join_counted(hashed, shared, ["h", "h2"]).filter("_id <> owner").groupBy("_id", "_mark").agg(
        F.collect_set("pos").alias("_drops"))
    n = F.size("_lines")
    places = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("_drops", F.array().cast("array<int>")))
    out = rows.join(drops, ["_id", "_mark"], "left").withColumn("_places", places)
    kept = F.array_join(F.transform("_places", lambda i: F.get("_lines", i)), "\n")
    return out.select(*docs.columns, n.cast("long").alias("n_lines"), (n - F.size("_places")).cast("long").alias("n_dropped"),
                      kept.alias("kept"))
