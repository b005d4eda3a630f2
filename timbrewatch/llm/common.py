"""Shared column expressions and joins of the text operators.

Arrays made by expressions are exploded with the ``_outer`` forms: the plain ones
add a size filter, which is pushed below the array and computes it anew per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbrewatch.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key with more than 1/HOT_SHARE of the counted rows is hot, so fewer than HOT_SHARE keys are.
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``col`` should be a plain column, since it is used three times."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower()))


def join_counted(rows: DataFrame, totals: DataFrame, key: list[str], count: str = "n_rows") -> DataFrame:
    """Inner join of ``rows`` to ``totals``, which has one row per key and the key's row count.

    Keys above 1/HOT_SHARE of the counted rows number below HOT_SHARE, so they are
    broadcast; the rest are shuffled, and none of those is heavy. Both frames are
    read more than once and should be written tables.
    """
    total = totals.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(totals.filter(F.col(count) * HOT_SHARE > total))
    cold = totals.filter(F.col(count) * HOT_SHARE <= total)
    light = rows.join(hot.select(*key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(light)


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<kind,start,end,value>>, in code points.

    Matches and the gaps between them come from the same matcher; starts are
    the running lengths of both.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<kind:string,start:int,end:int,value:string>>))")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step)["spans"]).otherwise(zero["spans"])


def spell(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
