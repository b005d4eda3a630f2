"""License scans by diagonal voting."""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from timbrewatch.llm.common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Longer notices that the voting adds.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "cc-by",
}


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, n_grams, t_pos, gram): a constant table of under 200 rows."""
    rows = []
    for base, texts in ((True, BASE), (False, NOTICES)):
        for text, label in texts.items():
            words = text.split()
            rows += [(text, label, base, len(words) - 1, i, f"{words[i]} {words[i + 1]}") for i in range(len(words) - 1)]
    return spark.createDataFrame(rows, "template string, label string, base boolean, n_grams int, t_pos int, gram string")


#: How often one gram stands in a notice at most: so many places a word of a text can have.
REPEATS = max(Counter(pairwise(t.split())).most_common(1)[0][1] for t in NOTICES)


def longest_chain(places: Column, n_grams: Column) -> Column:
    """Most grams that rise in text and notice together, within a span half as long again as the notice.

    ``places``: array<struct<pos,t>> by position. From each place on, the ends of the best chains per notice
    position are kept; a place extends the best chain of a lower position. Several notice
    positions of one text place are taken from the highest down, so that only one counts.
    """
    span = n_grams + F.ceil(n_grams / 2).cast("int")

    def chain(first: Column, i: Column) -> Column:
        near = F.filter(F.slice(places, i + 1, span * REPEATS), lambda p: p["pos"] < first["pos"] + span)
        falling = F.array_sort(F.transform(near, lambda p: F.struct(p["pos"].alias("pos"), (-p["t"]).alias("minus"))))
        none = F.transform(F.sequence(F.lit(1), n_grams), lambda _: F.lit(0))

        def extend(best: Column, p: Column) -> Column:
            t = -p["minus"]
            longer = F.coalesce(F.array_max(F.slice(best, F.lit(1), t)), F.lit(0)) + 1
            return F.transform(best, lambda b, j: F.when(j == t, F.greatest(b, longer)).otherwise(b))

        return F.aggregate(falling, none, extend, F.array_max)

    return F.array_max(F.transform(places, chain))


def scan_licenses(docs: DataFrame, min_share: float = 0.7, drift: int = 3) -> DataFrame:
    """One row per distinct (doc_id, text): word count, base places, labels and score.

    All rolling word 2-gram hashes are joined to template positions. Votes are
    counted by diagonal (document place minus template place). A base phrase
    holds where one diagonal has all its grams. For notices, diagonals at most
    ``drift`` apart are merged, which admits dropped and inserted words, and the
    merged places are verified: within a span half as long again as the notice, the longest
    chain of grams that rise in the text and in the notice together must have
    ``min_share`` of them. The score is that share, for a base phrase one.

    A null or empty text has no words. Rows with an equal doc_id and text count
    once, other rows apart; extra columns are ignored; null doc_ids are ids like any other. Texts of any
    length are read whole. Nothing is broadcast but the constant templates.
    """
    spark = docs.sparkSession
    key = ["doc_id", "mark"]
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    words = text.select(*key, ascii_lower(F.col("text")).alias("text")).select(
        *key, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    rolled = words.select(*key, F.transform(
        "words", lambda w, i: F.xxhash64(w, F.get("words", i + 1))).alias("grams")).select(
        *key, F.posexplode_outer("grams").alias("pos", "h"))
    known = F.broadcast(templates(spark).withColumn("h", F.xxhash64(
        F.substring_index("gram", " ", 1), F.substring_index("gram", " ", -1))))
    votes = rolled.join(known, "h").select(
        *key, "template", "label", "base", "n_grams", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    lines = votes.groupBy(*key, "template", "label", "base", "n_grams", "diagonal").agg(
        F.collect_set("t_pos").alias("found"))
    base = lines.filter(F.col("base") & (F.size("found") == F.col("n_grams"))).select(
        *key, "label", "base", F.col("diagonal").alias("first"),
        (F.col("diagonal")).alias("last"), F.lit(1.0).alias("score"))
    by_place = Window.partitionBy(*key, "template").orderBy("diagonal")
    merged = (
        lines.filter(~F.col("base"))
        .withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -10**9).over(by_place) > drift).cast("int"))
        .withColumn("run", F.sum("new").over(by_place))
        .groupBy(*key, "template", "label", "n_grams", "run")
        .agg(F.collect_list(F.struct("diagonal", "found")).alias("lines"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))
        .filter(F.size(F.array_distinct(F.flatten("lines.found"))) >= min_share * F.col("n_grams"))
        .withColumn("places", F.array_sort(F.flatten(F.transform("lines", lambda d: F.transform(
            d["found"], lambda t: F.struct((d["diagonal"] + t).alias("pos"), t.alias("t")))))))
        .withColumn("score", longest_chain(F.col("places"), F.col("n_grams")) / F.col("n_grams"))
        .filter(F.col("score") >= min_share)
        .select(*key, "label", F.lit(False).alias("base"), "first", "last", "score")
    )
    empty = [F.lit(None).cast(t).alias(n) for n, t in (
        ("label", "string"), ("base", "boolean"), ("first", "int"), ("last", "int"), ("score", "double"))]
    per_doc = words.select(*key, F.size("words").cast("long").alias("n_words"), *empty)
    found = base.unionByName(merged).withColumn("n_words", F.lit(0).cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return per_doc.unionByName(found).groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("base")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last"))).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    ).drop("mark")
