"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbrewatch.llm import bpe, decontaminate, lines, quality, simhash
from timbrewatch.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects. Rejected ones are few, so those are matched."""
    judged = quality.resample(docs, table(spark, sf_dir, "labels"))
    rejected = judged.filter(~F.col("selected")).select("row")
    return docs.withColumn("row", F.xxhash64("doc_id", "text")).join(rejected, "row", "left_anti").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents of which no line is left go."""
    kept = lines.dedup_lines(docs).filter((F.col("n_dropped") < F.col("n_lines")) | (F.col("n_dropped") == 0))
    return kept.withColumns({"text": F.when(F.col("text").isNotNull(), F.col("kept")), "n_chars": F.length("kept").cast("long")}).select(*COLUMNS)


def _later_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of documents whose text in the corpus is nearly that of another one which is still here and has a smaller id.

    Line dedup leaves little of a near copy, so what is left says nothing about it. Ids that stand for several texts
    in the corpus are left out.
    """
    rows = materialise(simhash.fingerprints(table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL"), 5), "pipeline-corpus")
    near = materialise(simhash.link_rows(rows, errors=6, node=512), "pipeline-near")
    once = near.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("root").alias("root")).filter("n = 1")
    here = materialise(once.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "root"), "pipeline-here")
    groups = materialise(here.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")).filter("count > 1"), "pipeline-groups")
    return simhash.lookup(here, groups.select("root", "least"), "root", groups.select("root", "count")).filter("doc_id > least").select("doc_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id, then text hash.

    Groups are formed twice: over the texts of the corpus, since line dedup has taken from near copies what they
    share, and over the texts as they are now. Of texts with a 5-word shingle similarity of 0.8 or more nearly all differ in
    at most six bits, and most below 0.75 in more. Rows that share an id and have different texts are different documents;
    equal rows are one. Rows without an id stay. Null text counts as empty.
    """
    known = docs.filter("doc_id IS NOT NULL").select(*COLUMNS)
    copies = materialise(_later_copies(spark, docs, sf_dir), "pipeline-copies")
    rows = materialise(simhash.fingerprints(known, 5), "pipeline-rows")
    near = simhash.link_rows(materialise(rows.join(copies, "doc_id", "left_anti"), "pipeline-left"), errors=6, node=512)
    first = near.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("f")).select("f.*")
    stay = known.withColumn("mark", F.xxhash64("text")).join(first, ["doc_id", "mark"], "left_semi")
    one = stay.groupBy("doc_id", "mark").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return one.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("items") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, bpe.vocabulary_path(spark))


STAGES = [
    ("quality", classify_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]
#: Gumbel noise, templates and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
