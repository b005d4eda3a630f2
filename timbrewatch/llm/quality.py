"""Quality classifier by importance resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timbrewatch.llm.common import materialise

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
BUCKETS = 1 << 17
#: At most this many labelled documents are used to fit the two models.
FIT_ROWS = 20_000
#: Parts of the labelled rows: three to count, one for scale and cut, one left out.
FOLDS = 5
#: So many n-grams of median good text are added to each text: a few words are little evidence.
NEUTRAL = 50
_COUNTS = ["uses", "fine_uses", "clean_uses", "rows", "fine_rows", "clean_rows"]


def tokens(text: Column) -> Column:
    """Words and runs of signs, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _grams(text: Column) -> Column:
    """All hashed 1- and 2-grams of a text, with repeats."""
    cell = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    return F.transform(F.array(tokens(text)), lambda words: F.concat(
        F.transform(words, lambda w: cell(w)),
        F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
                    lambda w, i: cell(w, F.get(words, i + 1)))))[0]


@dataclass
class Models:
    """Log ratio of each bucket in the two models, and what puts their means on one scale."""

    weights: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    cut: float = -math.inf

    @property
    def score(self) -> Column:
        q, t = ((F.col(c) - float(self.center[k])) / float(self.spread[k]) for k, c in enumerate("qt"))
        return F.coalesce(F.round(F.least(q, t) * F.col("n") / (F.col("n") + NEUTRAL), 6), F.lit(0.0))


def _means(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """``df`` with the mean log ratios ``q`` and ``t`` per n-gram and the number ``n`` of these in place of ``gram``; null means without n-grams."""
    rest = [f for f in df.schema if f.name != "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(batch.schema.get_field_index("gram"))
            cells, ends = gram.values.to_numpy(), gram.offsets.to_numpy()
            means = [[w[cells[i:j]].mean() if i < j else None for i, j in zip(ends, ends[1:])] for w in weights]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), *(pa.array(m, pa.float64()) for m in means), pa.array(np.diff(ends), pa.int32())],
                names=[*(f.name for f in rest), "q", "t", "n"])

    return df.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rest] + ["q double, t double, n int"]))


def _labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(row, fold, good, fine, clean, n_chars, gram): equal texts share a fold, so copies are not on two sides."""
    rated = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.coalesce(F.min("quality"), F.lit(0)) == 1).cast("int").alias("fine"),
        (F.coalesce(F.max("toxic"), F.lit(0)) == 0).cast("int").alias("clean"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.xxhash64("doc_id", "text").alias("row"), F.pmod(F.xxhash64("text", F.lit(FOLDS)), F.lit(FOLDS)).alias("fold"),
        (F.col("fine") * F.col("clean")).alias("good"), "fine", "clean",
        F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), _grams(F.col("text")).alias("gram"))


def _counts(sample: DataFrame) -> np.ndarray:
    """(6, BUCKETS): uses and documents of each bucket in all, fine and clean text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, BUCKETS), np.int64)
        for batch in batches:
            for g, fine, clean in zip(batch["gram"], batch["fine"], batch["clean"]):
                cells, uses = np.unique(np.asarray(g, np.int64), return_counts=True)
                for k, on in enumerate((1, fine, clean)):
                    total[k, cells] += on * uses
                    total[3 + k, cells] += on
        cells = np.flatnonzero(total[0])
        yield pd.DataFrame(dict(zip(["cell", *_COUNTS], [cells, *total[:, cells]])))

    summed = sample.select("gram", "fine", "clean").mapInPandas(run, ", ".join(f"{c} long" for c in ["cell", *_COUNTS])).groupBy(
        "cell").agg(*(F.sum(c).alias(c) for c in _COUNTS)).toPandas()
    out = np.zeros((6, BUCKETS))
    out[:, summed["cell"].to_numpy(np.int64)] = summed[_COUNTS].to_numpy().T
    return out


def fit_models(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, smooth: float = 5.0, rare: float = 16.0) -> tuple[Models, DataFrame]:
    """Two log-ratio models, and the labelled rows (row, fold, good, n_chars, score).

    Raw text is all labelled text. The first model's target is text of good
    quality, counted by uses; the second's is text that is not toxic, counted by
    documents. Both are smoothed and two-sided. As few words tell toxic text, a
    bucket of the second counts by its evidence: (z^2 / (z^2 + ``rare``))^2 of its log ratio, with z
    in standard errors. At most ``fit_rows`` labelled ids, by hash order, are used: the documented bound of the fit.

    Folds 0-2 of ``FOLDS`` give the counts, fold 3 the scale and the cut, and
    fold 4 nothing. A score is a mean per n-gram, so length has no weight of
    its own but for NEUTRAL n-grams: joined texts score about between their parts. The mean's unit in each model is
    the distance from the median to the 2 % quantile of good text, and the lesser of both counts.
    """
    sample = materialise(_labelled(docs, labels, fit_rows), "quality-fit")
    n_fit, n_clean = sample.filter("fold < 3").agg(F.count("*"), F.coalesce(F.sum("clean"), F.lit(0))).first()
    uses, fine, _, rows, _, clean = _counts(sample.filter("fold < 3"))
    share = fine.sum() / max(1.0, uses.sum()) or 1.0
    quality = np.log((fine + smooth * share) / (share * (uses + smooth)))
    share = n_clean / max(1, n_fit) or 1.0
    z2 = (clean - rows * share) ** 2 / (rows * share * (1 - share) + 1e-9)
    toxic = np.log((clean + 0.5 * share) / (share * (rows + 0.5))) * (z2 / (z2 + rare)) ** 2
    models = Models(np.array([quality, toxic]), np.zeros(2), np.ones(2))

    rated = materialise(_means(sample.select("row", "fold", "good", "n_chars", "gram"), models.weights), "quality-rated")
    side = rated.filter("fold = 3 AND good = 1 AND q IS NOT NULL").select("q", "t").toPandas().to_numpy()
    if len(side):
        models.center = np.median(side, axis=0)
        models.spread = np.maximum(models.center - np.quantile(side, 0.02, axis=0), 1e-3)
    rated = rated.withColumn("score", models.score)
    tune = rated.filter("fold = 3").select("good", "score").toPandas()
    score, good = tune["score"].to_numpy(), tune["good"].to_numpy() == 1
    best = 0.0
    for cut in np.unique(score):
        gain = (score[~good] < cut).sum() / max(1, (~good).sum()) - (score[good] < cut).sum() / max(1, good.sum())
        if gain > best:
            best, models.cut = gain, float(cut)
    return models, rated


def rejections_by_length(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(chars, good, n, rejected) of the labelled rows that the fit has not used; ``chars`` is the lower bound of a range."""
    models, rows = fit_models(docs, labels, fit_rows)
    bounds = F.array(*(F.lit(x) for x in (0, 2000, 5000, 10000, 20000)))
    return rows.filter("fold = 4").groupBy(F.array_max(F.filter(bounds, lambda b: b <= F.col("n_chars"))).alias("chars"), "good").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") < models.cut).alias("rejected"))


def score_documents(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, row, log_weight, copies) per distinct (doc_id, text); ``row`` identifies equal rows."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _grams(F.col("text")).alias("gram"))
    return _means(rows, models.weights).select("doc_id", "row", models.score.alias("log_weight")).groupBy("doc_id", "row").agg(
        F.min("log_weight").alias("log_weight"), F.count("*").alias("copies"))


def gumbel(row: Column, seed: int) -> Column:
    """Standard Gumbel noise fixed by the row's hash: the same on every retry."""
    u = (F.shiftrightunsigned(F.xxhash64(row, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k_cut(keys: DataFrame, k: int, key: str = "key") -> tuple[float, int] | None:
    """(value of the k-th largest key, how many equal to it fit), by narrowing ranges of 4096 bins."""
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low, n
    need = k
    while low < high:
        step = (high - low) / 4096
        if step == 0.0 or low + step == low:
            break
        at = F.least(F.floor((F.col(key) - low) / step), F.lit(4095)).alias("bin")
        part = keys.filter(F.col(key).between(low, high))
        moved = False
        for b in sorted(part.groupBy(at).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), reverse=True):
            if b["n"] >= need:
                moved = (b["lo"], b["hi"]) != (low, high)
                low, high = b["lo"], b["hi"]
                break
            need -= b["n"]
        if not moved:
            break
    return low, need


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 0.25,
             seed: int = 7) -> DataFrame:
    """One row per distinct (doc_id, text): log_weight, key and ``selected``.

    The k largest of ``log_weight / temperature + Gumbel noise`` are selected: a
    sample without replacement in proportion to the tempered weights. ``k``
    defaults to the number of rows whose weight is above the fitted cut, so it
    grows with the clean text. Ties at the k-th key are all selected. The unit of weights is
    the distance from good text's median to its lowest 2 %, so noise decides near the cut only.

    Null and empty texts have weight zero (no evidence against them). Repeated
    rows share one row (``copies``). Without labels everything is selected.
    """
    models, _ = fit_models(docs, labels)
    scored = score_documents(docs, models).withColumn(
        "key", F.col("log_weight") / temperature + gumbel(F.col("row"), seed))
    scored = materialise(scored, "quality-scores")
    if k is None:
        k = scored.filter(F.col("log_weight") >= models.cut).count()
    found = top_k_cut(scored, k)
    return scored.withColumn("selected", F.lit(False) if found is None else F.col("key") >= found[0])
