"""The pipeline's stages on rows that share ids, on near copies, and on awkward tables."""

import random

import pytest

import corpus_pipeline
from timbrewatch.llm import simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def prose(seed, n=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


@pytest.fixture()
def folder(spark, tmp_path):
    def write(rows):
        frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)
    return write


def brute_groups(rows, errors=6):
    """Linked texts, a pair at a time."""
    fps = [simhash.simhash(t or "", 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= errors:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    return group


def kept(spark, docs, sf_dir):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, docs), sf_dir).collect()), key=repr)


def test_rows_that_share_an_id(spark, folder):
    """Different texts of one id are different documents; no id and equal rows are defined."""
    rows = [(1, prose(1)), (1, prose(2)), (2, prose(1)), (3, prose(2)), (3, prose(3)), (4, prose(4)), (4, prose(4)), (None, prose(1)), (None, prose(1)), (5, None), (6, "")]
    want = [(1, prose(1)), (1, prose(2)), (3, prose(3)), (4, prose(4)), (5, None), (None, prose(1)), (None, prose(1))]
    for corpus in (rows, []):
        assert kept(spark, rows, folder(corpus)) == sorted(want, key=repr)
    assert kept(spark, [], folder([])) == []


def test_near_copies_go_although_line_dedup_left_little(spark, folder):
    corpus = [(i, prose(i)) for i in range(40)]
    near = [(100 + i, " ".join(w if k != 97 else f"x{i}" for k, w in enumerate(t.split()))) for i, t in corpus]
    left = corpus + [(i, " ".join(t.split()[:3]) + f" rest {i}") for i, t in near]
    got = {i for i, _ in kept(spark, left, folder(corpus + near))}
    rows = corpus + near
    groups = brute_groups(rows)
    first = {}
    for (i, _), g in sorted(zip(rows, groups)):
        first.setdefault(g, i)
    by_text = {first[g] for g in groups}
    assert {i for i in got if i < 100} == set(range(40)) and got <= by_text
    assert len([i for i in got if i >= 100]) <= 4


def test_stages_on_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
