"""What the toxicity model learns from, and what the pipeline drops without it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskscan.llm import toxicity


def corpus(n, words, seed=3):
    """doc_id, text, lang, toxic: a third of the texts hold a bad word every 50 words."""
    r = random.Random(seed)
    common = ["w%d" % i for i in range(200)]
    rows = []
    for i in range(n):
        y = int(i % 3 == 0)
        text = [r.choice(common) for _ in range(words)]
        if y:
            text[::50] = ["scumbag"] * len(text[::50])
        rows.append((i, " ".join(text), "en", y))
    return rows


def written(spark, tmp_path, rows, labels=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").withColumns({"source": F.lit("s"), "n_chars": F.length("text")})
    df.drop("toxic").write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", "toxic").filter(labels or "true").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)


@pytest.mark.parametrize("labels", ["false", "toxic = 1", "toxic = 0", "doc_id < 2"])
def test_pipeline_without_both_labels_keeps_everything(spark, tmp_path, labels):
    docs, folder = written(spark, tmp_path, corpus(30, 40), labels)
    assert corpus_pipeline.without_toxic(spark, docs, folder).count() == 30


def test_pipeline_with_only_long_labelled_texts(spark, tmp_path):
    rows = corpus(120, 3000)
    assert min(len(t) for _, t, _, _ in rows) > toxicity.SAMPLE_CHARS
    docs, folder = written(spark, tmp_path, rows)
    kept = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, folder).collect()}
    assert np.mean([(i in kept) == (y == 0) for i, _, _, y in rows]) > 0.95


def test_sample_takes_short_texts_first_and_bounds_long_ones(spark):
    rows = [(i, "a" * (500 if i % 4 < 2 else 50), "en", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    lengths = lambda n: toxicity.sample(df.drop("toxic"), df.select("doc_id", "toxic"), rows=n, chars=100).toPandas().groupby("y")["text"].apply(lambda t: sorted(map(len, t))).to_dict()
    assert lengths(10) == {0: [50] * 10, 1: [50] * 10}
    assert lengths(20) == {0: [50] * 10 + [150] * 10, 1: [50] * 10 + [150] * 10}
    assert lengths(100) == {0: [50] * 10 + [500] * 10, 1: [50] * 10 + [500] * 10}


def test_level():
    assert [toxicity.level(x, 30) for x in ([], [5], [10, 20], [100], [4, 50, 60], [30, 30, 30])] == [0, 5, 20, 30, 13, 10]


@pytest.mark.parametrize("labels", ["false", "toxic = 1", "toxic = 0", "doc_id < 2"])
def test_predicted_is_the_score_at_a_half_with_any_labels(spark, tmp_path, labels):
    """The contract's column: 1 at 0.5 or more, whatever could be learned; the score is then the share of label 1."""
    from riskscan.llm import queries

    _, folder = written(spark, tmp_path, corpus(60, 40), labels)
    got = queries.QUERIES["op3_toxicity"](spark, folder).collect()
    assert len(got) == 60 and all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    assert not any(r["rejected"] for r in got)
    if labels == "toxic = 1":
        assert all(r["predicted"] == 1 for r in got)
    if labels in ("false", "toxic = 0"):
        assert all(r["predicted"] == 0 for r in got)
