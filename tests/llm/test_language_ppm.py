"""Language prediction against a plain tree of dictionaries, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscan.llm import language_ppm as L
from riskscan.llm import queries

SF = "/root/testdata/sf0.01"


def brute(train, text, order):
    """Bits of a text: contexts in a dictionary, one byte after the other."""
    after = defaultdict(Counter)
    for t in train:
        padded = b"\0" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                after[padded[i - k : i]][padded[i]] += 1
    padded, total = b"\0" * order + text, 0.0
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            seen = after.get(padded[i - k : i])
            if seen is None:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if padded[i] in seen:
                total -= math.log2(seen[padded[i]] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [0, 1, 4, 7])
def test_code_lengths_equal_plain_trees(order, monkeypatch):
    r = random.Random(order)
    # Small arrays, so that texts are scored in several parts.
    monkeypatch.setattr(L, "TOGETHER", 37)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n)).encode()
    train = [[make("abab c", r.randint(0, 60)) for _ in range(5)], [make("xyé\0 a", r.randint(1, 60)) for _ in range(5)]]
    texts = [make("abxyé\0 ü", n) for n in (0, 1, 2, 5, 40, 36, 37, 38, 200)]
    model = L.Model(["one", "two"], [L.tree(t, order) for t in train])
    found = L.lengths(texts, model)
    want = [[brute(t, text, order) for t in train] for text in texts]
    assert np.allclose(found, want)


def test_held_out_accuracy(spark):
    """Over nine tenths of the held-out rows; the same rows whatever the partitions."""
    rows = queries.QUERIES["op12_language_id"](spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = rows.join(documents, "doc_id").filter("held_out").toPandas()
    assert len(got) > 150 and (got["lang_pred"] == got["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_labels_of_held_out_rows_and_other_columns_are_never_read(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    documents.withColumn("lang", F.when(held_out, F.lit("qq")).otherwise(F.col("lang"))).write.parquet(str(tmp_path / "a/documents.parquet"))
    documents.withColumn("source", F.lit("x")).withColumn("score", F.lit(1)).write.parquet(str(tmp_path / "b/documents.parquet"))
    a, b = ({r["doc_id"]: r for r in queries.QUERIES["op12_language_id"](spark, str(tmp_path / x)).collect()} for x in "ab")
    assert a == b and all(r["lang_pred"] != "qq" for r in a.values())


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "123 !?", "de"), (5, "no tag", None), (None, "wer", "xx")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fitted(labelled)
    # Rows without a letter, a tag or an id teach nothing.
    assert model.languages == ["en", "fr"]
    asked = [(1, "the dog", 7), (2, "le chien", 7), (3, None, 7), (4, "", 7), (5, " 12 ", 7), (6, "é", 7), (1, "the dog", 7), (None, "日本", 7)]
    df = spark.createDataFrame(asked, "id long, text string, score int").withColumn("lang_pred", F.lit("old"))
    got = [tuple(r) for r in L.predicted(df, model).select("id", "lang_pred", F.round("score", 1)).collect()]
    assert [x[1] for x in got] == ["en", "fr", "und", "und", "und", got[5][1], "en", got[7][1]]
    assert [x[2] for x in got[2:5]] == [0, 0, 0] and got[5][1] in model.languages and got[0] == got[6]
    bits = {(r["id"], r["lang"]): r["bits"] for r in L.code_lengths(df, model, id_col="id").filter("id is not null").collect()}
    assert bits[1, "en"] < bits[1, "fr"] and bits[3, "en"] == 0
    none = L.fitted(labelled.filter("false"))
    assert none.languages == []
    assert {tuple(r) for r in L.predicted(df, none).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert L.predicted(df.filter("false"), model).collect() == [] and L.code_lengths(df, none, id_col="id").collect() == []


def test_sample_is_bounded(spark):
    rows = [(i, "word " * (i % 50 + 1), f"l{i % 3}") for i in range(900)] + [(i, "word " * 9, "l0") for i in range(900, 2000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.sample(labelled, rows=40, chars=2000, together=3000).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()
    assert sorted(r["lang"] for r in got) == ["l0", "l1", "l2"]
    assert all(r["n"] == 40 and 0 < r["c"] <= 1000 for r in got)


def test_a_frequent_language_sends_few_ids_to_its_window(spark):
    """The picked rows are those of the lowest hashes, as if all had been ordered."""
    rows = [(i, f"word{i}", "big" if i % 20 else "small") for i in range(6000)] + [(1, "word1", "big")] * 500
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["text"] for r in L.sample(labelled, rows=30).collect()}
    order = labelled.distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(L.HASHES)))
    want = {r["text"] for x in ("big", "small") for r in order.filter(F.col("lang") == x).orderBy("h", "doc_id").limit(30).collect()}
    assert got == want and len(got) == 60
