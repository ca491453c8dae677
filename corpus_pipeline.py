"""A corpus made ready for training: toxic texts out, one of equal and of similar texts, no test items, tokens.

Each stage works on the rows the one before it kept, written as Parquet and read again. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.llm import bpe, decontamination, exact_dedup, simhash, toxicity
from riskscan.llm.tables import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects at the threshold of its language; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.fitted(docs, learn)
    scored = toxicity.scored(_documents(docs), model, name="_score")
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return _documents(scored.filter(~toxicity.rejected(model, "_score") | empty))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts."""
    return exact_dedup.deduplicated(_documents(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies."""
    return simhash.deduplicated(_documents(docs))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.cleaned(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole texts, with the hashes of ids and decoded texts."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_test_items),
    ("bpe", tokens),
]

#: The stages hold a trained model, a text classifier and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
