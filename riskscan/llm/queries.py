"""The operators of this package as queries over the driver tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL twin."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op9_exact_dedup",
    r"""
    with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
    g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
    select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
    from t join g on t.norm = g.norm
    """,
)
def op9_exact_dedup(spark, sf_dir):
    """Exact duplicates by block naming."""
    from riskscan.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark, sf_dir):
    """Near duplicates by SimHash with pigeonring filtering."""
    from riskscan.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    """Encoding and decoding of all documents with a public tokenizer."""
    import public_tokenizers

    from riskscan.llm.bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    """A convolutional classifier learned from four fifths of the labels, for every document."""
    from riskscan.llm import toxicity

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fitted(documents, labels.filter(~held_out))
    rows = toxicity.scored(documents.select("doc_id", "lang", "text"), model)
    return rows.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxicity.rejected(model).alias("rejected"),
    )


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark, sf_dir):
    """The benchmark items that documents hold."""
    from riskscan.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    """Eight shards of near equal bytes that keep equal texts together."""
    from riskscan.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    """The main text of every page, with costs fitted to a sample of the pages."""
    from riskscan.llm.html_extraction import extracted, fitted

    pages = table(spark, sf_dir, "pages")
    return extracted(pages, weights=fitted(pages))


@query("op8_warc")
def op8_warc(spark, sf_dir):
    """All pages into archives with an index, and all records read back."""
    from riskscan.llm.warc import archived, read

    index, folder = archived(table(spark, sf_dir, "pages"))
    return read(index, folder).select(
        "page_id", "payload_bytes", F.col("read_digest").alias("payload_digest"), F.col("read_type").alias("record_type"), "refers_to", "archive", "offset", "length"
    )


@query("op10_licence_scan")
def op10_licence_scan(spark, sf_dir):
    """Licence notices in all documents."""
    from riskscan.llm.licences import licensed

    return licensed(table(spark, sf_dir, "documents"))


@query("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    """Candidates of secrets in all documents, false positives removed by a forest learned from four fifths of them."""
    from riskscan.llm import secret_forest as S

    documents = table(spark, sf_dir, "documents").withColumn("path", F.col("source"))
    found = S.candidates(documents)
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return S.scan(documents, found, S.by_assignment(found.filter(learn))).withColumn("held_out", ~learn)


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    """Runs of repeated words in all documents; every tenth one has a stretch of a known period put in."""
    from riskscan.llm.periodic_runs import periodic_runs

    h = F.crc32(F.col("doc_id").cast("string"))
    rows = periodic_runs(table(spark, sf_dir, "documents"), seed=F.when(h % 10 == 0, F.floor(h / 10)))
    # Greatest length / period without rounding: by cross-multiplication.
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    order = lambda x, y: (
        F.when(more(x, y) > 0, -1).when(more(x, y) < 0, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
        .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = rows.withColumn("best", F.get(F.array_sort("runs", order), F.lit(0)))
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    """Links between the tokens of a byte-level and a piece tokenizer in all documents, with their counts over the corpus."""
    import public_tokenizers

    from riskscan.llm import token_alignment as A
    from riskscan.llm.tables import saved

    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = A.aligned(table(spark, sf_dir, "documents"), a_path, b_path)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = saved(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return A.scored(rows, A.aligner(a_path, b_path).b_size).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"
    )


@query("op12_language_id")
def op12_language_id(spark, sf_dir):
    """The language of all documents by context trees learned from three quarters of them."""
    from riskscan.llm import language_ppm as L

    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = L.fitted(documents.filter(~held_out).select("doc_id", "text", "lang"))
    return L.predicted(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
