"""Tables whose own columns have the names that operators use inside."""

from pyspark.sql import functions as F

from riskscan.llm import exact_dedup, simhash

ROWS = [(1, "one text of some words"), (2, "one  text of some words"), (2, "one  text of some words"), (3, "another text altogether, longer than the first"), (3, "another text altogether, longer than the first"), (None, "no id")]


def clashing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in ("_sha", "_keep", "_twice", "__keep", "count", "kept", "component_id", "_id", "_fp")])


def test_deduplicated_keeps_own_columns(spark):
    for module in (exact_dedup, simhash):
        df = clashing(spark)
        got = module.deduplicated(df)
        assert got.columns == df.columns
        rows = got.collect()
        assert sorted((r.doc_id for r in rows), key=str) == [1, 3, None]
        assert all(r["_sha"] == "own _sha" and r["_keep"] == "own _keep" and r["__keep"] == "own __keep" for r in rows)
