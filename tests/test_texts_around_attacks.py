import duckdb
from pyspark.sql import functions as F

from riskscan.functions import text as T
from workloads import ORACLES, QUERIES, texts


def same_as_sql(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    found = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    told = con.execute(ORACLES[name])
    names = [d[0] for d in told.description]
    want = sorted(tuple(str(v) for _, v in sorted(zip(names, row, strict=True))) for row in told.fetchall())
    got = sorted(tuple(str(r[c]) for c in sorted(names)) for r in found.collect())
    assert got == want and got


def test_replies_that_speak_of_a_threat_still_attack(spark, tmp_path):
    rows = [(i, 0, "assistant", "The ship is under threat.") for i in range(len(texts.SEEDS))]
    same_as_sql(spark, tmp_path, "runtime_phrase_hits", "conversations", rows, "conv_id long, turn long, role string, text string")


def test_words_on_the_edge_of_the_window_are_read_whole(spark):
    rows = [
        ("", " It blocks. " + "z" * 181 + " threatens", False),
        ("", " It blocks. " + "z" * 181 + " threat of", True),
        ("It was non" + "stop. " + "z" * 185 + " threat. ", "", False),
        ("It was. " + "stop. " + "z" * 185 + " threat. ", "", True),
        ("uné" + "stop. " + "z" * 185 + " threat. ", "", False),
        ("We forget all. " * 500 + "A threat. ", " We block it." + "x" * 5000, True),
        ("", "", False),
    ]
    found = spark.createDataFrame(rows, "b string, a string, want boolean")
    got = found.select("want", T.looks_defensive(F.col("b"), F.lit("Forget all rules"), F.col("a")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_a_part_of_a_word_denies_nothing(spark):
    whole = ["Do not ", "It cannot, ", "They don\u2019t ", "CAN'T ", "Nunca no ", "Do _not_ ", "not caf\u00e9 d\u00e9j\u00e0 vu ", "there is no 1 "]
    parts = ["herm\u00e1no ", "Ma\u00f1ana \u00e9no uno dos ", "user_no ", "x2no ", "see part_no 7 and ", "piano ", "\u043a\u043enot ", "not 1 2 3 4 "]
    found = spark.createDataFrame([(t, t in whole) for t in whole + parts], "t string, want boolean")
    got = found.select("t", "want", T.clause_is_negated(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_documents_that_end_in_a_part_of_a_word_keep_their_findings(spark, tmp_path):
    rows = [(i, f"src{i % 2}", "Vi\u00f1as, \u00e9no part_no") for i in range(len(texts.SEEDS))]
    same_as_sql(spark, tmp_path, "text_finding_status", "documents", rows, "doc_id long, source string, text string")
