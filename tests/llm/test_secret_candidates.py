"""Short secrets and secrets with signs are candidates."""

import random

from pyspark.sql import functions as F

from riskscan.functions.secrets import find_secrets
from riskscan.llm import secret_forest

TEXTS = {
    1: ('say password = "Tr0ub4dor&3.xK9!mQ2z" here', "Tr0ub4dor&3.xK9!mQ2z"),
    2: ("postgres://admin:s3cr#t!9@db.local/main", "s3cr#t!9"),
    3: ("the bot xoxb-" + "1234567890 posts", "xoxb-" + "1234567890"),
    4: ("pwd: hunter2!", "hunter2!"),
    5: ("DB_PASSWORD=ab.12~c, next", "ab.12~c"),
    6: ("api_key => 'k3y*A1'", "k3y*A1"),
    7: ("token =Zx9%Zx9% end.", "Zx9%Zx9%"),
    8: ('{"secret":"a1@b2^c3d4e5f6g7h8","x":1}', "a1@b2^c3d4e5f6g7h8"),
    9: ('password = "it\'s4me!now"', "it's4me!now"),
}


def test_whole_values_are_candidates(spark):
    df = spark.createDataFrame([(n, text) for n, (text, _) in TEXTS.items()] + [(90, "plain words, nothing else: fine")], "doc_id long, text string")
    got = secret_forest.candidates(df)
    named = secret_forest.by_assignment(got).withColumnRenamed("label", "named")
    rows = {(r.doc_id, r.value): r.named for r in got.join(named, ["_row", "word_no", "part_no"]).collect()}
    assert {(n, value) for n, (_, value) in TEXTS.items()} <= set(rows) and not any(n == 90 for n, _ in rows)
    assert all(rows[n, TEXTS[n][1]] == 1 for n in (1, 4, 5, 6, 7, 8, 9))
    places = got.groupBy("_row", "word_no", "part_no").count()
    assert places.filter("count > 1").count() == 0
    library = df.select("doc_id", F.explode(find_secrets(F.col("text"))).alias("s")).select("doc_id", "s.value").collect()
    assert len(library) >= 3 and {(r.doc_id, r.value) for r in library} <= set(rows)


def test_forest_keeps_short_secrets(spark):
    r = random.Random(5)
    words = ["".join(r.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(r.randint(6, 9))) for _ in range(80)]
    docs = []
    for i in range(300):
        text = [r.choice(words) for _ in range(20)]
        value = "".join(r.choice("aB3$x9!Qz7.k&") for _ in range(12))
        text[5:5] = ["password", "=", f'"{value}"'] if i % 3 == 0 else [f'"{r.choice(words)}"']
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = secret_forest.candidates(df)
    got = secret_forest.scan(df, found, secret_forest.by_assignment(found.filter("doc_id % 2 = 0"))).filter("doc_id % 2 = 1").collect()
    assert sum(x.kept == (x.doc_id % 3 == 0) for x in got) > 0.95 * len(got) > 100
