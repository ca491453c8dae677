"""Addresses as people write them, and long descriptions."""

import time

from pyspark.sql import functions as F

from riskscan.functions import urls as U
from riskscan.operators import external as X


def answers(spark, fn, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


def test_hosts_of_odd_addresses(spark):
    given = ["https://a.example/x#y#z", "https://a.example/x y|z", "https://A.example\\@b.example/", "https://a.example:8/{id}", "https://${HOST}/x", "not an address", None]
    assert answers(spark, U.host, given) == ["a.example", "a.example", "a.example", "a.example", None, None, None]


def test_nothing_but_secrets_is_hidden(spark):
    pairs = {
        "https://u:a:b@h.example/": "https://u:****@h.example/",
        "https://h.example/a?flag&empty=&x=1#top": "https://h.example/a?flag&empty=&x=1#top",
        "https://h.example/#access_token=abcdefghijklmnop&x=1": "https://h.example/#access_token=abcd****&x=1",
        "https://h.example/#/page?api_key=abcdefghijklmnop": "https://h.example/#/page?api_key=abcd****",
        "https://h.example/a b?password=q w e": "https://h.example/a b?password=****",
        "https://u:p w@h.example/": "https://u:****@h.example/",
        "https://h.example/at@home:x": "https://h.example/at@home:x",
        "https://u:@h.example/": "https://u:@h.example/",
        "": "",
        None: None,
    }
    assert answers(spark, U.masked, list(pairs)) == list(pairs.values())


def test_sentences_go_whole_and_in_linear_time(spark):
    clean = lambda t: X.clean(t, hidden_words="paid plan")
    given = ["Fine. Paid plan here. Good.", "A paid plan a. A paid plan b. Rest", "One paid plan, two paid plans", "Line\nof a paid plan. Kept.", "Unpaid planning.", ".. paid plan .."]
    assert answers(spark, clean, given) == ["Fine.Good.", "Rest", "", "Kept.", "Unpaid planning.", "..."]
    start = time.time()
    assert answers(spark, clean, ["no dot at all " * 40_000])[0] == ("no dot at all " * 40_000).strip()
    assert time.time() - start < 20
