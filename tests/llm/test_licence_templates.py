"""Licences of any number and length, from lists and tables."""

import random

from pyspark.sql import functions as F

from riskscan.llm import licences

SCHEMA = "template long, licence string, text string"


def held(df):
    return {(r.doc_id, r.licence, r.template) for r in df.collect()}


def test_many_and_long_templates_from_a_table(spark, monkeypatch):
    r = random.Random(2)
    words = lambda n: " ".join("t%d" % r.randrange(3000) for _ in range(n))
    templates = [(n, f"L{n}", words(12)) for n in range(600)] + [(600, "long", words(5600))]
    docs = [(n, f"{words(40)} {templates[n][2]} {words(40)}") for n in range(0, 600, 60)]
    docs += [(600, f"{words(700)} {templates[600][2]} {words(300)}"), (601, " ".join(templates[600][2].split()[:4000])), (602, words(3000))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, templates[d][1], d) for d, _ in docs if d <= 600}
    table = spark.createDataFrame(templates, SCHEMA)
    assert held(licences.licensed(df, table)) == want
    monkeypatch.setattr(licences, "PASS", 6000)
    assert held(licences.licensed(df, table)) == want


def test_whole_licences_without_their_notices(spark):
    bodies = {(n, licence): text for n, licence, text in licences.known() if n >= len(licences.NOTICES)}
    assert {"GPL-3.0", "MPL-2.0", "LGPL-3.0", "Apache-2.0"} <= {licence for _, licence in bodies}
    docs = [(n, "some words before " + text.split("APPENDIX: How to apply")[0] + " and after") for (n, _), text in bodies.items()]
    got = held(licences.licensed(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {(n, licence, n) for n, licence in bodies} <= got


def looked_up(docs, templates, threshold=0.8):
    """Every shingle of every template looked up in every window of its class: the truth that bands are held against."""
    found = set()
    for doc, text in docs:
        words = licences.words_of(text or "")
        for number, licence, body in templates:
            size = min(licences.WORDS, len(licences.words_of(body)))
            own = set(licences.shingles_of(body, size)) if size else set()
            if not own:
                continue
            block = licences.block_of(len(own))
            length = licences.window_of(block) + size - 1
            for start in range(0, max(1, len(words) - size + 1), block):
                window = words[start : start + length]
                there = {" ".join(window[i : i + size]) for i in range(len(window) - size + 1)}
                if len(own & there) >= threshold * len(own):
                    found.add((doc, licence, number))
                    break
    return found


def test_bands_find_what_looking_up_every_shingle_finds(spark):
    """Near copies of templates of many lengths with words changed, at the threshold and below it: recall 0.99 or more, nothing wrong."""
    r = random.Random(11)
    word = lambda: "v%d" % r.randrange(900)
    templates, docs = [], []
    for n in range(90):
        words = [word() for _ in range(r.choice([5, 6, 7, 9, 12, 20, 35, 80, 300, 1200]))]
        templates.append((n, f"L{n % 9}", " ".join(words)))
        for k in range(4):
            near = list(words)
            for _ in range(r.choice([0, 1, len(words) // 60, len(words) // 25])):
                near[r.randrange(len(near))] = word()
            around = [[word() for _ in range(r.randint(0, 200))] for _ in range(2)]
            docs.append((n * 10 + k, " ".join(around[0] + near + around[1])))
    want = looked_up(docs, templates)
    got = held(licences.licensed(spark.createDataFrame(docs, "doc_id long, text string"), templates))
    assert got <= want and len(got) >= 0.99 * len(want) > 200


def test_the_bound_on_what_bands_miss():
    """The stated bound holds for drawn hashes, and is small for every length."""
    r = random.Random(3)
    for n in [1, 2, 3, 5, 8, 10, 13, 30, 64, 200, 1000, 6000]:
        bound = licences.miss_bound(n)
        assert bound < (1e-3 if n >= 4 or n == 1 else 0.02) and (n <= 10 or bound < 1e-5)
    n = 5
    held_, window = 4, licences.window_of(licences.block_of(n))
    missed = 0
    for _ in range(4000):
        hashes = [r.getrandbits(64) for _ in range(window + n - held_)]
        own, there = hashes[:n], hashes[n - held_ :]
        least = lambda values: {min(v for v in values if (v >> 32) % licences.BINS == b) for b in {(v >> 32) % licences.BINS for v in values}}
        missed += not (least(own) & least(there))
    assert missed / 4000 <= licences.miss_bound(n) + 1e-3


def test_sketch_is_the_smallest_hash_of_each_bin(spark):
    r = random.Random(5)
    rows = [([r.getrandbits(64) - (1 << 63) for _ in range(k)],) for k in (0, 1, 7, 300, 2000)]
    got = spark.createDataFrame(rows, "h array<long>").select("h", licences.sketch(F.col("h")).alias("s")).collect()
    for x in got:
        bins = {}
        for h in x.h:
            b = ((h & (2**64 - 1)) >> 32) % licences.BINS
            bins[b] = min(h, bins.get(b, h))
        assert sorted(x.s) == sorted(bins.values())


def test_short_templates_stand_inside_longer_texts(spark):
    templates = [(1, "A", "MIT License"), (2, "B", "public domain"), (3, "C", "zlib"), (4, "D", "see the file licence"), (5, "E", "   "), (6, "F", "one two three four five")]
    docs = [(1, "under the MIT license, all of it and more words"), (2, "license MIT"), (3, "zlib"), (4, "a b see the FILE: licence"), (5, None), (6, "x one two three four five y"), (6, "x one two three four five y"), (7, "publicdomain")]
    got = sorted((r.doc_id, r.licence, r.first_word) for r in licences.licensed(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect())
    assert got == [(1, "A", 3), (3, "C", 1), (4, "D", 3), (6, "F", 2), (6, "F", 2)]
