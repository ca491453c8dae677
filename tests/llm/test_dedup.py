"""Exact and near duplicates against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
import xxhash

from riskscan.llm import exact_dedup, simhash
from riskscan.llm.components import components

SCHEMA = "doc_id long, text string, lang string, _row string, _name string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    return sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_names_are_equal_exactly_for_equal_texts(spark, block):
    r = random.Random(block)
    texts = ["".join(r.choice("ab \té") for _ in range(r.randint(0, 24))) for _ in range(120)]
    texts += [texts[3], "a" * 100, "a" * 100, "a" * 99 + "b", "ab" * 50, "ab" * 51, None, "", " ", "\n"]
    rows = list(enumerate(texts))
    got = exact_dedup.exact_groups(frame(spark, rows), block=block)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == expected_groups(rows)


def test_long_texts_meet_at_their_last_name(spark):
    long = "word " * 40_000
    rows = [(1, long), (2, long + "x"), (3, long), (4, "y" + long[1:])]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(frame(spark, rows), block=512).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_repeated_rows_and_missing_ids(spark):
    rows = [(5, "a b"), (5, "a  b"), (None, "a b"), (None, "c"), (None, "c"), (7, None), (8, "")]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert len(got) == 7
    ab = [r for r in got if r.group_size == 3]
    assert {r.keep_id for r in ab} == {5} and sum(r.kept for r in ab) == 1
    c = [r for r in got if r.doc_id is None and r.group_size == 2]
    assert sum(r.kept for r in c) == 1
    assert {r.doc_id: r.kept for r in got if r.doc_id in (7, 8)} == {7: True, 8: False}
    left = exact_dedup.deduplicated(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "_row", "_name"]
    assert sorted((r.doc_id or 0, normal(r.text)) for r in left.collect()) == [(0, "c"), (5, "a b"), (7, "")]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.deduplicated(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert simhash.deduplicated(none).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_near_groups_against_brute_force(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(60)]
    base = [r.choice(words) for _ in range(400)]
    for _ in range(60):
        changed = list(base)
        for _ in range(r.randint(0, 6)):
            changed[r.randrange(400)] = r.choice(words)
        texts.append("  ".join(changed).upper() if r.random() < 0.3 else " ".join(changed))
    texts += [None, "", "\t", "one", "One", "one two", "ÄÖ äö"]
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(range(len(texts)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    got = simhash.near_groups(frame(spark, list(enumerate(texts))))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {i: ("%016x" % prints[i], want[i]) for i in range(len(texts))}


def test_links_between_random_fingerprints(spark):
    """Dense clusters and chains of fingerprints at every distance from 1 to 5."""
    r = random.Random(9)
    prints = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        prints.add(centre)
        for _ in range(25):
            x = centre
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
            centre = x if r.random() < 0.2 else centre
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = brute_components(prints, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    df = spark.createDataFrame([(p, 1 + p % 3) for p in prints], "_fp long, _weight long")
    got = {r.node: r.root for r in simhash.linked(df).collect()}
    named = {}
    for p in prints:
        named.setdefault(want[p], set()).add(got.get(p, p))
    assert all(len(x) == 1 for x in named.values())
    assert len({next(iter(x)) for x in named.values()}) == len(named)


def test_pieces_of_a_long_text_make_the_same_fingerprint(monkeypatch):
    text = " ".join("w%d" % (i * i % 97) for i in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "pieces", lambda data: __import__("riskscan.llm.tables", fromlist=["pieces"]).pieces(data, 50))
    assert simhash.fingerprint(text) == whole


def test_near_rows_that_stay(spark):
    text = " ".join("w%d" % i for i in range(50))
    rows = [(3, text), (1, text), (1, text), (2, "other words altogether here"), (None, text), (None, "x y z")]
    left = sorted((r.doc_id or 0, r.text) for r in simhash.deduplicated(frame(spark, rows)).collect())
    assert left == [(0, text), (0, "x y z"), (1, text), (2, "other words altogether here")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 60), (60, 100), (7, 7), (None, 3), (200, 300), (300, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 100: 50, 200: 200, 300: 200, 400: 200}
