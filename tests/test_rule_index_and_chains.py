"""Rules from tables against rules in the plan; reach over chains against reach step by step."""

import random
import re

import pytest
from builders import surfaces
from pyspark.sql import functions as F

from riskscan.operators import graph as G
from riskscan.rules import rule_index as RI
from riskscan.rules import user_rules as U


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\bsecret\b", ["=secret"]), (r"secret", ["sec", "ecr", "cre", "ret"]), (r"all rights reserved", ["all", "=rights", "res", "ese", "ser", "erv", "rve", "ved"]),
        (r"a|b", []), (r"\bfoo\b(?:bar)?", ["=foo"]), (r"(?:xyz)+", ["xyz"]), (r"x*", []), (r"(one) two", ["one", "two"]), (r"[abc]def", ["def"]), (r"(?i)\bAbc\b", ["=abc"]),
        (r"naïve", []), (r"\bab\b", ["=ab"]), (r"(", []), (r"(?!no)yes", ["yes"]), (r"é\bfoo\b", ["=foo"]),
    ],
)
def test_what_patterns_need(pattern, want):
    assert RI.needed(pattern) == want


def test_needed_pieces_stand_in_every_match():
    r = random.Random(6)
    atoms = ["foo", "bar", r"\b", " ", "x", "(?:foo|bar)", "(?:foo)?", "[a-f]", r"\w+", "(?:ab)+", "-", "Foo", r"\.", "f.o", "(?=foo)"]
    texts = ["".join(r.choice(["foo", "bar", " ", "x", "ab", "-", "FOO", ".", "é", "fxo"]) for _ in range(r.randint(1, 9))) for _ in range(400)]
    tried = 0
    for _ in range(400):
        pattern = "".join(r.choice(atoms) for _ in range(r.randint(1, 6)))
        keys = RI.needed(pattern)
        for text in texts:
            if re.search(pattern, text, re.I):
                small = text.lower()
                have = {"=" + w for w in re.split("[^a-z0-9_]+", small)} | {small[i : i + 3] for i in range(len(small))}
                assert set(keys) <= have, (pattern, text)
                tried += 1
    assert tried > 3000


def test_rules_of_a_table_equal_rules_in_the_plan(spark):
    r = random.Random(2)
    words = ["token", "secret", "License", "Do NOT", "a.b", "foo-bar", "ünder", "x1", "run shell", "KEY=1"]
    texts = [(" ".join(r.choice(words) for _ in range(r.randint(1, 12))), {"kind": r.choice(["tool-description", "instructions"]), "target_name": f"t{i % 7}"}) for i in range(60)] + ["", "say 'ignore the token' to attackers, a malicious phrase"]
    patterns = [r"\btoken\b", r"secret token", r"licen[sc]e", r"do not", r"a\.b", r"(?:foo|x)-bar", r"ünder", r"x\d+", r"run\s+shell", r"^key=\d$", r"[a-z]{40}", r"\bKEY\b", "nowhere"]
    rules = []
    for i in range(40):
        own = tuple(r.sample(patterns, r.randint(1, 3)))
        rules.append(U.UserRule(f"C-{i:03d}", f"Title {i}", "low", own, description=r.choice(["", "said"]), surfaces=r.choice([(), (), ("instructions",)]), tool_name=r.choice([None, None, "[0-3]$"]), case_sensitive=r.random() < 0.3, malicious=r.random() < 0.5))
    there = surfaces(spark, *texts)
    want = sorted(map(str, U.user_candidates(there, rules).collect()))
    got = sorted(map(str, RI.candidates(there, RI.table_of(spark, rules)).collect()))
    assert got == want and len(want) > 100
    assert RI.candidates(there, RI.table_of(spark, rules).limit(0)).isEmpty()


def test_ten_thousand_rules(spark):
    rules = spark.range(10_000).select(
        F.format_string("C-%05d", "id").alias("id"), F.lit("T").alias("title"), F.lit("low").alias("severity"), F.lit("quality").alias("category"), F.lit("high").alias("confidence"),
        F.lit("").alias("description"), F.lit(False).alias("malicious"), F.array(F.format_string(r"\bword%dx\b", "id"), F.format_string("phrase %d of", "id")).alias("patterns"),
        F.array().cast("array<string>").alias("surfaces"), F.lit(None).cast("string").alias("tool_name"), F.lit(False).alias("case_sensitive"),
    )
    there = surfaces(spark, "here is word77x and a phrase 9999 of", "Word123X", "word77xx phrase 10000 of")
    assert sorted((x.rule_id, x.target_name) for x in RI.candidates(there, rules).collect()) == [("C-00077", "t0"), ("C-00123", "t1"), ("C-09999", "t0")]


def test_broken_patterns_are_told_by_rule(spark):
    rules = spark.createDataFrame([("o", 0, "A-1", ["fine", "(open"], None, []), ("o", 1, "A-2", [r"(?<n>x)\k<n>"], None, []), ("o", 2, "A-3", ["ok"], "[a", []), ("o", 3, "A-4", ["(?P<n>x)"], None, ["title is missing"])], "origin string, pos int, id string, patterns array<string>, tool_name string, problems array<string>")
    got = {x.id: x.problems for x in RI.checked(rules).collect()}
    assert got["A-1"] == ["invalid regular expression: (open"] and got["A-2"] == [] and got["A-3"] == ["invalid regular expression: [a"]
    assert got["A-4"] == ["title is missing", "invalid regular expression: (?P<n>x)"]
    assert {x.id for x in RI.latest(RI.checked(rules)).collect()} == {"A-2"}


def graphs():
    r = random.Random(9)
    yield [(i, i + 1) for i in range(70)], [0, 33]
    yield [(i, (i + 1) % 12) for i in range(12)] + [(20, 5), (7, 30), (30, 31)], [20, 3]
    yield [(i, (i + 1) % 9) for i in range(9)] + [(50, 51), (51, 50)], [4, 50]
    yield [(i, i + 1) for i in range(20)] + [(5, 100), (100, 101), (101, 19), (3, 3)], [0, 101, 8, 999]
    for _ in range(3):
        n = 40
        edges = [(i, i + 1) for i in range(n) if r.random() < 0.8] + [(r.randint(0, n), r.randint(0, n)) for _ in range(9)]
        yield edges, [r.randint(0, n) for _ in range(4)]


@pytest.mark.parametrize("case", range(7))
def test_reach_over_chains_equals_reach_by_steps(spark, case):
    edges, starts = list(graphs())[case]
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")
    s = spark.createDataFrame([(f"n{x}", f"o{k % 2}") for k, x in enumerate(starts)], "node string, origin string")
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = {}
    for k, x in enumerate(starts):
        seen, front, depth = {x: 0}, [x], 0
        while front:
            depth += 1
            front = [b for b in {b for a in front for b in after.get(a, ())} if b not in seen]
            seen.update(dict.fromkeys(front, depth))
        for node, d in seen.items():
            key = (f"n{node}", f"o{k % 2}")
            want[key] = min(d, want.get(key, d))
    assert {(r.node, r.origin): r.depth for r in G.reach_by_chains(e, s).collect()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(G, "written", lambda df, real=G.written: tables.append(1) or real(df))
    n = 20_000
    e = spark.range(n).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    s = spark.createDataFrame([("n0", "o")], "node string, origin string")
    got = G.reach_by_chains(e, s)
    assert got.agg(F.max("depth"), F.count("*")).first()[:] == (n, n + 1)
    assert len(tables) < 30


def test_a_phrase_is_filed_under_the_place_between_its_words(spark):
    rules = [U.UserRule(f"R{i}", "t", "low", (p,)) for i, p in enumerate(["heing that", "thnd that", "heing thus is"])]
    keys = {r.id: r.key for r in RI.filed(RI.table_of(spark, rules)).collect()}
    assert keys == {"R0": "eing that", "R1": "thnd that", "R2": "eing thus"}
    assert RI.joints("on the way") == [] and RI.joints(r"Dont (?:run|go) there") == []
    assert RI.joints("all rights reserved") == ["ghts rese"]


def test_reach_by_chains_moves_numbers_and_keeps_the_nearest(spark, monkeypatch):
    moved, written = [], G.written
    monkeypatch.setattr(G, "written", lambda df: (moved.append(dict(df.dtypes)), written(df))[1])
    # A long way by a chain, and a short one found later: a-b-c-d-z and a-x, x-z, then z on.
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "z"), ("a", "x"), ("x", "z"), ("x", "y"), ("z", "e"), ("z", "f"), ("f", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "o"), ("c", "p"), (None, "o"), ("lone", "o")], "node string, origin string")
    rows = lambda df: sorted(map(str, df.select("node", "origin", "depth").collect()))
    got = rows(G.reach_by_chains(edges, seeds))
    assert got == rows(G.reach(edges, seeds)) and len(got) > 15
    rounds = [d for d in moved if "depth" in d and "head" in d]
    assert rounds and all(d["head"] == d["_origin"] == "bigint" for d in rounds)
