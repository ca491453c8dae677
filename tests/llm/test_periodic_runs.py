"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscan.llm import periodic_runs as P
from riskscan.llm import queries


def brute(words):
    """All (start, length, period) by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            stretch = words[at : end + q]
            smaller = any(all(stretch[i] == stretch[i + d] for i in range(len(stretch) - d)) for d in range(1, q))
            if len(stretch) >= max(6, 4 * q) and not smaller:
                out.append((at, len(stretch), q))
            at = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    return [(n, [tuple(r) for r in runs.tolist()], collapsed) for n, runs, collapsed in P._results([(t.encode(), None) for t in texts])]


def texts(r):
    for _ in range(300):
        letters = "abcd"[: r.choice([1, 2, 2, 3, 4])]
        words = [r.choice(letters) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice(letters) for _ in range(r.randint(1, 14))]
            at = r.randint(0, len(words))
            words[at:at] = (unit * r.randint(3, 9))[: r.randint(1, 120)]
        yield words
    word = ["a"]
    for _ in range(8):
        word = [x for w in word for x in (["a", "b"] if w == "a" else ["a"])]
    yield word
    yield word * 5


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    own = list(texts(r))
    for words, (n, runs, collapsed) in zip(own, found(" ".join(w) for w in own), strict=True):
        assert n == len(words)
        want = brute(words)
        assert runs == want, words
        dropped = {i for start, length, q in want for i in range(start + q, start + length)}
        assert collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_in_a_long_text_with_nested_periods():
    """A period of 3,000 words that holds shorter runs itself, with hundreds of neighbours."""
    r = random.Random(5)
    unit = [str(r.randint(0, 400)) for _ in range(2900)] + ["x"] * 40 + ["y", "z"] * 30
    words = [str(i) for i in range(500)] + unit * 5 + ["end"]
    ((_, runs, _),) = found([" ".join(words)])
    assert (500, 15000, 3000) in runs
    assert [x for x in runs if x[2] == 1] == [(500 + 2900 + k * 3000, 40, 1) for k in range(5)]
    assert [x for x in runs if x[2] == 2] == [(500 + 2940 + k * 3000, 60, 2) for k in range(5)]
    assert len(runs) == 11


def test_a_very_long_text_of_one_word():
    n, runs, collapsed = found(["ha " * 400_000])[0]
    assert (n, runs, collapsed) == (400_000, [(0, 400_000, 1)], "ha")


def test_small_synchronising_sets_by_their_definition():
    """The window minimum is that of a plain loop."""
    values = np.random.default_rng(1).integers(0, 50, 97).astype(np.uint64)
    for width in (2, 3, 5, 9, 97, 120):
        want = [min(values[i : i + width]) for i in range(len(values))]
        assert P._smallest(values, width).tolist() == want


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    rows = [(i, " \t\n".join(r.choice("abc") for _ in range(r.randint(0, 50))), "en") for i in range(120)]
    rows += [(500, None, None), (501, "", "en"), (502, " \n ", "en"), (503, "a" * 50, "en"), (503, "a" * 50, "en"), (504, "é x " * 9, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect(), key=lambda x: x["doc_id"])
    assert len(got) == len(rows)
    for (doc, text, _), row in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want = brute(words)
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert row["n_runs"] == len(want)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in want).encode()).hexdigest()
        dropped = {i for s, k, q in want for i in range(s + q, s + k)}
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.periodic_runs(none).collect() == []
    clash = spark.createDataFrame([(None, "a a a a a a b", "x", 1)], "doc_id long, text string, runs string, _text int")
    (row,) = P.periodic_runs(clash, seed=F.lit(None)).collect()
    assert row["id"] is None and [tuple(x) for x in row["runs"]] == [(0, 6, 1)] and row["collapsed"] == "a b"
