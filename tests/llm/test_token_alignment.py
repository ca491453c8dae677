"""Token alignment against plain loops over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskscan.llm import queries
from riskscan.llm import token_alignment as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return A.Aligner(A_PATH, B_PATH)


def brute(own, text):
    """(a ids, b ids, groups text, links as id pairs, shared pairs) of the whole text, or None."""
    if not text:
        return None
    data = b" " + text.encode()
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    spans = []
    for ids, spelled in ((a, own.a_bytes), (b, own.b_bytes)):
        at, rows = 0, []
        for i in ids:
            rows.append((at, at + len(spelled[i]), i))
            at += len(spelled[i])
        if b"".join(spelled[i] for i in ids) != data:
            return None
        spans.append(rows)
    cuts = sorted({r[1] for r in spans[0]} & {r[1] for r in spans[1]})
    parts, shared, begin = [], 0, 0
    for cut in cuts:
        here = [[r[2] for r in rows if begin <= r[0] < cut] for rows in spans]
        parts.append("|".join(",".join(map(str, x)) for x in here))
        shared += len(here[0]) * len(here[1])
        begin = cut
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    return a, b, ";".join(parts), links, shared


def texts():
    r = random.Random(3)
    letters = "aeiou stnrhld  \n\t\x00\x1c\x85\xa0　​᠎éßñΣд日本한😀👩‍👧<>|.,'!?0129▁"
    yield from ("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(600))
    words = ["the", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", "naïve", "x" * 300, "日本語", "ﬁn", "a\nb", "1,234.5", "…", "a​b", "﻿"]
    yield from ("".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", ""]) for _ in range(r.randint(0, 30))) for _ in range(300))
    yield from [" ", "  a", "a ", "\n", "a  b", "▁", "a▁b c", "The quick brown fox " * 40]


def test_parts_put_together_equal_the_whole_text(own):
    assert own.cuts
    found = list(texts())
    zeros = 0
    for text, got in zip(found, A._rows(own, found, np.dtype(np.int32)), strict=True):
        n_a, n_b, n_groups, n_links, n_shared, spelled, pairs, times = got
        want = brute(own, text)
        if want is None:
            zeros += 1
            assert (n_a, n_b, n_groups, n_links, n_shared, spelled, len(pairs)) == (0, 0, 0, 0, 0, "", 0), text
            continue
        a, b, groups, links, shared = want
        assert (n_a, n_b, n_groups, n_links, n_shared) == (len(a), len(b), groups.count(";") + 1, len(links), shared), text
        assert spelled == groups, text
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == Counter(x * own.b_size + y for x, y in links), text
    assert 0 < zeros < len(found) / 2


def test_products_equal_dense_ones():
    r = np.random.default_rng(2)
    for _ in range(30):
        dense = [(r.random(shape) < 0.3).astype(int) for shape in ((7, 9), (9, 6))]
        rows = [A.Rows(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.concatenate([np.flatnonzero(x) for x in m])) for m in dense]
        want, got = dense[0] @ dense[1], np.zeros((7, 6), int)
        for i, j, v in A.product(*rows, block=4):
            got[i, j] += v
        assert (got == want).all()
        assert (A.entries(*rows) == dense[0] @ dense[1].sum(axis=1)).all()


def test_shared_links_come_in_blocks(monkeypatch):
    a_ends, b_ends = np.array([1, 3, 4, 6, 9]), np.array([2, 4, 5, 9])
    pairs = [(i, j) for rows, columns in A.shared(a_ends, b_ends) for i, j in zip(rows.tolist(), columns.tolist(), strict=True)]
    assert pairs == [(i, j) for i in range(3) for j in (0, 1)] + [(i, j) for i in (3, 4) for j in (2, 3)]
    i, j, shared = A.overlaps(a_ends, b_ends)
    assert list(zip(i.tolist(), j.tolist(), shared.tolist(), strict=True)) == [(0, 0, 1), (1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1), (3, 3, 1), (4, 3, 3)]


@pytest.mark.parametrize("hot", [None, 20])
def test_query_against_brute_force(spark, tmp_path, own, monkeypatch, hot):
    """Also where most pairs are counted by a shuffle."""
    if hot:
        monkeypatch.setattr(A.scored, "__defaults__", (hot,))
    docs = list(enumerate(list(texts())[::9])) + [(900, None), (901, ""), (902, "same text"), (902, "same text"), (None, "no id here")]
    spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, groups string, _row int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_token_alignment"](spark, str(tmp_path)).collect()
    whole = [brute(own, t) for _, t in docs]
    counts = Counter(x for w in whole if w for x in w[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for (doc, _), w in zip(docs, whole, strict=True):
        if w is None:
            want.append((doc, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, groups, links, shared = w
        sums = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        want.append((doc, len(a), len(b), groups.count(";") + 1, len(links), *sums, hashlib.sha256(groups.encode()).hexdigest(), shared))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.aligned(none, A_PATH, B_PATH).collect() == []
    rows = A.aligned(spark.createDataFrame([(1, "x" * 50_000), (2, "word " * 50_000)], "doc_id long, text string"), A_PATH, B_PATH)
    assert [r["n_a"] > 0 for r in rows.select("n_a").collect()] == [True, True]
    assert rows.filter(F.col("n_a") == 0).count() == 0
