"""Encoding, toxicity, test items, licences and secrets."""

import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscan.llm import bpe, decontamination, licences, secret_forest, toxicity
from riskscan.llm.tables import pieces, word_pieces

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, ids string, score string, _text string, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", "d") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_codec_equals_the_library(library):
    own, r = bpe.Codec(PATH), random.Random(3)
    letters = "aAbBzZ'sStTlLveVE  \n\t\x1c\x1f\x85\xa0 　éÉéΣσςİıßẞǅДд٣²½日本語한가😀👩‍👧..,!?&%$#*0123\x00﻿​ᾳͅﬁ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|> b", "<|ENDOFTEXT|>", "x" * 5000, "The quick brown fox's 42nd jump!", "", "naïve Ünïcode " * 50]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False).encode(), text


def test_cuts_are_between_bytes_that_no_token_joins():
    own = bpe.Codec(PATH)
    word = "".join(own.letters[b] for b in "zq日qé☃x".encode())
    parts = own.cut(word)
    assert "".join(parts) == word and len(parts) > 1
    assert all(a[-1] + b[0] not in own.joinable for a, b in zip(parts, parts[1:]))
    assert all(p[i : i + 2] in own.joinable for p in parts for i in range(len(p) - 1))


def test_memories_are_emptied_without_a_trace(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own, text = bpe.Codec(PATH), "one two three four five six seven one two three"
    assert own.encode(text) == bpe.Codec(PATH).encode(text)
    assert len(own.words) <= 3


def test_encoding_round_trip(spark, library):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "x" * 100_000), (4, "<|endoftext|>")]
    got = bpe.encoded(frame(spark, rows), PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in got.collect():
        text = dict((i, t) for i, t in rows)[r.doc_id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens) == (want, len(want))
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    texts = {r.doc_id: r.text for r in bpe.decoded(got, PATH).collect()}
    assert texts[1] == library.decode(library.encode("Hello there", add_special_tokens=False).ids, skip_special_tokens=False) and texts[2] == ""
    assert bpe.encoded(frame(spark, []), PATH).count() == 0


def toxic_rows(n, seed):
    r = random.Random(seed)
    common = ["w%d" % i for i in range(300)]
    bad = {"en": ["vile", "scumbag"], "de": ["mistkerl"], "fr": ["ordure"]}
    rows = []
    for i in range(n):
        lang, y = r.choice(["en", "de", "fr"]), int(r.random() < 0.3)
        words = [r.choice(common) for _ in range(r.randint(5, 80))]
        if y:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(bad[lang]))
        rows.append((i, " ".join(words), lang, y))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = toxic_rows(900, 1) + [(5000, None, None, 0), (5001, "", "en", 1), (5002, "x", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return toxicity.fitted(df.drop("toxic"), df.select("doc_id", "toxic"))


def test_toxicity_on_held_out_texts(spark, model):
    rows = toxic_rows(400, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = toxicity.scored(df, model).withColumn("no", toxicity.rejected(model)).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in got]) > 0.97
    assert np.mean([r.no == (r.toxic == 1) for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_reads_to_the_end(spark, model):
    filler = " ".join("w%d" % (i % 300) for i in range(60_000))
    rows = [(1, filler), (2, filler + " scumbag"), (3, None), (4, ""), (4, ""), (None, "...")]
    got = toxicity.scored(frame(spark, rows).drop("score"), model).collect()
    by = {r.doc_id: r.score for r in got}
    assert by[2] > 0.5 > by[1] and by[3] == by[4] and len(got) == 6
    assert toxicity.scored(frame(spark, []), model).count() == 0


def test_score_does_not_depend_on_pieces(model, monkeypatch):
    text = " ".join("w%d" % (i % 50) for i in range(500)) + " mistkerl " + " ".join("w%d" % i for i in range(100))
    want = toxicity.Scorer(model).score(text)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 7)
    assert toxicity.Scorer(model).score(text) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(toxicity, "word_pieces", lambda t: word_pieces(t, 40))
    assert toxicity.Scorer(model).score(text) == pytest.approx(want, abs=1e-9)


def test_training_without_labels_or_with_one(spark):
    df = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, toxic int")
    for labels in (none, one):
        fitted = toxicity.fitted(df, labels)
        assert all(0 <= r.score <= 1 for r in toxicity.scored(df.drop("score"), fitted).collect())


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(toxic_rows(200, 4), "doc_id long, text string, lang string, toxic int")
    got = toxicity.sample(df.drop("toxic"), df.select("doc_id", "toxic"), rows=20).toPandas()
    assert got["y"].value_counts().to_dict() == {0: 20, 1: 20}


def shingles(text, size=5):
    words = re.findall(r"\w+", (text or "").lower())
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def share_held(item, text):
    """The share of an item's shingles in a text; an item of fewer than five words has shingles of as many."""
    size = min(5, len(re.findall(r"\w+", (item or "").lower())))
    own = shingles(item, size) if size else set()
    return len(own & shingles(text, size)) / len(own) if own else 0


def leak_tables():
    r = random.Random(8)
    words = ["v%d" % i for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randint(6, 60))) for i in range(60)] + [(100, "only three words"), (101, None), (102, ""), (103, text(300)), (104, "V7"), (105, "v1 v2"), (106, "only four words here"), (107, "v1 v2")]
    docs = [(300, "v1 v2 " * 3), (301, "there are only four words here, and more"), (302, "four words here"), (303, "xv7 v77"), (304, "v1\nV2")]
    for i in range(200):
        words_ = text(r.randint(1, 900)).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            own = items[r.randrange(60)][1].split()
            if r.random() < 0.4:
                own[r.randrange(len(own))] = "changed"
            at = r.randrange(len(words_) + 1)
            words_[at:at] = own
        docs.append((i, " ".join(words_)))
    docs += [(500, items[63][1]), (501, "Only, THREE words!"), (502, "here are only three words more"), (503, None), (504, ""), (None, items[0][1]), (505, items[1][1]), (505, items[1][1])]
    return docs, items


@pytest.mark.parametrize("piece", [1 << 18, 40])
def test_leaks_against_brute_force(spark, piece):
    docs, items = leak_tables()
    want = sorted((d or -1, i, round(share_held(x, t), 9)) for d, t in docs for i, x in items if share_held(x, t) >= 0.8)
    assert {100, 104, 105, 106, 107} <= {i for _, i, _ in want} and (502, 100, 1.0) in want
    search = decontamination.Search([(i, t or "") for i, t in items])
    decontamination_piece, decontamination.PIECE_SHINGLES = decontamination.PIECE_SHINGLES, piece
    try:
        direct = sorted((d or -1, i, round(c, 9)) for (d, _), held in zip(docs, search.matches([t or "" for _, t in docs])) for i, c in held)
    finally:
        decontamination.PIECE_SHINGLES = decontamination_piece
    assert direct == want
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(frame(spark, docs), table)
    assert sorted((r.doc_id or -1, r.item_id, round(r.containment, 9)) for r in got.collect()) == want
    left = decontamination.cleaned(frame(spark, docs), table)
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if (d or -1) not in {x[0] for x in want})


def test_items_in_several_blocks_and_none(spark):
    docs, items = leak_tables()
    table = spark.createDataFrame(items + items[:3], "item_id long, text string")
    one = decontamination.leaks(frame(spark, docs), table).count()
    blocks = list(decontamination.item_blocks(table, rows=10))
    assert len(blocks) > 3 and sum(map(len, blocks)) == len(items)
    assert sum(len(h) for b in blocks for h in decontamination.Search(b).matches([t or "" for _, t in docs])) == one
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(frame(spark, docs), none).count() == 0
    assert decontamination.cleaned(frame(spark, docs), none).count() == len(docs)
    assert decontamination.leaks(frame(spark, []), table).count() == 0


def test_a_long_item_takes_no_memory_of_short_documents():
    """An item of 300,000 words and 300 short texts in one batch: less than 300 MB on top of what importing takes."""
    code = (
        "import resource, random\n"
        "from riskscan.llm import decontamination as D\n"
        "r = random.Random(1)\n"
        "item = ' '.join('w%d' % r.randrange(50000) for _ in range(300000))\n"
        "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024\n"
        "before = peak()\n"
        "search = D.Search([(1, item), (2, 'a b c d e f g h')])\n"
        "texts = ['some short text number %d of these' % i for i in range(300)]\n"
        "assert search.matches(texts) == [[]] * 300\n"
        "assert search.matches([item + ' and more', 'x a b c d e f g h'])[1] == [(2, 1.0)]\n"
        "print(peak() - before)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(Path(decontamination.__file__).parents[2]))
    assert done.returncode == 0, done.stderr[-1500:]
    assert int(done.stdout) < 300


def test_blocks_of_items_are_bounded_by_characters(spark):
    table = spark.createDataFrame([(i, f"{i} " + "word " * 200) for i in range(20)], "item_id long, text string")
    blocks = list(decontamination.item_blocks(table, chars=4000))
    assert sum(map(len, blocks)) == 20 and len(blocks) >= 4


def test_pieces_end_between_words():
    text = " ".join("wörd%d" % i for i in range(200))
    assert [w for p in word_pieces(text, 17) for w in p] == re.findall(r"\w+", text)
    assert b"".join(pieces(text.encode(), 17)) == text.encode()
    assert all(p[:1] in (b" ", b"w") for p in pieces(text.encode(), 17))


def test_licences_against_brute_force(spark):
    r = random.Random(4)
    filler = lambda n: " ".join("q%d" % r.randrange(500) for _ in range(n))
    notices = licences.NOTICES
    docs = []
    for i, (_, text) in enumerate(notices):
        docs.append((i, f"{filler(r.randint(0, 300))}. {text.upper()} {filler(r.randint(0, 300))}"))
        words = text.split()
        if len(words) > 40:
            words[20] = "something"
            docs.append((100 + i, filler(50) + " " + "\n * ".join(words)))
    docs += [(200, None), (201, ""), (202, filler(2000)), (203, "license " * 50), (204, "MIT License"), (None, notices[2][1]), (205, notices[2][1]), (205, notices[2][1])]
    want = set()
    for d, t in docs:
        for n, (name, text) in enumerate(notices):
            own = shingles(text)
            if len(own & shingles(t)) >= 0.8 * len(own):
                want.add((d, name, n))
    got = licences.licensed(frame(spark, docs))
    rows = got.collect()
    assert {(x.doc_id, x.licence, x.template) for x in rows} == want
    assert sum(x.doc_id == 205 for x in rows) == 2 * sum(d == 205 for d, _, _ in want)
    assert all(0.8 <= x.containment <= 1 for x in rows)
    assert licences.licensed(frame(spark, [])).count() == 0
    assert licences.licensed(frame(spark, docs), templates=[]).count() == 0


def test_licence_settings():
    given = [(n, a, b) for n, (a, b) in enumerate(licences.NOTICES)]
    assert all(licences.miss_bound(len(licences.shingles_of(t))) < 1e-3 for _, _, t in given)
    must = set(licences.anchors(given))
    for _, _, text in given:
        own = [set(s.split()) for s in licences.shingles_of(text)]
        assert sum(not s & must for s in own) < 0.8 * len(own)


def secret_docs():
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(r.randint(3, 9)))
    vocabulary = [word() for _ in range(150)]
    compounds = ["".join(r.choice(vocabulary) for _ in range(5)) for _ in range(20)]
    docs = []
    for i in range(300):
        words = [r.choice(vocabulary) for _ in range(30)]
        kind = i % 3
        if kind == 0:
            words[7:7] = ["token", "=", '"%040x"' % r.getrandbits(160)]
        elif kind == 1:
            words[9:9] = [r.choice(compounds), "%016d" % r.getrandbits(50)]
        docs.append((i, " ".join(words)))
    return docs


def test_secret_scan(spark):
    docs = secret_docs() + [(900, None), (901, ""), (902, "a" * 50_000), (None, "key=" + "ab12" * 10), (903, 'x="%s";y="%s"' % ("Q1w2" * 6, "z9Y8" * 6))]
    df = frame(spark, docs).withColumn("path", F.lit("src/app.py"))
    found = secret_forest.candidates(df)
    assert found.filter("doc_id = 903").count() == 2
    labels = secret_forest.by_assignment(found.filter("doc_id % 2 = 0"))
    got = secret_forest.scan(df, found, labels).collect()
    assert len(got) == found.count()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 2]
    true = lambda r: r.doc_id % 3 == 0
    assert np.mean([r.kept == true(r) for r in held]) > 0.95
    assert all(len(r.value_sha256) == 64 for r in got)


def test_secret_scan_without_rows_or_labels(spark):
    none = frame(spark, [])
    found = secret_forest.candidates(none)
    assert secret_forest.scan(none, found, secret_forest.by_assignment(found)).count() == 0
    df = frame(spark, [(1, "plain words and a verylongcompoundwordhere")])
    found = secret_forest.candidates(df)
    assert [r.score for r in secret_forest.scan(df, found, secret_forest.by_assignment(found)).collect()] == [0.0]
