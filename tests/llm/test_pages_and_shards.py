"""Extraction, archives, shards and the pipeline."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from riskscan.llm import html_extraction as H
from riskscan.llm import sharding, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="home"><header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav>
<div id="cookie-notice">We use cookies. <button>OK</button></div><!-- <p>hidden</p> -->
<main><article><h1>The  title &amp; more</h1><p>First <b>para</b>graph,<br>with a
break.<p>Second &eacute;&#233; paragraph is here.</p><form><label>Mail</label><input></form>
<div class="ad-slot">Buy this now.</div><p>Ö</p><aside>See also.</aside>
<section id="comments"><article class="comment"><p>A reader's long comment with many words in it, truly.</p></article></section>
</article></main><div class="sidebar widget"><p>Popular posts are listed in this place.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_article_without_the_rest():
    text, found, kept, _ = H.main_text(PAGE)
    assert text == "The title & more\n\nFirst paragraph, with a break.\n\nSecond éé paragraph is here.\n\nÖ"
    assert kept == 4 < found


@pytest.mark.parametrize("html", ["", "plain words without any markup at all, a whole sentence.", "<", "<p", "a < b", "<p title='x>y'>t", "<!-- open", "<script>never closed", "</p></div>", "<p>" * 3000 + "x", "&#0;&bogus;"])
def test_odd_pages(html):
    H.main_text(html)


def test_prose_without_named_parts():
    prose = "This is a sentence of reasonable length that says something about the matter. " * 3
    page = f"<body><div><a href=/>Home</a> <a href=/x>About</a></div><div><div><p>{prose}</p><p>Short one.</p><p>{prose}</p></div></div><div><a href=/t>Terms</a></div></body>"
    assert H.main_text(page)[0] == f"{prose.strip()}\n\nShort one.\n\n{prose.strip()}"


def test_labels_are_a_minimum_cut(monkeypatch):
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 9)
        home = H.Element("p", 0.0, False, False, False, 1, 1, None)
        blocks = [H.Block(home, "x", 0, r.uniform(-1, 1)) for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if r.random() < 0.5:
                blocks[i].edges[j] = blocks[j].edges[i] = r.uniform(0, 0.8)
        monkeypatch.setattr(H, "_weigh", lambda found, weights: None)

        def cost(label, blocks=blocks):
            one = sum(max(-b.odds, 0) if x else max(b.odds, 0) for b, x in zip(blocks, label))
            return one + sum(w for i, b in enumerate(blocks) for j, w in b.edges.items() if i < j and label[i] != label[j])

        assert cost(H.labels(blocks)) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_extraction_of_tables(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {i} of a long page.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "", "", "x"), (3, "v", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extracted(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[2].text == "" and by[3].n_kept == 3000 and by[1].text.startswith("The title")
    assert H.extracted(df.limit(0)).count() == 0


def pages(spark):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://a/ 3", "same"), (2, None, None), (4, "http://a/4", ""), (7, "u", "ä" * 50_000), (None, "n", "once"), (8, "v", "r\r\n\r\nWARC/1.1\r\n"), (9, "w", "twice"), (9, "w", "twice"), (2**60 + 1, "z", "big"), (2**60 + 3, "z", "big")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, archive string, offset int")


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    index, folder = warc.archived(df)
    back = warc.read(index, folder).collect()
    assert len(back) == len(rows)
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    texts = defaultdict(list)
    for i, _, html in rows:
        texts[i].append(html or "")
    for r in back:
        text = texts[r.page_id][0]
        assert r.payload_bytes == len(text.encode())
        assert r.read_digest == r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert r.read_type == r.record_type
        if r.record_type == "response":
            assert bytes(r.payload).decode() == text and r.refers_to is None
        else:
            assert r.refers_to == best[text]
    kinds = Counter((r.page_id, r.record_type) for r in back)
    assert kinds[1, "revisit"] == kinds[3, "revisit"] == kinds[5, "response"] == kinds[2, "revisit"] == kinds[4, "response"] == 1
    assert kinds[9, "response"] == kinds[9, "revisit"] == 1 and kinds[2**60 + 1, "revisit"] == kinds[2**60 + 3, "response"] == 1
    assert all(r.refers_to == 2**60 + 3 for r in back if r.page_id == 2**60 + 1)


def test_selected_records_and_short_payloads(spark):
    _, df = pages(spark)
    index, folder = warc.archived(df, least=5)
    rows = index.collect()
    assert {r.record_type for r in rows if r.page_id in (1, 3, 5, 2, 4)} == {"response"}
    assert Counter(r.record_type for r in rows if r.page_id == 9) == {"response": 1, "revisit": 1}
    some = warc.read(index.filter("page_id in (3, 7)"), folder, parts=1).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in some) == [(3, 4), (7, 100_000)]
    system, path = fs.FileSystem.from_uri(folder)
    for name in {r.archive for r in rows}:
        with system.open_input_file(f"{path}/{name}") as f:
            data = f.read()
        spans = sorted((r.offset, r.length) for r in rows if r.archive == name)
        assert all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(data)
        head = zlib.decompressobj(31).decompress(data)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_archives_are_bounded_and_may_be_empty(spark):
    _, df = pages(spark)
    source = df.select(F.col("page_id").alias("_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_payload"), F.monotonically_increasing_id().alias("_row"))
    index = warc.written(warc.revisits(source), warc.fresh_folder(spark, "warc"), archive=300)
    assert index.select("archive").distinct().count() > 3
    none, folder = warc.archived(df.limit(0))
    assert none.count() == 0 and warc.read(none, folder).count() == 0


@pytest.mark.parametrize("small_parts", [False, True])
def test_no_payload_is_lost_on_pages_from_a_shuffle(spark, small_parts):
    """Copies of many pages, through a repartition, a join and a union, with large and with small shuffle parts."""
    texts = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("text "), F.col("id") % 130).alias("html"))
    base = texts.unionByName(texts.filter("page_id % 50 = 0"))
    named = spark.range(400).select(F.col("id").alias("page_id"), (F.col("id") + 1).alias("extra"))
    made = {
        "repartition": base.repartition(7), "by id": base.repartition(13, "page_id"), "join": base.join(named.repartition(9), "page_id").select("page_id", "url", "html"),
        "union": base.filter("page_id < 200").repartition(5).unionByName(base.filter("page_id >= 200").repartition(3)), "distinct": base.groupBy("page_id", "url", "html").agg(F.count("*").alias("n")).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n"),
    }
    rows = [(r.page_id, r.html) for r in base.collect()]
    want = Counter()
    for html in {h for _, h in rows}:
        own = sorted(i for i, h in rows if h == html)
        want.update((i, "revisit", own[-1]) for i in own[:-1])
        want[own[-1], "response", None] += 1
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "60kb" if small_parts else "64mb")
    try:
        for name, df in made.items():
            index, folder = warc.archived(df)
            back = warc.read(index, folder).collect()
            assert Counter((r.page_id, r.read_type, r.refers_to) for r in back) == want, name
            assert {r.payload.decode() for r in back if r.read_type == "response"} == {h for _, h in rows}, name
    finally:
        spark.conf.unset(key)


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (40, 5), (200, 5)], gap=30, most=100) == [(0, 45, 3), (200, 205, 1)]
    assert warc.ranges([(0, 60), (60, 60)], gap=30, most=100) == [(0, 60, 1), (60, 120, 1)]
    assert warc.ranges([]) == []


def check_shards(rows, got, shards=8):
    sizes = sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sorted(r["size"] for r in got) == sizes
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    return [load[s] for s in range(shards)]


def test_shards_are_even_and_keep_groups(spark):
    r = random.Random(1)
    rows = [(i, "t%d " % i * r.randint(1, 60)) for i in range(3000)]
    for k in range(60):
        rows += [(10_000 + 50 * k + j, "copy %d " % k * 20) for j in range(r.randint(2, 12))]
    df = spark.createDataFrame([(*x, 5, "s") for x in rows], "doc_id long, text string, shard int, _row string")
    got = sharding.sharded(df).collect()
    load = check_shards(rows, got)
    assert max(load) - min(load) <= 2 * max(r["size"] for r in got)
    text = dict(rows)
    homes = defaultdict(set)
    for x in got:
        assert x.text_crc32 == zlib.crc32((text[x.doc_id] or "").encode())
        if x.doc_id >= 10_000:
            homes[text[x.doc_id]].add(x.shard)
    assert sum(len(x) > 1 for x in homes.values()) == 0


def test_a_group_larger_than_a_shard_is_cut_as_little_as_needed(spark):
    rows = [(i, "single %d" % i) for i in range(2000)] + [(5000 + i, "the copied text") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(df).collect()
    load = check_shards(rows, got)
    assert max(load) - min(load) <= 40
    assert len({r.shard for r in got if r.doc_id >= 5000}) <= 4


def test_shards_of_odd_tables(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "x" * 10_000), (3, "x" * 10_000), (4, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_shards(rows, sharding.sharded(df).collect())
    assert sharding.sharded(df.limit(0)).count() == 0
    same = [(i, "same") for i in range(100)]
    load = check_shards(same, sharding.sharded(spark.createDataFrame(same, "doc_id long, text string")).collect())
    assert max(load) - min(load) <= 0.25 * sum(load)


def test_quotas():
    got = sharding.quotas({(0, 1): 10.0, (1, 0): 4.0, (2, 1): 6.0}, {0: 0.0, 1: 6.0})
    assert got[1, 0] == 4 and got[0, 1] == 4 + 3 and got[2, 1] == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    text = lambda n=120: " ".join(r.choice(words) for _ in range(n))
    item = text(30)
    docs = [(i, text()) for i in range(200)]
    clean = docs[0][1]
    toxic = [(1000 + i, text(40) + " vilest scoundrel " + text(40)) for i in range(80)]
    extra = [(2000, clean + " "), (2001, clean.replace(" ", "  ")), (2002, text(50) + " " + item + " " + text(50)), (2003, None), (2004, ""), (2003, None), (None, "a text without id " + text(20))]
    rows = docs + toxic + extra
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in docs] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    got = P.run(spark, str(tmp_path)).collect()
    ids = sorted(x.doc_id for x in got if x.doc_id is not None)
    assert ids == sorted([i for i, _ in docs] + [2003])
    assert sum(x.doc_id is None for x in got) == 1
    assert {x.doc_id: x.n_tokens for x in got}[2003] == 0
