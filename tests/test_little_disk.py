"""What large runs write and move stays small: packed merge rows, and logs that are compressed as they are written."""

import gzip
import itertools
import json
from datetime import date

import pytest
from builders import candidate, candidates, surfaces
from pyspark.sql import functions as F

from riskscan.functions import text as T
from riskscan.operators import findings as V
from riskscan.operators import glob_index as GI
from riskscan.operators import review as RV
from riskscan.operators.skew import written
from riskscan.rules import rule_index as RI
from riskscan.rules import user_rules as U
from riskscan.sinks import logs as L
from riskscan.sinks import reports as K

ODD = [None, "", "a", "a b", "ab", "\x00", "\x01", "\x02", "\x01\x02", "\x00\x00a", "\x01\x01\x02", "\x00\x01", "\x01\x00b", "é", "😀"]


def test_packed_texts_come_back_and_sort_as_they_did(spark):
    rows = spark.createDataFrame(list(itertools.product(ODD, ODD)), "a string, b string").withColumn("p", T.packed("a", "b"))
    back = rows.select("a", "b", T.unpacked("p", 1).alias("x"), T.unpacked("p", 2).alias("y")).collect()
    assert all((r.a, r.b) == (r.x, r.y) for r in back)
    got = [(r.a, r.b) for r in rows.coalesce(1).sortWithinPartitions("p").collect()]
    assert got == [(r.a, r.b) for r in rows.coalesce(1).sortWithinPartitions("a", "b").collect()]
    assert rows.select("p").distinct().count() == len(ODD) ** 2


def exchanges(df):
    """(partitioning, names of the columns) of every shuffle in a plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName() == "Exchange":
            found.append((node.outputPartitioning().toString(), [node.output().apply(i).name() for i in range(node.output().size())]))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_merge_moves_few_columns(spark):
    widths = [len(names) for _, names in exchanges(V.merge(candidates(spark, candidate("A-001"))))]
    # Before: 15 and 16 columns.
    assert len(widths) == 3 and max(widths) <= 9


def test_merge_of_odd_texts(spark):
    rows = [
        candidate("A-001", target_name=t, description=d, title=h, location=p, context_text="it does not ", seq=i, severity=s, confirmed=c)
        for i, (t, d, h, p, s, c) in enumerate([
            (None, "x\x00y", "T\x01", "l\x00", "high", None), (None, "x\x00y", "T2", "l\x01", "none", True), ("", "x", "\x00", "l", "info", False), ("", "x", "u", "l", "low", None),
        ])
    ]
    got = {r.target_name: r for r in V.merge(candidates(spark, *rows)).collect()}
    one, two = got[None], got[""]
    assert (one.description, one.title, one.location, one.sev_rank, one.confirmed, one.evidence_count) == ("x\x00y", "T\x01", "l\x00", 3, True, 2)
    assert [e.location for e in one.evidence] == ["l\x00", "l\x01"]
    assert (two.description, two.title, two.location, two.sev_rank, two.confirmed, two.evidence_count) == ("x", "\x00", "l", 1, False, 1)


def test_logs_compressed_as_they_are_written(spark, tmp_path):
    L.register(spark)
    found = V.validate(candidates(spark, *[candidate(f"R-00{i % 3}", target_name=f"t{i}", location=f"l{i}") for i in range(50)]))
    rows, ids = L.sarif_rows(found).repartition(2, "rule_id"), sorted(x.id for x in found.collect())
    for kind, path in (("none", tmp_path / "plain"), ("gzip", tmp_path / "small")):
        rows.write.format("riskscan-sarif").option("resultsEach", 20).option("compression", kind).mode("append").save(str(path))
    plain, small = sorted((tmp_path / "plain").glob("*.sarif")), sorted((tmp_path / "small").glob("*.sarif.gz"))
    logs = [json.loads(gzip.decompress(p.read_bytes())) for p in small]
    assert sorted(x["partialFingerprints"]["findingId"] for log in logs for x in log["runs"][0]["results"]) == ids
    assert all(len(log["runs"][0]["results"]) <= 20 for log in logs)
    assert sum(p.stat().st_size for p in small) * 4 < sum(p.stat().st_size for p in plain)
    schema = "runs array<struct<results:array<struct<ruleId:string>>>>"
    assert spark.read.schema(schema).json(f"{tmp_path}/small/*.sarif.gz", multiLine=True).select(F.explode(F.flatten("runs.results"))).count() == 50
    with pytest.raises(Exception, match="compression"):
        L.json_lines(found.select("id")).write.format("riskscan-lines").option("compression", "gzip").mode("append").save(str(tmp_path / "lines"))


def test_notes_of_suppressions_move_with_their_set(spark, monkeypatch):
    monkeypatch.setattr(GI, "is_small", lambda *a: False, raising=False)
    monkeypatch.setattr(GI, "broadcast_if_small", lambda df: df)
    found = V.to_findings(candidates(spark, *[candidate(target_name=n, location=f"l{n}") for n in ("tool-1", "tool-2", "other", None)]))
    rows = [(i, "TEST", None, "tool-*", f"r{i}", date(2020, 1, 1) if i < 5 else None) for i in range(7)]
    table = spark.createDataFrame(rows, "order long, rule string, server string, target string, reason string, expires date")
    out = GI.suppress(found, table, date(2026, 1, 1))
    got = {r.target_name: (r.status, len(r.notes)) for r in out.collect()}
    assert got == {"tool-1": ("suppressed", 6), "tool-2": ("suppressed", 6), "other": ("unverified", 0), None: ("unverified", 0)}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanges(GI.suppress(found, table, date(2026, 1, 1)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    with_notes = [place for place, names in moved if "_notes" in names]
    assert with_notes and all("_set" in place and "target_name" not in place for place in with_notes)


def test_rules_beyond_a_broadcast_move_no_texts(spark, monkeypatch):
    rules = RI.table_of(spark, [U.UserRule(id=f"R-{i}", title="t", severity="low", category="quality", patterns=(p,)) for i, p in enumerate([r"\bgreen apple\b", "red pear", r"\bplum\b", "x.z"])])
    texts = surfaces(spark, "a green apple and a red pear", "plum plum", "Red Pear", "nothing", "xyz")
    found = lambda: sorted((r.rule_id, r.target_name) for r in RI.candidates(texts, rules).collect())
    want = [("R-0", "t0"), ("R-1", "t0"), ("R-1", "t2"), ("R-2", "t1"), ("R-3", "t4")]
    assert found() == want
    monkeypatch.setattr(RI, "BLOCK_BYTES", 300, raising=False)
    monkeypatch.setattr(RI, "broadcast_if_small", lambda df: df)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not any({"norm", "text"} & set(names) for _, names in exchanges(RI.candidates(texts, rules)))
        assert found() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def without_broadcasts(spark, make):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return exchanges(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_logs_move_results_once_and_never_whole(spark, monkeypatch):
    monkeypatch.setattr(K, "RESULTS_PER_RUN", 4)
    rows = [candidate(f"R-{i % 3}", server_id="large", target_name=f"t{i}", location=f"l{i}") for i in range(11)]
    rows += [candidate("R-0", server_id="small", target_name=f"t{i}", location=f"m{i}") for i in range(4)]
    found = written(V.validate(candidates(spark, *rows)))
    logs = {(r.server_id, r.chunk): json.loads(r.value)["runs"][0] for r in K.sarif_documents(found, "x").collect()}
    assert {k: len(v["results"]) for k, v in logs.items()} == {("large", 0): 4, ("large", 1): 4, ("large", 2): 3, ("small", 0): 4}
    assert all({x["id"] for x in v["tool"]["driver"]["rules"]} == {x["ruleId"] for x in v["results"]} for v in logs.values())
    moved = without_broadcasts(spark, lambda: K.sarif_documents(found, "x"))
    # Once where logs are put together, once more where the results of large servers are numbered.
    assert sum("value" in names for _, names in moved) == 2 and not any("results" in names for _, names in moved)


def test_entries_of_small_servers_move_once(spark, monkeypatch):
    rows = [candidate("R-0", severity=("low", "critical", "high")[i % 3], server_id=s, target_name=f"t{i}", location=f"l{i}") for s in ("a", "b") for i in range(12)]
    found = written(V.validate(candidates(spark, *rows[:20])))
    tools = spark.createDataFrame([("a", "t", 0, "d" * 900)], "server_id string, name string, seq long, description string").withColumn("input_schema", F.parse_json(F.lit("{}")))
    ids = {s: {r.id for r in found.where(F.col("server_id") == s).collect()} for s in ("a", "b")}
    got = {}
    for most in (10_000, 9):
        monkeypatch.setattr(RV, "STRETCH", most, raising=False)
        parts = RV.payloads(tools, found, "tok", 1500).orderBy("server_id", "part").collect()
        got[most] = [(r.server_id, r.part, r.payload) for r in parts]
        listed = [(s, e) for s, _, p in got[most] for e in json.loads(p.split("\n", 1)[1].rsplit("\n", 1)[0])["entries"]]
        assert {s: {e["id"] for t, e in listed if t == s and e["kind"] == "finding"} for s in ids} == ids
        # Worst first over all parts, also where a server is cut into stretches.
        worst = [("critical", "high", "low").index(e["severity"]) for s, e in listed if s == "a" and e["kind"] == "finding"]
        assert worst == sorted(worst)
    assert got[9] == got[10_000]
    moved = [place for place, names in without_broadcasts(spark, lambda: RV.payloads(tools, found, "tok", 1500)) if "entry" in names]
    assert sum("server_id" in p and p.count("#") == 1 for p in moved) == 1
