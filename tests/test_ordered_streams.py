"""Streams in the order of events, with late rows, stored snapshots, acceptances and joins, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from riskscan.operators import drift as D
from riskscan.operators import runtime as R
from riskscan.streaming import ordered as O
from riskscan.streaming import streams as S


def at(df):
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("at")))


def arrive(spark, df, folder, run, slices="part"):
    """Each slice is added to the folder, then the stream runs over what is new and stops."""
    rows = df.drop(slices)
    for k in sorted(r[0] for r in df.select(slices).distinct().collect()):
        df.where(F.col(slices) == k).drop(slices).write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder))


def calls(spark, n, seed, out_of_order=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = i * 20
        rows.append((f"s{r.choice([0, 0, 0, 1, 2])}", t, i, r.random() < 0.6, (i + r.randint(0, out_of_order)) * 3 // (n + out_of_order)))
    return at(spark.createDataFrame(rows, "server_id string, at int, seq long, timed_out boolean, part int"))


def test_timeouts_and_budget_equal_batch(spark, tmp_path):
    df = calls(spark, 600, 1, out_of_order=40)
    schema = df.drop("part").schema
    for name, step, batch in (
        ("timeouts", O.timeout_step(2), R.timeout_runs(df, "server_id", "ts", ["ts", "seq"], F.col("timed_out")).where("in_a_row = 2").select("seq")),
        ("budget", O.budget_step(3, "1 minute"), R.session_places(df, "server_id", "ts", ["ts", "seq"], "1 minute").select("seq", "place")),
    ):
        path = str(tmp_path / name)
        arrive(spark, df, f"{path}-in", lambda s: O.run_in_order(s, step, path, f"{path}-ckpt", late="1 hour"))
        got = O.results(spark, path, step, schema).select(batch.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())), name
        assert O.results(spark, path).count() < got.count()
        sums = O.marks(spark, path).agg(F.sum("on_time"), F.sum("late"), F.sum("lost")).first()
        assert tuple(sums) == (600, 0, 0)


def test_places_in_sessions_equal_a_plain_loop(spark):
    df = calls(spark, 300, 4)
    got = {r["seq"]: r["place"] for r in R.session_places(df, "server_id", "ts", ["ts", "seq"], "1 minute", bucket="hour").collect()}
    want, last = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["seq"]):
        before, place = last.get(r["server_id"], (None, 0))
        place = 1 if before is None or r["at"] - before > 60 else place + 1
        last[r["server_id"]], want[r["seq"]] = (r["at"], place), place
    assert got == want


def test_late_rows_become_corrections(spark, tmp_path):
    """On time, late and lost rows together are all rows; windows with corrections lack the lost ones only."""
    r = random.Random(3)
    rows = [(i * 60, f"u{i % 2}", float(i), i * 3 // 300) for i in range(300)]
    # Rows that come after the watermark: some behind the second one, too, and one without a time.
    rows += [(r.randint(9000, 11_000), "u0", 1000.0, 2) for _ in range(7)] + [(r.randint(0, 2000), "u1", 1000.0, 2) for _ in range(5)] + [(None, "u0", 1.0, 1)]
    df = at(spark.createDataFrame(rows, "at int, user string, value double, part int"))
    path, step = str(tmp_path / "late"), O.window_step("user", "1 hour")
    arrive(spark, df, f"{path}-in", lambda s: O.run_in_order(s, step, path, f"{path}-ckpt", late="10 minutes", lost="1 hour"))
    sums = O.marks(spark, path).agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"), F.sum("lost").alias("lost")).first()
    assert (sums["on_time"], sums["late"], sums["lost"]) == (300, 7, 6) and sum(sums) == df.count()
    schema = df.drop("part").schema
    late = O.corrections(spark, path, schema)
    assert late.count() == 7
    got = O.windows(O.results(spark, path, step, schema), late, "user", "1 hour")
    kept = df.where("ts is not null and not (value = 1000 and at < 5000)")
    key = lambda d: sorted((r["w"]["start"], r["user"], r["events"], r["total"]) for r in d.collect())
    assert key(got) == key(O.window_parts(kept, "user", "1 hour"))
    assert got.agg(F.sum("corrected")).first()[0] == 7


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    df = calls(spark, 200, 5).drop("part")
    path, step = str(tmp_path / "again"), O.timeout_step(2)
    run = O.micro_batch(step, path, "1 minute", "1 hour")
    first, second = df.where("seq < 100"), df.where("seq >= 100")
    run(first, 0)
    run(second, 1)
    once = sorted(map(tuple, O.results(spark, path, step, df.schema).collect()))
    run(second, 1)
    assert sorted(map(tuple, O.results(spark, path, step, df.schema).collect())) == once
    assert O.marks(spark, path).count() == 2
    # A batch that stopped before its marks were written is not read.
    df.limit(5).select("server_id", "ts", "seq").write.parquet(f"{path}/rows/of_batch=2")
    assert sorted(map(tuple, O.results(spark, path, step, df.schema).collect())) == once


def test_one_busy_server_equals_batch(spark, tmp_path):
    """Half a million calls of one server in two micro-batches: nothing is gathered in one worker."""
    df = spark.range(500_000).select(F.lit("hot").alias("server_id"), F.timestamp_millis(F.col("id") * 300).alias("ts"), F.col("id").alias("seq"), (F.xxhash64("id") % 3 != 0).alias("timed_out"), (F.col("id") >= 250_000).cast("int").alias("part"))
    path, step = str(tmp_path / "hot"), O.timeout_step(3)
    arrive(spark, df, f"{path}-in", lambda s: O.run_in_order(s, step, path, f"{path}-ckpt", late="1 minute"))
    got = O.results(spark, path, step, df.drop("part").schema).select("seq")
    want = R.timeout_runs(df, "server_id", "ts", ["ts", "seq"], F.col("timed_out")).where("in_a_row = 3").select("seq")
    assert got.count() > 10_000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.fixture(scope="module")
def history(spark):
    """Observations and acceptances of nine tools over six arrivals."""
    r = random.Random(8)
    rows = []
    for part in range(6):
        for tool in range(9):
            for _ in range(r.randint(0, 4)):
                rows.append((part * 1000 + r.randint(0, 900), "s", f"t{tool}", f"h{r.randint(0, 3)}", False, part))
            if r.random() < 0.4:
                rows.append((part * 1000 + r.randint(0, 900), "s", f"t{tool}", r.choice([None, "h0", "h1", "h2"]), True, part))
    return at(spark.createDataFrame(rows, "at int, server_id string, tool string, hash string, accepted boolean, part int"))


@pytest.mark.parametrize("pinned", [False, True])
def test_drift_with_pins_and_acceptances_equals_batch(spark, tmp_path, history, pinned):
    pins = spark.createDataFrame([("s", f"t{i}", "h1") for i in range(0, 9, 2)] + [("other", "x", "h9")], "server_id string, tool string, hash string") if pinned else None
    path = str(tmp_path / "drift")

    def run(stream):
        got = S.drift(stream.where("not accepted"), pins=pins, acceptances=stream.where("accepted"))
        S.run_to_table(got, f"{path}-out", f"{path}-ckpt")

    arrive(spark, history, f"{path}-in", run)
    rows = history.withColumn("arrival", F.col("part"))
    batch = D.replayed_changes(rows.where("not accepted"), rows.where("accepted"), pins)
    key = lambda d: sorted((r.tool, r.ts, r.before_hash, r.after_hash) for r in d.collect())
    got = key(spark.read.parquet(f"{path}-out"))
    assert got == key(batch) and len(got) > 15


def test_a_changed_tool_is_reported_once_until_it_is_accepted(spark, tmp_path):
    rows = [(0, "h2", False, 0), (10, "h2", False, 1), (20, "h2", True, 2), (30, "h2", False, 3), (40, "h1", False, 4), (50, "h1", False, 5)]
    df = at(spark.createDataFrame(rows, "at int, hash string, accepted boolean, part int")).withColumns({"server_id": F.lit("s"), "tool": F.lit("t")})
    pins = spark.createDataFrame([("s", "t", "h1")], "server_id string, tool string, hash string")
    path = str(tmp_path / "once")
    arrive(spark, df, f"{path}-in", lambda s: S.run_to_table(S.drift(s.where("not accepted"), pins=pins, acceptances=s.where("accepted")), f"{path}-out", f"{path}-ckpt"))
    got = spark.read.parquet(f"{path}-out").orderBy("ts").collect()
    assert [(r.before_hash, r.after_hash) for r in got] == [("h1", "h2"), ("h2", "h1")]


def test_connections_name_their_program(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for i in range(400):
        t = i * 7
        rows.append((t, f"s{r.randint(0, 1)}", r.randint(1, 3), "process", f"p{r.randint(0, 4)}", None, i * 4 // 400))
        rows.append((t + r.randint(0, 5), f"s{r.randint(0, 1)}", r.randint(1, 3), "connection", None, f"8.8.8.{i % 200}:{i}", i * 4 // 400))
    df = at(spark.createDataFrame(rows, "at int, server_id string, pid int, kind string, name string, remote_address string, part int")).withColumn("phase", F.lit("probing"))
    df = df.dropDuplicates(["server_id", "pid", "ts", "kind"])
    path = str(tmp_path / "programs")
    arrive(spark, df, f"{path}-in", lambda s: S.run_to_table(S.outside_programs(s, within="1 minute", late="30 seconds"), f"{path}-out", f"{path}-ckpt"))
    got = {(r.server_id, r.pid, r.ts): (r.program, r.started) for r in spark.read.parquet(f"{path}-out").collect()}
    batch = R.connection_programs(df.where("kind = 'process'"), df.where("kind = 'connection'"), "1 minute")
    want = {(r.server_id, r.pid, r.ts): (r.program, r.started) for r in batch.collect()}
    end = max(k[2] for k in want)
    # What the watermark has not passed yet is still open.
    closed = {k: v for k, v in want.items() if (end - k[2]).total_seconds() > 200}
    assert len(closed) > 200 and any(p is None for p, _ in closed.values()) and sum(p is not None for p, _ in closed.values()) > 100
    assert {k: got.get(k) for k in closed} == closed and all(want[k] == v for k, v in got.items())
    plain = {}
    seen = [x for x in df.collect() if x.kind == "process"]
    for k in want:
        near = [(x.ts, x.name) for x in seen if (x.server_id, x.pid) == k[:2] and 0 <= (k[2] - x.ts).total_seconds() <= 60]
        plain[k] = (max(near)[1], max(near)[0]) if near else (None, None)
    assert plain == want
