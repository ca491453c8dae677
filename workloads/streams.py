"""Streams that really run: events arrive in two lots, the stream goes on from its checkpoint, and its table is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskscan.operators.skew import run_folder
from riskscan.streaming import ordered as O
from riskscan.streaming import streams as S
from workloads import query
from workloads.runtime import SERVER_SQL, events, server

# Every fifth event comes a day late, so the second lot begins before the first one ends.
LOT_SQL = "case when day(ts) + case when event_id % 5 = 0 then 1 else 0 end <= 15 then 0 else 1 end"


def lot():
    late = F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    return F.when(F.dayofmonth("ts") + late <= 15, 0).otherwise(1).alias("lot")


def arriving(spark, rows, run) -> str:
    """The rows of lot 0, then those of lot 1, each as files of a folder that `run(stream, folder)` has to work on."""
    folder = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    for part in (0, 1):
        rows.where(F.col("lot") == part).drop("lot").write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(rows.drop("lot").schema).parquet(f"{folder}/in"), folder)
    return folder


@query(
    "stream_drift",
    f"""
    with e as (select {SERVER_SQL} as server_id, event_type as tool, ts, cast(json_extract(props, '$.k') as integer) as k, {LOT_SQL} as lot from events),
    h as (select *, 'h' || cast(k // 25 as varchar) as hash, k % 10 = 0 as acc from e),
    a as (select server_id, tool, lot, arg_max(case when k % 20 = 0 then '' else hash end, (ts, hash)) as given from h where acc group by all),
    o as (select server_id, tool, lot, hash, min(ts) as ts from h where not acc group by all),
    u as (select server_id, tool, lot, 0 as kind, null::timestamp as ts, null as hash, given from a
          union all select server_id, tool, lot, 1, ts, hash, null from o),
    w as (select *, sum(case when kind = 0 then 1 else 0 end) over (partition by server_id, tool order by lot, kind range unbounded preceding) as epoch from u),
    b as (select server_id, tool, epoch, nullif(max(given), '') as given, arg_min(hash, (lot, ts, hash)) filter (kind = 1) as first from w group by all),
    p as (select distinct {SERVER_SQL} as server_id, 'view' as tool, 'h1' as pinned from events where user_id % 3 = 0),
    c as (select b.server_id, b.tool, b.epoch, coalesce(given, case when epoch = 0 then pinned end, first) as before_hash from b left join p using (server_id, tool)),
    f as (select server_id, tool, epoch, hash, arg_min(ts, (lot, ts)) as ts from w where kind = 1 group by all)
    select server_id, tool, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, before_hash, hash as after_hash from f join c using (server_id, tool, epoch) where hash <> before_hash
    """,
)
def stream_drift(spark, sf_dir):
    """STR-01, SNK-06: a drift stream that starts from stored pins and hears of acceptances."""
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    rows = events(spark, sf_dir).select(
        "ts", server().alias("server_id"), F.col("event_type").alias("tool"), F.concat(F.lit("h"), F.floor(k / 25).cast("string")).alias("hash"),
        k.alias("k"), lot(),
    )
    pins = events(spark, sf_dir).where("user_id % 3 = 0").select(server().alias("server_id"), F.lit("view").alias("tool"), F.lit("h1").alias("hash")).distinct()

    def run(stream, folder):
        given = stream.where("k % 10 = 0").withColumn("hash", F.when(F.col("k") % 20 != 0, F.col("hash")))
        S.run_to_table(S.drift(stream.where("k % 10 <> 0"), pins=pins, acceptances=given), f"{folder}/out", f"{folder}/checkpoint")

    found = spark.read.schema(S.DRIFT_SCHEMA).parquet(f"{arriving(spark, rows, run)}/out")
    return found.select("server_id", "tool", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "before_hash", "after_hash")


@query(
    "stream_timeouts",
    f"""
    with e as (select {SERVER_SQL} as server_id, event_id, ts, event_type in ('error', 'click') as hit from events),
    g as (select *, sum(case when hit then 0 else 1 end) over (partition by server_id order by ts, event_id rows unbounded preceding) as island from e),
    n as (select *, sum(hit::int) over (partition by server_id, island order by ts, event_id rows unbounded preceding) as in_a_row from g where hit)
    select server_id, event_id from n where in_a_row = 2
    """,
)
def stream_timeouts(spark, sf_dir):
    """STR-07, WIN-04: runs of time-outs in a stream whose events come out of order."""
    rows = events(spark, sf_dir).select(
        server().alias("server_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click").alias("timed_out"), lot()
    )
    step = O.timeout_step(2, "day")
    folder = arriving(spark, rows, lambda s, f: O.run_in_order(s, step, f"{f}/out", f"{f}/checkpoint", late="2 days", lost="30 days"))
    return O.results(spark, f"{folder}/out", step, rows.drop("lot").schema).select("server_id", F.col("seq").alias("event_id"))


@query(
    "stream_budget",
    f"""
    with e as (select {SERVER_SQL} as server_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by server_id order by ts, event_id rows unbounded preceding) as nr from e)
    select server_id, event_id, cast(row_number() over (partition by server_id, nr order by ts, event_id) as integer) as place,
           row_number() over (partition by server_id, nr order by ts, event_id) > 3 as over from s
    """,
)
def stream_budget(spark, sf_dir):
    """STR-09: the place of each event in its session, in a stream whose events come out of order."""
    rows = events(spark, sf_dir).select(server().alias("server_id"), "ts", F.col("event_id").alias("seq"), lot())
    step = O.budget_step(3, "6 hours", "day")
    folder = arriving(spark, rows, lambda s, f: O.run_in_order(s, step, f"{f}/out", f"{f}/checkpoint", late="2 days", lost="30 days"))
    return O.results(spark, f"{folder}/out", step, rows.drop("lot").schema).select("server_id", F.col("seq").alias("event_id"), "place", "over")


@query(
    "stream_corrections",
    """
    with e as (select *, case when event_id % 50 = 7 or day(ts) > 15 then 1 else 0 end as lot, cast(round(value * 100) as bigint) as cents from events),
    m as (select max(ts) - interval 2 days as mark from e where lot = 0),
    k as (select e.*, lot = 1 and ts < mark as late, lot = 1 and ts < mark - interval 10 days as lost from e, m)
    select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as start, event_type, count(*) as events, count(*) filter (late) as corrected, cast(sum(cents) as bigint) as cents
    from k where not lost group by all
    """,
)
def stream_corrections(spark, sf_dir):
    """STR-06, STR-04: windows with the rows that came late; what came later still is left out and counted."""
    ev = events(spark, sf_dir)
    rows = ev.select("ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("value"), F.when((F.col("event_id") % 50 == 7) | (F.dayofmonth("ts") > 15), 1).otherwise(0).alias("lot"))
    step, schema = O.window_step("event_type", "1 day"), rows.drop("lot").schema
    folder = arriving(spark, rows, lambda s, f: O.run_in_order(s, step, f"{f}/out", f"{f}/checkpoint", late="2 days", lost="10 days"))
    path = f"{folder}/out"
    found = O.windows(O.results(spark, path, step, schema), O.corrections(spark, path, schema), "event_type", "1 day")
    return found.select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "event_type", "events", "corrected", F.col("total").alias("cents"))


PROGRAMS_SQL = f"""
    with p as (select {SERVER_SQL} as server_id, event_id % 2 as pid, ts, 'p' || cast(event_id % 7 as varchar) as name from events where event_type = 'view'),
    c as (select {SERVER_SQL} as server_id, event_id % 2 as pid, ts, event_id from events where event_type = 'click')
    select c.server_id, c.event_id, (select arg_max(p.name, (p.ts, p.name)) from p where p.server_id = c.server_id and p.pid = c.pid and p.ts <= c.ts and p.ts >= c.ts - interval 12 hours) as program
    from c
"""


def _sides(spark, sf_dir):
    """Views as processes and clicks as connections of one of two process ids."""
    ev = events(spark, sf_dir)
    key = (server().alias("server_id"), (F.col("event_id") % 2).cast("int").alias("pid"), "ts")
    processes = ev.where("event_type = 'view'").select(*key, F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("name"), lot())
    connections = ev.where("event_type = 'click'").select(*key, F.col("event_id").cast("string").alias("remote_address"), F.lit("probing").alias("phase"), lot())
    return processes, connections


@query("connection_programs", PROGRAMS_SQL)
def connection_programs(spark, sf_dir):
    """STR-08 in batch: the program behind each connection."""
    from riskscan.operators import runtime as R

    processes, connections = _sides(spark, sf_dir)
    found = R.connection_programs(processes, connections, "12 hours")
    return found.select("server_id", F.col("remote_address").cast("bigint").alias("event_id"), "program")


@query("stream_programs", PROGRAMS_SQL + " where c.ts < timestamp '2024-01-24'")
def stream_programs(spark, sf_dir):
    """STR-08: an interval join of two streams; rows the watermark has passed."""
    processes, connections = _sides(spark, sf_dir)
    rows = processes.unionByName(connections, allowMissingColumns=True)

    def run(stream, folder):
        both = stream.where("name is not null"), stream.where("name is null")
        S.run_to_table(S.connection_programs(*both, within="12 hours", late="2 days"), f"{folder}/out", f"{folder}/checkpoint")

    found = spark.read.parquet(f"{arriving(spark, rows, run)}/out").where("ts < timestamp '2024-01-24'")
    return found.select("server_id", F.col("remote_address").cast("bigint").alias("event_id"), "program")
