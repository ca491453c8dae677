"""Events as runtime facts: runs of time-outs, windows, sessions, drift, reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscan.operators import drift as D
from riskscan.operators import graph as G
from riskscan.operators import runtime as R
from riskscan.operators.skew import first_per
from riskscan.streaming import streams as S
from workloads import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def server():
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


SERVER_SQL = "'u' || cast(user_id as varchar)"


@query(
    "timeout_islands",
    f"""
    with e as (select {SERVER_SQL} as server_id, event_id, ts, event_type in ('error', 'click') as hit from events),
    g as (select *, sum(case when hit then 0 else 1 end) over (partition by server_id order by ts, event_id rows unbounded preceding) as island from e),
    n as (select *, case when hit then sum(hit::int) over (partition by server_id, island order by ts, event_id rows unbounded preceding) else 0 end as in_a_row from g)
    select server_id, event_id, cast(in_a_row as bigint) as in_a_row from n
    """,
)
def timeout_islands(spark, sf_dir):
    """WIN-04, STR-07: time-outs in a row, with a busy user cut into days."""
    calls = events(spark, sf_dir).withColumn("server_id", server())
    rows = R.timeout_runs(calls, "server_id", "ts", ["ts", "event_id"], F.col("event_type").isin("error", "click"))
    return rows.select("server_id", "event_id", F.col("in_a_row").cast("bigint").alias("in_a_row"))


@query(
    "event_first_seen",
    f"""
    select {SERVER_SQL} as server_id, event_type, arg_min(event_id, (ts, event_id)) as first_event, count(*) as events
    from events group by all
    """,
)
def event_first_seen(spark, sf_dir):
    """WIN-07, STR-03: the first event of each kind."""
    ev = events(spark, sf_dir).withColumn("server_id", server())
    first = first_per(ev, ["server_id", "event_type"], ["ts", "event_id"], ["event_id"]).withColumnRenamed("event_id", "first_event")
    counts = ev.groupBy("server_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
    return first.join(counts, ["server_id", "event_type"])


@query(
    "event_tumbling",
    """
    select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as events,
           cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
    from events group by all
    """,
)
def event_tumbling(spark, sf_dir):
    """STR-04 in batch."""
    ev = events(spark, sf_dir).withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    rows = S.tumbling(ev, "event_type", "1 hour")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", F.col("total").alias("cents"))


@query(
    "event_sliding",
    """
    with e as (select ts, event_type, unnest([0, 1, 2, 3]) as k from events)
    select strftime(time_bucket(interval 15 minutes, ts) - k * interval 15 minutes, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as events
    from e group by all
    """,
)
def event_sliding(spark, sf_dir):
    """STR-04, sliding: one hour every fifteen minutes."""
    rows = S.tumbling(events(spark, sf_dir), "event_type", "1 hour", slide="15 minutes")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events")


@query(
    "event_sessions",
    f"""
    with e as (select {SERVER_SQL} as server_id, ts, event_type, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by server_id order by ts rows unbounded preceding) as nr from e)
    select server_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events, count(*) filter (event_type = 'error') as errors
    from s group by server_id, nr
    """,
)
def event_sessions(spark, sf_dir):
    """STR-05 in batch: bursts of activity."""
    ev = events(spark, sf_dir).withColumn("server_id", server())
    rows = S.sessions(ev, "server_id", "6 hours")
    return rows.select("server_id", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "errors")


@query(
    "resource_limits",
    f"""
    with s as (select {SERVER_SQL} as server_id, time_bucket(interval 1 day, ts) as tick, event_type, max(value) as memory from events group by all),
    t as (select server_id, tick, sum(memory) as memory, count(*) as processes from s group by all)
    select server_id, strftime(min(tick), '%Y-%m-%d') as first_day, count(*) as ticks from t where memory > 300 or processes > 4 group by all
    """,
)
def resource_limits(spark, sf_dir):
    """AGG-17, STR-04: sums per tick against limits; a process counts once per tick."""
    ev = events(spark, sf_dir).select(
        server().alias("server_id"), "ts", F.col("event_type").alias("pid"), F.col("value").alias("memory_mb"), F.lit(0.0).alias("cpu_seconds")
    )
    broken = R.resource_ticks(ev, "1 day").withColumn("reason", R.limit_reason(300, 4, 1e9)).where(F.col("reason").isNotNull())
    return broken.groupBy("server_id").agg(
        F.date_format(F.min("tick.start"), "yyyy-MM-dd").alias("first_day"), F.count(F.lit(1)).alias("ticks")
    )


@query(
    "observed_drift",
    f"""
    with e as (select {SERVER_SQL} as server_id, event_type as tool, ts, event_id, 'h' || cast(cast(json_extract(props, '$.k') as integer) // 25 as varchar) as hash from events),
    b as (select server_id, tool, arg_min(hash, (ts, hash)) as base from e group by all),
    c as (select server_id, tool, hash, base, min(ts) as first from e join b using (server_id, tool) where hash <> base group by all)
    select server_id, tool, hash as after_hash, base as before_hash, strftime(first, '%Y-%m-%d %H:%M:%S') as ts from c
    """,
)
def observed_drift(spark, sf_dir):
    """WIN-09, STR-01 in batch: each definition other than the first seen, once."""
    number = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    snaps = events(spark, sf_dir).select(
        "ts", server().alias("server_id"), F.col("event_type").alias("tool"),
        F.concat(F.lit("h"), F.floor(number / 25).cast("string")).alias("hash"),
    )
    rows = D.observed_changes(snaps)
    return rows.select("server_id", "tool", "after_hash", "before_hash", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# ---- reachability ----------------------------------------------------------------------------------

EDGE_SQL = """
    e as (select distinct 'n' || cast(l_partkey as varchar) as src, 'n' || cast((l_partkey * 3 + l_linenumber) % 1000 + l_partkey % 7 * 1000 as varchar) as dst,
                 l_linenumber % 5 = 0 as sanitized from lineitem),
"""


@query(
    "value_spread",
    """
    with recursive """
    + EDGE_SQL
    + """
    seeds as (select distinct 'n' || cast(p_partkey as varchar) as node, p_brand as origin from part),
    r as (select node, origin, 0 as depth from seeds
          union select e.dst, r.origin, 0 from r join e on e.src = r.node where not e.sanitized)
    select distinct node, origin from r
    """,
)
def value_spread(spark, sf_dir):
    """UDF-10: which inputs reach which variables, to the end; sanitised edges pass nothing."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("n"), ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 1000 + F.col("l_partkey") % 7 * 1000).cast("string")).alias("dst"),
        (F.col("l_linenumber") % 5 == 0).alias("sanitized"),
    )
    node = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    seeds = table(spark, sf_dir, "part").select(node.alias("node"), F.col("p_brand").alias("origin"))
    return G.value_spread(edges, seeds).select("node", "origin")


@query(
    "import_closure",
    """
    with recursive f as (select p_partkey as k from part),
    e as (select k as src, k // 2 as dst from f where k > 0 union select k, k // 3 from f where k > 0),
    r as (select k as node, k as origin, 0 as depth from f
          union select e.dst, r.origin, r.depth + 1 from r join e on e.src = r.node)
    select 'm' || cast(node as varchar) || '.js' as node, 'm' || cast(origin as varchar) || '.js' as origin, min(depth) as depth from r group by all
    """,
)
def import_closure(spark, sf_dir):
    """UDF-11: parts as source files that import others; the closure of every file."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = lambda k: F.concat(F.lit("m"), k.cast("string"), F.lit(".js"))
    line = lambda by: F.concat(F.lit("import './m"), F.floor(key / by).cast("string"), F.lit(".js';\n"))
    files = part.select(
        F.lit("s").alias("server_id"), name(key).alias("path"), F.lit("javascript").alias("language"),
        F.when(key > 0, F.concat(line(2), line(3))).otherwise("").alias("text"),
    )
    entries = part.select(name(key).alias("node"), name(key).alias("origin"))
    return G.import_closure(G.import_edges(files), entries, limit=None).select("node", "origin", "depth")
