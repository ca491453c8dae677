"""Packages, launch commands, configuration files and snapshots, derived from the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscan.functions import packages as P
from riskscan.operators import drift as D
from riskscan.operators import external as X
from riskscan.operators import names as N
from riskscan.operators import packages as K
from riskscan.rules import packages as RP
from riskscan.schemas import DEPENDENCY_SCHEMA, conform
from riskscan.sources import configs as CF
from riskscan.sources import manifests as M
from workloads import query, table

# ---- names -----------------------------------------------------------------------------------


def part_tools(spark, sf_dir):
    """Parts as tools: the brand is the server, the name is the tool."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("server_id"), F.col("p_partkey").alias("seq"), F.translate("p_name", " ", "_").alias("name")
    )


@query(
    "name_collision",
    """
    with t as (select p_brand as server_id, p_partkey, translate(p_name, ' ', '_') as name from part),
    u as (select distinct name, server_id from t)
    select t.server_id, t.p_partkey as seq, t.name, max(u.server_id) as peer
    from t join u on u.name = t.name and u.server_id <> t.server_id group by all
    """,
)
def name_collision(spark, sf_dir):
    """JOIN-02: the last other server that uses the name."""
    return N.name_collisions(part_tools(spark, sf_dir)).select("server_id", "seq", "name", "peer")


@query(
    "duplicate_names",
    """
    select p_brand as server_id, translate(p_name, ' ', '_') as name, count(*) as copies from part group by all having count(*) > 1
    """,
)
def duplicate_names(spark, sf_dir):
    """AGG-06."""
    return N.duplicate_names(part_tools(spark, sf_dir)).select("server_id", "name", "copies")


@query(
    "lookalike_names",
    """
    with t as (select p_brand as server_id, p_partkey as seq, p_partkey % 3 as k, translate(p_name, ' ', '_') as name from part),
    o as (select server_id, seq, case k when 0 then translate(name, 'ae', chr(1072) || chr(1077)) when 1 then name || chr(9731) else name end as name, name as plain from t),
    known as (select distinct name from o)
    select server_id, seq, case when name like '%' || chr(9731) then plain || '?' else plain end as skeleton,
           (case when name like '%' || chr(9731) then plain || '?' else plain end) in (select name from known) as copies
    from o where regexp_matches(name, '[^\\x00-\\x7F]')
    """,
)
def lookalike_names(spark, sf_dir):
    """JOIN-03, SCL-06."""
    tools = part_tools(spark, sf_dir)
    odd = F.when(F.col("seq") % 3 == 0, F.translate("name", "ae", "ае")).when(F.col("seq") % 3 == 1, F.concat("name", F.lit("☃"))).otherwise(F.col("name"))
    return N.lookalike_names(tools.withColumn("name", odd)).select("server_id", "seq", "skeleton", "copies")


# ---- look-alike packages -----------------------------------------------------------------------

MISSPELT = (
    "case p_partkey % 7 when 0 then replace(p_name, ' ', '-') when 1 then concat(left(p_name, 2), substring(p_name, 4)) "
    "when 2 then concat(substring(p_name, 2, 1), left(p_name, 1), substring(p_name, 3)) when 3 then concat(p_name, '7') "
    "when 4 then concat(p_name, 'xy') when 5 then concat('z', substring(p_name, 2)) else p_name end"
)


@query(
    "typosquat",
    f"""
    with w as (select distinct {MISSPELT} as raw from part),
    n as (select distinct regexp_replace(lower(trim(raw)), '[-_.]+', '-', 'g') as name from w),
    p as (select distinct regexp_replace(lower(trim(p_name)), '[-_.]+', '-', 'g') as target from part)
    select n.name, min(p.target) as target from n join p
      on length(n.name) >= 5 and length(p.target) >= 5
     and (damerau_levenshtein(n.name, p.target) <= 1
          or (regexp_replace(n.name, '[0-9]', '', 'g') = regexp_replace(p.target, '[0-9]', '', 'g') and n.name <> p.target))
    where n.name not in (select target from p) group by n.name
    """,
)
def typosquat(spark, sf_dir):
    """JOIN-06: fuzzy join by shared deletions instead of comparing all pairs."""
    part = table(spark, sf_dir, "part")
    norm = lambda c: P.normalized_name(c, F.lit("pypi"))
    names = part.select(F.lit("pypi").alias("ecosystem"), norm(F.expr(MISSPELT)).alias("name")).distinct()
    popular = part.select(F.lit("pypi").alias("ecosystem"), F.col("p_name").alias("name")).distinct()
    return K.lookalike_targets(names, popular).select("name", "target")


BAD_VERSION = "concat(cast(l_linenumber as string), '.', cast(cast(l_quantity as int) % 12 as string))"


@query(
    "bad_versions",
    """
    with d as (select 's' || cast(l_suppkey as varchar) as server_id, 'pkg' || cast(l_partkey % 60 as varchar) as name, l_orderkey,
                      l_linenumber as major, cast(l_quantity as integer) % 12 as minor, l_tax = 0.0 as unknown from lineitem),
    m as (select *, try_cast(replace(name, 'pkg', '') as integer) as k from d),
    r as (select *, case when k % 4 = 0 then 'range' when k % 4 = 1 then 'exact' when k % 4 = 2 then 'any' else 'below' end as kind from m where k < 20),
    c as (select *, case kind when 'range' then (major, minor) >= (2, 10) when 'exact' then major = 1 and minor = 5 when 'any' then true
                    else (major, minor) < (1, 3) end as listed from r)
    select server_id, name, count(*) as uses, count(*) filter (not unknown or kind = 'any') as certain from c
    where case when unknown then kind in ('any', 'range') else listed end group by all
    """,
)
def bad_versions(spark, sf_dir):
    """JOIN-05, SCL-11/12: equi-join on the name, range test on the version."""
    li = table(spark, sf_dir, "lineitem")
    deps = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("server_id"),
        F.concat(F.lit("Pkg"), (F.col("l_partkey") % 60).cast("string")).alias("name"), F.lit("npm").alias("ecosystem"),
        F.lit("package.json").alias("source"), F.lit("").alias("spec"),
        F.when(F.col("l_tax") != 0.0, F.expr(BAD_VERSION)).alias("version"), F.lit(True).alias("direct"),
    )
    rule = F.array(F.lit(">=2.10"), F.lit("1.5"), F.lit("*"), F.lit("<1.3"))
    key = F.col("l_partkey") % 60
    known = li.select(key.alias("k")).distinct().where("k < 20").select(
        F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg"), F.col("k").cast("string")).alias("name"),
        F.array(F.element_at(rule, (F.col("k") % 4 + 1).cast("int"))).alias("versions"), F.lit("bad").alias("summary"),
        F.array().cast("array<string>").alias("references"),
    )
    hits = K.match_known_bad(conform(deps, DEPENDENCY_SCHEMA), known)
    return hits.groupBy("server_id", F.lower("name").alias("name")).agg(
        F.count(F.lit(1)).alias("uses"), F.count_if("certain").alias("certain")
    )


# ---- manifests and launch commands --------------------------------------------------------------


@query(
    "requirement_rows",
    """
    with p as (select p_brand as server_id, p_partkey, translate(p_name, ' ', '-') as name, p_size from part),
    l as (select server_id, name, p_size, p_partkey from p)
    select server_id, name, 'pypi' as ecosystem,
           case p_size % 4 when 0 then '==' || p_size || '.1' when 1 then '>=' || p_size when 2 then '' else 'git+https://h.example/' || name end as spec,
           case p_size % 4 when 0 then p_size || '.1' end as version, cast(2 as integer) as line, p_partkey
    from l where p_size % 4 < 3
    union all
    select server_id, 'git+https://h.example/' || name, 'pypi', 'git+https://h.example/' || name, null, 2, p_partkey from l where p_size % 4 = 3
    """,
)
def requirement_rows(spark, sf_dir):
    """SCN-08: every part as a requirements file."""
    part = table(spark, sf_dir, "part")
    name = F.translate("p_name", " ", "-")
    size = F.col("p_size").cast("string")
    line = (
        F.when(F.col("p_size") % 4 == 0, F.concat(name, F.lit("=="), size, F.lit(".1  # pinned")))
        .when(F.col("p_size") % 4 == 1, F.concat(name, F.lit(">="), size, F.lit("; python_version > '3'")))
        .when(F.col("p_size") % 4 == 2, name)
        .otherwise(F.concat(F.lit("-e git+https://h.example/"), name))
    )
    files = part.select(
        F.concat_ws("|", "p_brand", F.col("p_partkey").cast("string")).alias("server_id"), F.lit("requirements.txt").alias("file"),
        F.concat(F.lit("# header\n"), line, F.lit("\n-r more.txt\n\n")).alias("text"),
    )
    rows = M.requirements(files)
    return rows.select(
        F.substring_index("server_id", "|", 1).alias("server_id"), "name", "ecosystem", "spec", "version", "line",
        F.substring_index("server_id", "|", -1).cast("bigint").alias("p_partkey"),
    )


@query(
    "lock_fill",
    """
    with p as (select p_partkey as k, 'lib-' || cast(p_partkey % 40 as varchar) as name, p_size from part)
    select 's' || cast(k as varchar) as server_id, name, '^' || p_size as spec,
           case when p_size % 2 = 0 then p_size || '.0.1' end as version, true as direct from p
    union all
    select 's' || cast(k as varchar), 'deep-' || cast(k % 7 as varchar), '9.' || p_size, '9.' || p_size, false from p
    union all
    select 's' || cast(k as varchar), name, '0.0.' || p_size, '0.0.' || p_size, false from p where p_size % 3 = 0
    """,
)
def lock_fill(spark, sf_dir):
    """SCN-09/10, JOIN-11: versions of direct packages from the lock file."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("lib-"), (F.col("p_partkey") % 40).cast("string"))
    deep = F.concat(F.lit("deep-"), (F.col("p_partkey") % 7).cast("string"))
    size = F.col("p_size").cast("string")
    cat = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    package = cat('{"dependencies": {"', name, '": "^', size, '"}}')
    top = F.when(F.col("p_size") % 2 == 0, cat('"node_modules/', name, '": {"version": "', size, '.0.1"}, ')).otherwise("")
    nested = F.when(F.col("p_size") % 3 == 0, cat('"node_modules/', deep, "/node_modules/", name, '": {"version": "0.0.', size, '"}, ')).otherwise("")
    lock = cat('{"packages": {"": {}, ', top, nested, '"node_modules/', deep, '": {"version": "9.', size, '"}}}')
    server = F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("server_id")
    files = part.select(server, F.explode(F.array(F.struct(F.lit("package.json").alias("file"), package.alias("text")), F.struct(F.lit("package-lock.json").alias("file"), lock.alias("text")))).alias("f"))
    files = files.select("server_id", "f.file", "f.text")
    return M.dependencies(None, files).select("server_id", "name", "spec", "version", "direct")


def supplier_configs(spark, sf_dir):
    """Every supplier as a client configuration file."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    cat = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    kind = F.col("s_suppkey") % 5
    body = (
        F.when(kind == 0, cat('{"mcpServers": {"a', key, '": {"command": "npx", "args": ["-y", "pkg-', key, '@1.', key, '.0"], "env": {"K": "v"}}}}'))
        .when(kind == 1, cat('{"servers": [{"name": "b', key, '", "url": "https://h', key, '.example/sse"},], // list\n}'))
        .when(kind == 2, cat('{"mcp": {"servers": {"c', key, '": {"command": {"path": "uvx", "args": ["tool-', key, '==2.0"]}}}}}'))
        .when(kind == 3, cat('{"projects": {"/home/p', key, '": {"mcpServers": {"d": {"command": "docker", "args": ["run", "-i", "img', key, '"]}}}}}'))
        .otherwise(cat('{"context_servers": {"e', key, '": {"serverUrl": "http://10.0.0.', key, '/m", "type": "http"}, "bad": {"note": 1}}}'))
    )
    return s.select(F.concat(F.lit("conf-"), key).alias("file"), body.alias("doc"))


@query(
    "config_servers",
    """
    with s as (select cast(s_suppkey as varchar) as k, s_suppkey % 5 as kind from supplier)
    select 'conf-' || k as origin,
           case kind when 0 then 'a' || k when 1 then 'b' || k when 2 then 'c' || k when 3 then 'p' || k || '/d' else 'e' || k end as name,
           case kind when 1 then 'sse' when 4 then 'http' else 'stdio' end as transport,
           case kind when 0 then 'npx' when 2 then 'uvx' when 3 then 'docker' end as command,
           case kind when 0 then '-y pkg-' || k || '@1.' || k || '.0' when 2 then 'tool-' || k || '==2.0' when 3 then 'run -i img' || k else '' end as args,
           case kind when 1 then 'https://h' || k || '.example/sse' when 4 then 'http://10.0.0.' || k || '/m' end as url
    from s
    """,
)
def config_servers(spark, sf_dir):
    """SCN-02/03/04: six container shapes, comments, trailing commas, transport."""
    rows = CF.servers(supplier_configs(spark, sf_dir))
    return rows.select("origin", "name", "transport", "command", F.array_join("args", " ").alias("args"), "url")


@query(
    "launch_packages",
    """
    with s as (select cast(s_suppkey as varchar) as k, s_suppkey % 5 as kind from supplier)
    select case kind when 0 then 'a' || k else 'c' || k end as server_id, case kind when 0 then 'pkg-' || k else 'tool-' || k end as name,
           case kind when 0 then 'npm' else 'pypi' end as ecosystem, case kind when 0 then '1.' || k || '.0' else '2.0' end as version
    from s where kind in (0, 2)
    """,
)
def launch_packages(spark, sf_dir):
    """SCN-12, SCL-14: packages of launch commands."""
    rows = M.launch_packages(CF.servers(supplier_configs(spark, sf_dir)))
    return rows.select("server_id", "name", "ecosystem", "version")


@query(
    "loose_dependencies",
    """
    with p as (select p_brand as server_id, p_partkey as k, p_size % 5 as kind from part)
    select server_id, 'lib-' || cast(k as varchar) as target_name,
           '''lib-' || cast(k as varchar) || ''' ' || case kind when 0 then 'is fetched from ''git+https://h.example/' || cast(k as varchar) || ''''
             when 1 then 'may be any version (''*'')' else 'may be any version (''latest'')' end || '.' as description
    from p where kind < 3
    """,
)
def loose_dependencies(spark, sf_dir):
    """DEP-004, FLT-15."""
    key = F.col("p_partkey").cast("string")
    spec = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("git+https://h.example/"), key)).when(F.col("p_size") % 5 == 1, "*").when(
        F.col("p_size") % 5 == 2, "latest").otherwise("^1.0")
    deps = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("server_id"), F.concat(F.lit("lib-"), key).alias("name"), F.lit("npm").alias("ecosystem"),
        F.lit("package.json").alias("source"), spec.alias("spec"), F.lit(True).alias("direct"),
    )
    return RP.loose_candidates(conform(deps, DEPENDENCY_SCHEMA)).select("server_id", "target_name", "description")


# ---- snapshots -----------------------------------------------------------------------------------


def order_snapshots(spark, sf_dir):
    """Orders as definitions in two snapshots: some changed, some gone, some new."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("server_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("tool"), "o_orderkey",
        F.col("o_orderpriority").alias("hash"),
    )
    before = o.where("o_orderkey % 11 <> 0").select("server_id", "tool", "hash")
    after = o.where("o_orderkey % 7 <> 0").select(
        "server_id", "tool", F.when(F.col("o_orderkey") % 5 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")).alias("hash")
    )
    return before, after


SNAP_SQL = """
    with o as (select 'c' || cast(o_custkey as varchar) as server_id, 'o' || cast(o_orderkey as varchar) as tool, o_orderkey as k, o_orderpriority as hash from orders),
    b as (select server_id, tool, hash from o where k % 11 <> 0),
    a as (select server_id, tool, case when k % 5 = 0 then hash || '!' else hash end as hash from o where k % 7 <> 0)
"""


@query(
    "snapshot_compare",
    SNAP_SQL
    + """
    select server_id, tool, case when b.hash is null then 'added' when a.hash is null then 'removed' else 'changed' end as change,
           b.hash as before_hash, a.hash as after_hash
    from b full outer join a using (server_id, tool) where b.hash is distinct from a.hash
    """,
)
def snapshot_compare(spark, sf_dir):
    """JOIN-12."""
    return D.compare(*order_snapshots(spark, sf_dir), D.SINCE_LAST).drop("when")


@query(
    "snapshot_check",
    SNAP_SQL
    + """
    , known as (select distinct server_id from b)
    select server_id, case when b.hash is null then 'added' when a.hash is null then 'removed' else 'changed' end as change, count(*) as tools
    from (select * from b where server_id in (select server_id from a)) b
    full outer join (select * from a where server_id in (select server_id from known)) a using (server_id, tool)
    where b.hash is distinct from a.hash group by all
    """,
)
def snapshot_check(spark, sf_dir):
    """JOIN-13: servers never seen give nothing."""
    changes = D.check_snapshot(*order_snapshots(spark, sf_dir))
    return changes.groupBy("server_id", "change").agg(F.count(F.lit(1)).alias("tools"))


@query(
    "snapshot_accept",
    SNAP_SQL + "select server_id, tool, coalesce(b.hash, a.hash) as hash from b full outer join a using (server_id, tool)",
)
def snapshot_accept(spark, sf_dir):
    """SNK-06: old hashes win until they are accepted."""
    return D.accept_snapshot(*order_snapshots(spark, sf_dir))


# ---- earlier reports -------------------------------------------------------------------------------


@query(
    "external_groups",
    """
    with r as (select 's' || cast(l_suppkey as varchar) as server_id, l_orderkey * 10 + l_linenumber as pos,
                      case l_linenumber % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'low' else 'info' end as severity,
                      l_returnflag || l_linestatus as title, 'tool' || cast(l_partkey % 9 as varchar) as tool, 'd' || cast(l_orderkey as varchar) as description from lineitem),
    g as (select server_id, severity, title, count(*) as "count", arg_min(description, pos) as description, list_sort(list(distinct tool)) as tools
          from r where severity <> 'info' group by all)
    select server_id, severity, title, "count", description, array_to_string(tools[1:5], ', ') as tools from g
    """,
)
def external_groups(spark, sf_dir):
    """AGG-14: findings of earlier reports by severity and title."""
    li = table(spark, sf_dir, "lineitem")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "low", "info")]), F.col("l_linenumber") % 4 + 1)
    rows = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("server_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), severity.alias("severity"),
        F.concat("l_returnflag", "l_linestatus").alias("title"), F.concat(F.lit("tool"), (F.col("l_partkey") % 9).cast("string")).alias("tool"),
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("description"),
    )
    return X.grouped_findings(rows).select("server_id", "severity", "title", "count", "description", "tools")
