"""Tool catalogs built from parts: schemas flattened, capabilities guessed, servers judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscan.operators import capabilities as K
from riskscan.operators import surfaces as SF
from riskscan.operators.skew import spread, written
from riskscan.rules import tools as RT
from riskscan.sources import catalog as C
from workloads import query, table


def catalogs(spark, sf_dir):
    """One catalog per part, with one tool whose schema depends on the part."""
    part = spread(table(spark, sf_dir, "part"))
    cat = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    key, name = F.col("p_partkey").cast("string"), F.translate("p_name", " ", "_")
    kind = F.col("p_size") % 5
    param = (
        F.when(kind == 0, '"command": {"type": "string", "description": "what to run"}')
        .when(kind == 1, '"path": {"type": "string", "enum": ["a", "b"]}')
        .when(kind == 2, '"url": {"type": ["string", "null"], "title": "where"}')
        .when(kind == 3, '"sql": {"type": "string", "default": "select 1"}')
        .otherwise('"items": {"type": "array", "items": {"anyOf": [{"description": "one"}, {"properties": {"deep": {"const": "x"}}}]}}')
    )
    doc = cat('{"tools": [{"name": "', name, '", "description": "Part ', key, ' of brand ', F.col("p_brand"), '.", "inputSchema": {"type": "object", "properties": {',
              param, "}}}]}")
    return part.select(F.concat_ws("/", "p_brand", key).alias("server_id"), doc.alias("doc"))


TOOLS_SQL = """
    with t as (select p_brand || '/' || cast(p_partkey as varchar) as server_id, p_brand as brand, p_partkey as k, translate(p_name, ' ', '_') as name, p_size % 5 as kind,
                      'Part ' || cast(p_partkey as varchar) || ' of brand ' || p_brand || '.' as description from part)
"""


@query(
    "schema_flatten",
    TOOLS_SQL
    + """
    , s(kind, surface, place, text) as (values
        (0, 'param-name', 'param command > name', 'command'), (0, 'param-description', 'param command > description', 'what to run'),
        (1, 'param-name', 'param path > name', 'path'), (1, 'param-value', 'param path > enum', 'a'), (1, 'param-value', 'param path > enum', 'b'),
        (2, 'param-name', 'param url > name', 'url'), (2, 'param-description', 'param url > title', 'where'),
        (3, 'param-name', 'param sql > name', 'sql'), (3, 'param-value', 'param sql > default', 'select 1'),
        (4, 'param-name', 'param items > name', 'items'), (4, 'param-description', 'param items > items > anyOf[0] > description', 'one'),
        (4, 'param-name', 'param deep > name', 'deep'), (4, 'param-value', 'param deep > const', 'x'))
    select server_id, 'tool-name' as kind, 'tool ' || name || ' > name' as location, name as text from t
    union all select server_id, 'tool-description', 'tool ' || name || ' > description', description from t
    union all select t.server_id, s.surface, 'tool ' || t.name || ' > ' || s.place, s.text from t join s using (kind)
    """,
)
def schema_flatten(spark, sf_dir):
    """SCN-01, PRJ-01 to PRJ-04: nested schemas to one row per text, in one pass."""
    rows = SF.tool_surfaces(C.tools(C.inventories(catalogs(spark, sf_dir))))
    return rows.select("server_id", "kind", "location", "text")


def brand_tools(spark, sf_dir):
    """The tools of all parts, with the brand as the server."""
    tools = C.tools(C.inventories(catalogs(spark, sf_dir)))
    key = F.substring_index("server_id", "/", -1).cast("bigint")
    return tools.withColumn("seq", key).withColumn("server_id", F.substring_index("server_id", "/", 1))


def with_signals(spark, sf_dir):
    """Tools with signals, worked out once; what follows reads them several times."""
    return written(K.with_signals(brand_tools(spark, sf_dir)))


@query(
    "tool_signals",
    TOOLS_SQL
    + """
    select brand as server_id, k as tool_seq, name as tool,
           case kind when 0 then 'exec' when 1 then 'fs-read' when 2 then 'network' else 'database' end as capability, kind <> 1 as strong,
           case kind when 0 then 'any text may be given for ''command''' when 1 then 'takes the path ''path'', though it doesn''t speak of files'
                when 2 then 'any address may be given for ''url''' else 'any statement may be given for ''sql''' end as reason
    from t where kind < 4
    """,
)
def tool_signals(spark, sf_dir):
    """UDF-07, FLT-11: what tools can do, from their schemas."""
    rows = K.signal_rows(with_signals(spark, sf_dir))
    return rows.select("server_id", "tool_seq", "tool", "capability", "strong", "reason")


@query(
    "broad_servers",
    TOOLS_SQL
    + """
    , k as (select distinct brand as server_id, case kind when 0 then 'exec' when 2 then 'network' when 3 then 'database' end as kind from t where kind in (0, 2, 3))
    select server_id, string_agg(kind, ', ' order by kind) as kinds from k group by all having count(*) >= 3
    """,
)
def broad_servers(spark, sf_dir):
    """AGG-07, PERM-002."""
    rows = RT.broad_servers(with_signals(spark, sf_dir))
    return rows.select("server_id", F.array_join("kinds", ", ").alias("kinds"))


@query(
    "reader_sender_pairs",
    TOOLS_SQL
    + """
    , r as (select brand, name, min(k) as k from t where kind in (0, 3) group by all),
    s as (select brand, name, min(k) as k from t where kind in (0, 2) group by all),
    p as (select r.brand as server_id, r.name as reader, s.name as sender, row_number() over (partition by r.brand order by r.k, s.k) as rn
          from r join s on r.brand = s.brand and r.name <> s.name)
    select server_id, reader, sender from p where rn = 1
    """,
)
def reader_sender_pairs(spark, sf_dir):
    """JOIN-15, PERM-001: the first reading and the first sending tool, without forming pairs."""
    rows = RT.reader_sender_pairs(with_signals(spark, sf_dir))
    return rows.select("server_id", F.col("reader.name").alias("reader"), F.col("sender.name").alias("sender"))


@query(
    "call_policy",
    TOOLS_SQL
    + """
    select brand as server_id, k as seq, case kind when 0 then 'able to act: exec' when 2 then 'able to act: network'
           when 3 then 'able to act: database' end as skip_reason from t
    """,
)
def call_policy(spark, sf_dir):
    """FLT-17: which tools must not be called."""
    rows = K.with_signals(brand_tools(spark, sf_dir))
    return rows.select("server_id", "seq", K.skip_reason().alias("skip_reason"))
