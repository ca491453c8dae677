"""Client configuration files: from JSON documents to server rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.functions import secrets as S
from riskscan.functions import urls as U
from riskscan.schemas import SERVER_SCHEMA, conform
from riskscan.sources import jsontext as J

# Where clients keep their server tables, and names for the address.
TABLE_KEYS = ("mcpServers", "servers", "context_servers", "mcp_servers")
URL_KEYS = ("url", "serverUrl", "serverURL", "httpUrl", "uri", "endpoint")
STREAM_TYPES = ("http", "streamable-http", "streamablehttp", "streamable_http")

NO_ENTRIES = "array<struct<name:string,entry:variant>>"


def _entry(name: Column, entry: Column) -> Column:
    return F.struct(name.alias("name"), entry.alias("entry"))


def _table_entries(table: Column, prefix: Column) -> Column:
    """Entries of one table, given as an object by name or as a list with names."""
    by_name = F.transform(J.members_at(table, "$"), lambda m: _entry(F.concat(prefix, m["key"]), m["value"]))
    listed = F.filter(
        F.transform(
            J.items_at(table, "$"),
            lambda v, i: _entry(
                F.concat(
                    prefix, F.coalesce(J.any_text_at(v, "$.name"), F.concat(F.lit("server-"), i.cast("string")))
                ),
                v,
            ),
        ),
        lambda e: J.is_object(e["entry"]),
    )
    return F.when(J.is_object(table), by_name).otherwise(listed)


def _doc_entries(doc: Column, prefix: Column) -> Column:
    """Entries of every table directly in a document and in its `mcp` object."""
    tables = [F.try_variant_get(doc, f"$.{k}", "variant") for k in TABLE_KEYS]
    tables += [F.try_variant_get(doc, f"$.mcp.{k}", "variant") for k in TABLE_KEYS]
    return F.concat(
        *[F.when(t.isNotNull(), _table_entries(t, prefix)).otherwise(F.array().cast(NO_ENTRIES)) for t in tables]
    )


def config_entries(configs: DataFrame) -> DataFrame:
    """One row per usable server entry: (file, pos, name, entry). The first of a name wins.

    `configs(file, doc)`.
    """
    v = F.col("v")
    projects = F.flatten(
        F.transform(
            J.members_at(v, "$.projects"),
            lambda m: _doc_entries(
                m["value"], F.concat(F.coalesce(F.nullif(F.regexp_extract(m["key"], r"([^/\\]*)[/\\]*$", 1), F.lit("")), m["key"]), F.lit("/"))
            ),
        )
    )
    entries = F.concat(_doc_entries(v, F.lit("")), projects)
    rows = configs.withColumn("v", J.parse(F.col("doc"))).select("file", F.posexplode(entries).alias("pos", "e"))
    usable = rows.select("file", "pos", "e.name", "e.entry").where(
        F.coalesce(_url(F.col("entry")), _command(F.col("entry"))).isNotNull()
    )
    first = usable.groupBy("file", "name").agg(F.min("pos").alias("pos"))
    return usable.join(first, ["file", "name", "pos"])


def _url(entry: Column) -> Column:
    return F.nullif(F.coalesce(*[J.text_at(entry, f"$.{k}") for k in URL_KEYS]), F.lit(""))


def _command(entry: Column) -> Column:
    """The command, also in the form {"command": {"path": ..., "args": [...]}}."""
    inner = J.object_at(entry, "$.command")
    command = F.when(inner.isNotNull(), J.text_at(inner, "$.path")).otherwise(J.text_at(entry, "$.command"))
    return F.nullif(F.btrim(command), F.lit(""))


def _args(entry: Column) -> Column:
    inner = F.when(J.object_at(entry, "$.command").isNotNull(), F.try_variant_get(entry, "$.command.args", "array<string>"))
    return F.coalesce(inner, F.try_variant_get(entry, "$.args", "array<string>"), F.array().cast("array<string>"))


def _string_map(entry: Column, path: str) -> Column:
    members = F.transform(
        J.members_at(entry, path),
        lambda m: F.struct(m["key"].alias("key"), F.coalesce(F.try_variant_get(m["value"], "$", "string"), F.lit("")).alias("value")),
    )
    return F.map_from_entries(members)


def _remote_transport(entry: Column, url: Column) -> Column:
    declared = F.lower(F.coalesce(J.any_text_at(entry, "$.type"), J.any_text_at(entry, "$.transport"), F.lit("")))
    path = F.rtrim(F.coalesce(U.part(url, "PATH"), F.lit("")), F.lit("/"))
    return (
        F.when(declared == "sse", "sse")
        .when(declared.isin(*STREAM_TYPES), "http")
        .when(path.endswith("/sse"), "sse")
        .otherwise("http")
    )


def servers(configs: DataFrame) -> DataFrame:
    """Server rows of client configuration files; what only a running server tells is null."""
    entry = F.col("entry")
    url = _url(entry)
    rows = config_entries(configs).select(
        F.col("name").alias("server_id"), F.col("pos").cast("long").alias("seq"), "name",
        F.when(url.isNotNull(), _remote_transport(entry, url)).otherwise("stdio").alias("transport"),
        F.when(url.isNull(), _command(entry)).alias("command"),
        F.when(url.isNull(), _args(entry)).otherwise(F.array().cast("array<string>")).alias("args"),
        _string_map(entry, "$.env").alias("env"),
        F.when(url.isNotNull(), _string_map(entry, "$.headers"))
        .otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
        .alias("headers"),
        url.alias("url"),
        F.col("file").alias("origin"),
        F.lit("config").alias("origin_kind"),
    )
    return conform(rows, SERVER_SCHEMA)


# ---- placeholders ----------------------------------------------------------------------

# ${VAR}, ${env:VAR} and ${VAR:-default}
PLACEHOLDER = r"\$\{(?:env:)?([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}"


def has_placeholder(text: Column) -> Column:
    return text.rlike(PLACEHOLDER)


def expand(text: Column, env: Mapping[str, str]) -> Column:
    """Replace placeholders by values; one without value or default stays as it is."""
    pairs = [F.lit(v) for kv in sorted(env.items()) for v in kv]
    values = F.create_map(*pairs) if pairs else F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    tokens = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    pieces = F.split(text, PLACEHOLDER, -1)

    def value(token: Column) -> Column:
        default = F.when(token.contains(":-"), F.regexp_extract(token, PLACEHOLDER, 2))
        return F.coalesce(F.try_element_at(values, F.regexp_extract(token, PLACEHOLDER, 1)), default, token)

    joined = F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(value(F.get(tokens, i)), F.lit("")))), ""
    )
    return F.when(text.rlike(PLACEHOLDER), joined).otherwise(text)


def expand_list(values: Column, env: Mapping[str, str]) -> Column:
    return F.transform(values, lambda v: expand(v, env))


def expand_map(values: Column, env: Mapping[str, str]) -> Column:
    return F.transform_values(values, lambda _, v: expand(v, env))


# ---- what may be shown of a server -----------------------------------------------------


def display_target() -> Column:
    """A short text of what was scanned, without environment values or keys."""
    launch = F.btrim(F.concat_ws(" ", F.col("command"), F.array_join(S.mask_args(F.col("args")), " ")))
    return F.when(F.col("transport") == "stdio", launch).when(F.col("transport") == "offline", F.coalesce("origin", F.lit("offline"))).otherwise(
        F.coalesce(U.masked(F.col("url")), F.lit(""))
    )


def public_summary(server_rows: DataFrame) -> DataFrame:
    """Servers with only the names of environment variables and headers."""
    return server_rows.select(
        "server_id", "name", "transport", display_target().alias("target"),
        F.array_sort(F.map_keys("env")).alias("env_keys"), F.array_sort(F.map_keys("headers")).alias("header_keys"),
        "origin",
    )


def spec_problems() -> Column:
    """Why a server row cannot be used; empty when it can."""
    url = F.col("url")
    remote = F.col("transport").isin("http", "sse")
    scheme_ok = F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)).isin("http", "https"), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(remote & ~scheme_ok, F.concat(F.lit("URL must start with http:// or https:// (got '"), F.coalesce(url, F.lit("")), F.lit("')"))),
            F.when(remote & scheme_ok & U.host(url).isNull(), F.concat(F.lit("URL has no host name: '"), url, F.lit("'"))),
            F.when((F.col("transport") == "stdio") & F.col("command").isNull(), F.concat(F.lit("Server '"), F.col("name"), F.lit("' has no command"))),
        )
    )
