"""From files to fact tables: catalogs, client configurations and project files become the tables of a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan import reference_lists as L
from riskscan.operators import code as K
from riskscan.operators import surfaces as SF
from riskscan.operators.skew import written
from riskscan.plans.scan import Tables
from riskscan.schemas import SERVER_SCHEMA, conform
from riskscan.sources import catalog as C
from riskscan.sources import configs as CF
from riskscan.sources import definitions as D
from riskscan.sources import manifests as M
from riskscan.sources import source_tree as T

# Where definitions come from, the best first.
LISTED, IN_CODE, SHIPPED, OTHER_LANGUAGE = range(4)


def servers_of(inventory: DataFrame | None, configs: DataFrame | None) -> DataFrame:
    """Configured servers, and those that only a catalog knows; connected if a catalog could be read."""
    parts = []
    if configs is not None:
        parts.append(CF.servers(configs).drop("connected", "instructions", "protocol_version"))
    if inventory is not None:
        listed = inventory.select(
            "server_id", F.lit(0).cast("bigint").alias("seq"), F.col("server_name").alias("name"), F.lit("offline").alias("transport"),
            F.array().cast("array<string>").alias("args"), F.lit("catalog").alias("origin_kind"),
        )
        if configs is not None:
            listed = listed.join(parts[0].select("server_id").distinct(), "server_id", "left_anti")
        parts.append(listed)
    rows = reduce(DataFrame.unionByName, [conform(p, SERVER_SCHEMA) for p in parts])
    if inventory is None:
        return rows
    told = inventory.where("readable").groupBy("server_id").agg(
        F.lit(True).alias("_connected"), F.max("instructions").alias("_instructions"), F.max("protocol_version").alias("_version")
    )
    joined = rows.join(told, "server_id", "left")
    joined = joined.withColumns({"connected": F.coalesce("_connected", F.lit(False)), "instructions": F.col("_instructions"), "protocol_version": F.col("_version")})
    return conform(joined, SERVER_SCHEMA)


def tools_of(inventory: DataFrame | None, files: DataFrame | None) -> DataFrame:
    """Tool definitions with `priority`, of the best source each server has.

    `files(server_id, path, size, text)`: definitions are read from code and from shipped
    manifests too, and used where nothing better is there.
    """
    parts = []
    if inventory is not None:
        parts.append(C.tools(inventory).withColumn("priority", F.lit(LISTED)))
    if files is not None:
        parts.append(D.as_tools(D.first_definitions(D.javascript_tools(files.where(T.language(F.col("path")) == "javascript")))).withColumn("priority", F.lit(IN_CODE)))
        shipped = C.manifest_tools(files.withColumnRenamed("server_id", "repo")).select(F.col("repo").alias("server_id"), "doc")
        parts.append(C.tools(C.inventories(shipped)).withColumn("priority", F.lit(SHIPPED)))
        parts.append(D.as_tools(D.other_language_tools(files)).withColumn("priority", F.lit(OTHER_LANGUAGE)))
    return C.with_fallback(reduce(DataFrame.unionByName, parts))


def tables_of(
    spark: SparkSession,
    catalogs: DataFrame | None = None,
    configs: DataFrame | None = None,
    files: DataFrame | None = None,
    tool_calls: DataFrame | None = None,
    ignore: DataFrame | None = None,
) -> Tables:
    """The tables of a scan from what there is.

    `catalogs(server_id, doc)`, `configs(file, doc)`, `files(server_id, path, size, text)`,
    `tool_calls(server_id, seq, tool, output_text)`, `ignore(server_id, pattern)`. Definitions
    and code facts are written once, because many rules read them.
    """
    if catalogs is None and configs is None and files is None:
        raise ValueError("nothing to scan")
    inventory = None if catalogs is None else C.inventories(catalogs)
    servers = servers_of(inventory, configs) if catalogs is not None or configs is not None else None
    tools = written(tools_of(inventory, files)) if catalogs is not None or files is not None else None
    texts = []
    if tools is not None:
        texts.append(SF.tool_surfaces(tools))
    if inventory is not None:
        texts += [
            SF.instruction_surfaces(inventory), SF.prompt_surfaces(C.prompts(inventory)), SF.resource_surfaces(C.resources(inventory)),
            SF.template_surfaces(C.resource_templates(inventory)),
        ]
    if tool_calls is not None:
        texts.append(SF.output_surfaces(tool_calls))
    manifests = None if files is None else files.select("server_id", F.col("path").alias("file"), "text")
    return Tables(
        servers=servers,
        tools=tools,
        surfaces=SF.union(*texts) if texts else None,
        code_hits=None if files is None else written(K.code_hits(T.source_files(files, ignore))),
        dependencies=M.dependencies(servers, manifests),
        install_scripts=None if manifests is None else M.install_scripts(manifests),
        known_bad=L.known_bad(spark),
        popular=L.popular(spark),
    )


def read_tables(spark: SparkSession, catalogs: str | None = None, configs: str | None = None, sources: str | None = None) -> Tables:
    """The same from folders: catalogs one JSON file per server, configurations as JSON, sources one folder per server."""
    found = None if catalogs is None else C.read_catalogs(spark, catalogs).select("server_id", "doc")
    settings = None
    if configs is not None:
        settings = spark.read.option("recursiveFileLookup", True).text(configs, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc")
        )
    files = None
    if sources is not None:
        below = F.substring_index("path", f"{sources.rstrip('/')}/", -1)
        files = T.read_files(spark, sources).select(
            F.substring_index(below, "/", 1).alias("server_id"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "size", "text"
        )
    return tables_of(spark, found, settings, files)


def present(tables: Tables, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Per table of a scan the servers that have rows in it, for `scan.skipped_by_server`.

    A server whose source was read counts as checked for code even if nothing was found in it.
    """
    found = {name: getattr(tables, name) for name in ("servers", "tools", "surfaces", "dependencies", "install_scripts")}
    out = {name: df.select("server_id").distinct() for name, df in found.items() if df is not None}
    if files is not None:
        out["code_hits"] = files.select("server_id").distinct()
    return out
