"""Tool catalogs: from JSON documents to servers, tools, prompts, resources and parameters.

A catalog is one row (server_id, doc). Three shapes are understood: a bare list of tools,
an object with `tools`, and either of those inside `result`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.sources import jsontext as J


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file; the server takes the file's name without its suffix."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return files.select(stem.alias("server_id"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def inventories(catalogs: DataFrame) -> DataFrame:
    """One row per catalog with its lists. Unreadable documents keep a row with `readable` false."""
    v = F.col("v")
    body = F.coalesce(J.object_at(v, "$.result"), F.when(J.is_object(v), v))
    listed = F.when(J.is_array(v), J.items_at(v, "$")).otherwise(J.items_at(F.col("body"), "$.tools"))
    only_objects = lambda items: F.filter(items, J.is_object)
    return (
        catalogs.withColumn("v", J.parse(F.col("doc")))
        .withColumn("body", body)
        .select(
            "server_id",
            (J.is_array(v) | F.col("body").isNotNull()).alias("readable"),
            F.coalesce(J.any_text_at(F.col("body"), "$.serverInfo.name"), F.col("server_id")).alias("server_name"),
            J.any_text_at(F.col("body"), "$.serverInfo.version").alias("server_version"),
            J.any_text_at(F.col("body"), "$.protocolVersion").alias("protocol_version"),
            J.text_at(F.col("body"), "$.instructions").alias("instructions"),
            only_objects(listed).alias("tools"),
            only_objects(J.items_at(F.col("body"), "$.prompts")).alias("prompts"),
            only_objects(J.items_at(F.col("body"), "$.resources")).alias("resources"),
            only_objects(J.items_at(F.col("body"), "$.resourceTemplates")).alias("resource_templates"),
        )
    )


def looks_like_tools_file(v: Column) -> Column:
    """A non-empty list of named objects, or an object with a list of tools."""
    items = J.items_at(v, "$")
    named = (F.size(items) > 0) & F.forall(items, lambda t: J.is_object(t) & F.try_variant_get(t, "$.name", "variant").isNotNull())
    body = F.coalesce(J.object_at(v, "$.result"), v)
    return F.coalesce(
        F.when(J.is_array(v), named).otherwise(
            J.is_array(F.try_variant_get(body, "$.tools", "variant"))
        ),
        F.lit(False),
    )


def _described(v: Column) -> list[Column]:
    return [
        F.coalesce(J.any_text_at(v, "$.name"), F.lit("")).alias("name"),
        J.text_at(v, "$.title").alias("title"),
        F.coalesce(J.any_text_at(v, "$.description"), F.lit("")).alias("description"),
    ]


def tool_columns(v: Column) -> list[Column]:
    """Columns of a tool from its JSON object, with safe defaults for odd input."""
    schema = F.coalesce(*[J.truthy(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("inputSchema", "input_schema", "parameters")])
    return [
        *_described(v),
        F.when(J.is_object(schema), schema).alias("input_schema"),
        J.object_at(v, "$.outputSchema").alias("output_schema"),
        J.object_at(v, "$.annotations").alias("annotations"),
        v.alias("raw"),
    ]


def tools(inventory: DataFrame) -> DataFrame:
    rows = inventory.select("server_id", F.posexplode("tools").alias("seq", "v"))
    return rows.select("server_id", F.col("seq").cast("long").alias("seq"), *tool_columns(F.col("v")))


def prompts(inventory: DataFrame) -> DataFrame:
    rows = inventory.select("server_id", F.posexplode("prompts").alias("seq", "v"))
    given = F.filter(
        J.items_at(F.col("v"), "$.arguments"), lambda a: F.coalesce(J.any_text_at(a, "$.name") != "", F.lit(False))
    )
    arguments = F.transform(
        given,
        lambda a: F.struct(
            J.any_text_at(a, "$.name").alias("name"),
            F.coalesce(J.any_text_at(a, "$.description"), F.lit("")).alias("description"),
            F.coalesce(F.try_variant_get(a, "$.required", "boolean"), F.lit(False)).alias("required"),
        ),
    )
    return rows.select(
        "server_id", F.col("seq").cast("long").alias("seq"), *_described(F.col("v")), arguments.alias("arguments"),
        J.text_at(F.col("v"), "$.renderedText").alias("rendered_text"),
    )


def resources(inventory: DataFrame) -> DataFrame:
    rows = inventory.select("server_id", F.posexplode("resources").alias("seq", "v"))
    v = F.col("v")
    return rows.select(
        "server_id", F.col("seq").cast("long").alias("seq"),
        F.coalesce(J.any_text_at(v, "$.uri"), F.lit("")).alias("uri"),
        F.coalesce(J.any_text_at(v, "$.name"), F.lit("")).alias("name"),
        F.coalesce(J.any_text_at(v, "$.description"), F.lit("")).alias("description"),
        J.text_at(v, "$.mimeType").alias("mime_type"),
        J.text_at(v, "$.text").alias("text"),
    )


def resource_templates(inventory: DataFrame) -> DataFrame:
    rows = inventory.select("server_id", F.posexplode("resource_templates").alias("seq", "v"))
    v = F.col("v")
    return rows.select(
        "server_id", F.col("seq").cast("long").alias("seq"),
        F.coalesce(J.any_text_at(v, "$.uriTemplate"), F.lit("")).alias("uri_template"),
        F.coalesce(J.any_text_at(v, "$.name"), F.lit("")).alias("name"),
        F.coalesce(J.any_text_at(v, "$.description"), F.lit("")).alias("description"),
        J.text_at(v, "$.mimeType").alias("mime_type"),
    )


def parameter_array(schema: Column) -> Column:
    """Parameters of an input schema as an array of (name, schema, required), sorted by name."""
    required = F.coalesce(F.try_variant_get(schema, "$.required", "array<string>"), F.array().cast("array<string>"))
    return F.transform(
        J.members_at(schema, "$.properties"),
        lambda m: F.struct(
            m["key"].alias("name"),
            F.when(J.is_object(m["value"]), m["value"]).alias("schema"),
            F.array_contains(required, m["key"]).alias("required"),
        ),
    )


def parameters(tool_rows: DataFrame) -> DataFrame:
    """One row per tool parameter."""
    rows = tool_rows.select(
        "server_id", F.col("seq").alias("tool_seq"), F.col("name").alias("tool"),
        F.posexplode(parameter_array(F.col("input_schema"))).alias("pos", "p"),
    )
    return rows.select("server_id", "tool_seq", "tool", "pos", F.col("p.name").alias("param"), "p.schema", "p.required")


def manifest_tools(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The tools manifest of each repository: known paths first, then any JSON file with named tools.

    `files(repo, path, size, text)`; one row per repository that ships one: (repo, path, doc).
    """
    skipped = F.col("path").rlike(SKIPPED_DIRS) | F.regexp_extract("path", "[^/]*$", 0).rlike(
        r"^(?:package\.json|package-lock\.json|tsconfig)"
    )
    rank = F.array_position(F.array(*[F.lit(p) for p in MANIFEST_PATHS]), F.col("path"))
    candidates = (
        files.where(F.lit(True) if max_bytes is None else F.col("size") <= max_bytes).where(F.col("path").endswith(".json"))
        .withColumn("place", F.when(rank > 0, rank).otherwise(F.lit(len(MANIFEST_PATHS) + 1)))
        .where((F.col("place") <= len(MANIFEST_PATHS)) | ~skipped)
        .withColumn("v", J.parse(F.col("text")))
    )
    body = F.coalesce(J.object_at(F.col("v"), "$.result"), F.when(J.is_object(F.col("v")), F.col("v")))
    listed = J.items_at(body, "$.tools")
    good = candidates.where(
        (F.size(listed) > 0) & F.forall(listed, lambda t: J.text_at(t, "$.name").isNotNull())
    )
    chosen = good.groupBy("repo").agg(F.min_by(F.struct("path", "text"), F.struct("place", "path")).alias("m"))
    return chosen.select("repo", F.col("m.path").alias("path"), F.col("m.text").alias("doc"))


# Where repositories usually keep a tools manifest, in order of preference.
MANIFEST_PATHS = (
    "tools.json", "mcp.json", "server.json", "testdata/tools.json", ".mcp/tools.json", "src/tools.json",
    "src/mcp.json", "test/tools.json", "tools/tools.json",
)
# Folders that hold no source of the project itself.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".tox", "dist", "build",
    "site-packages", ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", ".next", "out", "tests", "test",
    "__tests__", "spec", "testdata",
)
SKIPPED_DIRS = r"(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + r")/"


def with_fallback(definitions: DataFrame) -> DataFrame:
    """Keep the definitions of the best source per server.

    `definitions(server_id, priority, ...)`; the lowest priority present wins, as a whole.
    Priorities: 0 live or listed, 1 source code, 2 shipped manifest, 3 other languages.
    """
    best = definitions.groupBy("server_id").agg(F.min("priority").alias("best"))
    kept = definitions.join(best, "server_id").where(F.col("priority") == F.col("best"))
    return kept.drop("best")


def fallback_errors(errors: DataFrame, best: DataFrame) -> DataFrame:
    """Start errors stay, but are no longer fatal where a fallback gave definitions.

    `errors(server_id, stage, message, fatal)`, `best(server_id, priority)`.
    """
    used = best.select("server_id", (F.col("priority") > 0).alias("_fallback")).distinct()
    joined = errors.join(used, "server_id", "left")
    return joined.withColumn("fatal", F.col("fatal") & ~F.coalesce("_fallback", F.lit(False))).drop("_fallback")
