"""Source files: which ones are read, and what they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.functions import globs as G
from riskscan.operators.skew import broadcast_if_small, top_k
from riskscan.sources.catalog import SKIPPED_DIRS

# Suffixes.
PYTHON_SUFFIX = r"\.py$"
JS_SUFFIX = r"\.(?:js|mjs|cjs|ts|mts|cts|tsx|jsx)$"
TEST_FILE = r"^test_|_test\.py$|\.(?:test|spec)\.[jt]s$|^conftest\.py$"
# What makes a JavaScript file a bundle.
LONG_LINE = 500
LONGEST_LINE = 5000
MEAN_LINE = 400
LONG_LINES = 50


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, text) of every file under a folder that may be source or a manifest."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{py,js,mjs,cjs,ts,mts,cts,tsx,jsx,go,rs,json,txt,toml}").text(path, wholetext=True)
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text")
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def is_test_file(path: Column) -> Column:
    return file_name(path).rlike(TEST_FILE)


def language(path: Column) -> Column:
    lower = F.lower(path)
    return F.when(lower.rlike(PYTHON_SUFFIX), "python").when(lower.rlike(JS_SUFFIX), "javascript")


def ignored(paths: DataFrame, ignore: DataFrame) -> DataFrame:
    """(server_id, path) of files that ignore files leave out: `paths(server_id, path)`.

    `ignore(server_id, pattern)` holds lines of ignore files, with `folder` (of the file, empty for
    the top) and `line` where there is more than one file or a line that begins with `!`. For a
    file, and for each folder above it, the last line that fits decides: lines of deeper ignore files
    come after those above, and `!` takes a path back in. What lies in an ignored folder is ignored.

    Lines are looked up by folder and, where they name one, by file name or ending; only the others
    meet every path below their folder. Only paths are moved, and each folder is looked at once.
    """
    has = lambda name, other: F.col(name) if name in ignore.columns else F.lit(other)
    lines = ignore.select(
        "server_id", F.coalesce(F.regexp_replace(has("folder", ""), r"^\./|^/|/+$", ""), F.lit("")).alias("folder"),
        F.coalesce(has("line", 0), F.lit(0)).alias("line"), F.btrim("pattern").alias("pattern"),
    ).where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    bare = F.regexp_replace(F.regexp_replace("pattern", r"^!", ""), r"/+$", "")
    name, ending = ~bare.rlike(r"[*?\[\\/]"), bare.rlike(r"^\*\.[^*?.\[\\/]+$")
    filed = F.when(name, F.concat(F.lit("="), bare)).when(ending, F.concat(F.lit("."), F.substring_index(bare, ".", -1))).otherwise("")
    lines = lines.select(
        "server_id", "folder", "line", filed.alias("_filed"), F.col("pattern").startswith("!").alias("_back"), F.col("pattern").endswith("/").alias("_folders"),
        G.ignore_regex(F.col("pattern")).alias("_fits"),
    )
    steps = F.split("path", "/")
    places = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.array_join(F.slice(steps, F.lit(1), i), "/").alias("node"), (i < F.size(steps)).alias("is_folder")))
    nodes = paths.select("server_id", "path", F.explode(places).alias("n")).select("server_id", F.col("n.node").alias("node"), F.col("n.is_folder").alias("is_folder")).distinct()
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    last = F.element_at(parts, -1)
    keys = F.array(F.lit(""), F.concat(F.lit("="), last), F.concat(F.lit("."), F.substring_index(last, ".", -1)))
    asked = nodes.select("server_id", "node", "is_folder", F.explode(above).alias("folder"), keys.alias("_keys")).withColumn("_filed", F.explode("_keys")).drop("_keys")
    met = asked.join(lines, ["server_id", "folder", "_filed"])
    inside = F.when(F.col("folder") == "", F.col("node")).otherwise(F.substr("node", F.char_length("folder") + 2))
    hit = met.where(F.rlike(inside, F.col("_fits")) & (~F.col("_folders") | F.col("is_folder")))
    told = hit.groupBy("server_id", "node").agg(F.max_by("_back", F.struct(F.char_length("folder"), "line", "_back")).alias("_back"))
    out = told.where("not _back").select("server_id", "node")
    every = paths.select("server_id", "path", F.explode(F.transform(places, lambda p: p["node"])).alias("node"))
    return every.join(out, ["server_id", "node"], "left_semi").select("server_id", "path").distinct()


def source_files(files: DataFrame, ignore: DataFrame | None = None, limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """The files a scan reads: `files(server_id, path, size, text)` with paths relative to the project.

    `ignore` holds the lines of ignore files, as `ignored` has them. Which paths they leave out is
    worked out on paths alone; texts are joined with that list, by a broadcast as long as it has no
    more than 100,000 rows. Every file is read, unless `limit` or `max_bytes` is set; `left_out`
    lists what they leave out.
    """
    kept = files.withColumn("language", language(F.col("path"))).where(
        F.col("language").isNotNull()
        & ~F.col("path").rlike(SKIPPED_DIRS)
        & ~F.col("path").rlike(r"(?:^|/)\.[^/]*/")
        & ~is_test_file(F.col("path"))
        & ~F.col("path").endswith(".d.ts")
    )
    if max_bytes is not None:
        kept = kept.where(F.col("size") <= max_bytes)
    if ignore is not None:
        kept = kept.join(broadcast_if_small(ignored(kept.select("server_id", "path"), ignore)), ["server_id", "path"], "left_anti")
    if limit is None:
        return kept
    return top_k(kept, ["server_id"], [F.col("path")], limit, ["path"], rank="place").drop("place")


def left_out(files: DataFrame, read: DataFrame) -> DataFrame:
    """(server_id, path, reason) of source files that limits kept from being read."""
    source = files.where(language(F.col("path")).isNotNull()).select("server_id", "path", "size")
    rest = source.join(read.select("server_id", "path"), ["server_id", "path"], "left_anti")
    return rest.select("server_id", "path", F.lit("not read: over the limits of this scan, or not source of the project").alias("reason"))


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def is_minified(text: Column) -> Column:
    """One very long line, long lines on average, or many long lines. Worked out inside the row."""
    lengths = F.transform(split_lines(F.regexp_replace(text, r"\r?\n$", "")), lambda line: F.char_length(line))
    return (text != "") & (
        (F.array_max(lengths) > LONGEST_LINE)
        | (F.char_length(text) / F.size(lengths) > MEAN_LINE)
        | (F.size(F.filter(lengths, lambda n: n > LONG_LINE)) >= LONG_LINES)
    )


SERVER_CONSTRUCTOR = {
    "python": r"\b(?:FastMCP|MCPServer|Server)\s*\(",
    "javascript": r"\bnew\s+(?:McpServer|Server|FastMCP)\s*\(",
}


def server_files(files: DataFrame, first: int | None = None) -> DataFrame:
    """The files that construct a server object; with `first`, so many per project and language."""
    builds = F.lit(False)
    for lang, pattern in SERVER_CONSTRUCTOR.items():
        builds = builds | ((F.col("language") == lang) & F.col("text").rlike(pattern))
    found = files.where(builds)
    if first is None:
        return found
    return top_k(found, ["server_id", "language"], [F.col("path")], first, ["path"], rank="place").drop("place")


# The ways in which Node and Python read one variable by its name; the match ends with the name.
ENV_NAME = "[A-Z][A-Z0-9_]{2,}"
ENV_CALLS = (r"process\.env\[", r"\benviron\[", r"\benviron\.get\(", r"\benviron\.pop\(", r"\benviron\.setdefault\(", r"\bgetenv\(")
ENV_READ = rf"process\.env\.{ENV_NAME}\b|(?:{'|'.join(ENV_CALLS)})\s*['\"]{ENV_NAME}(?=['\"])"


def env_reads(files: DataFrame) -> DataFrame:
    """Environment variables the code reads by name, with the place of the first read."""
    whole = F.regexp_extract_all("text", F.lit(ENV_READ), F.lit(0))
    names = F.transform(whole, lambda m: F.regexp_extract(m, f"{ENV_NAME}$", 0))
    rows = files.select("server_id", "path", F.posexplode(names).alias("pos", "name"))
    return rows.groupBy("server_id", "name").agg(F.min(F.struct("path", "pos")).alias("first"))


def unset_keys(reads: DataFrame, servers: DataFrame) -> DataFrame:
    """Names the code reads that look like keys and were not passed to the server."""
    from riskscan.functions.secrets import is_key_name

    passed = servers.select("server_id", F.explode(F.map_keys("env")).alias("name"))
    return reads.where(is_key_name(F.col("name"))).join(passed, ["server_id", "name"], "left_anti")
