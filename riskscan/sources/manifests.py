"""Packages a server uses: from the launch command and from project files.

`manifests(server_id, file, text)` holds one row per project file. Each parser takes it and
reads the files it knows; everything happens inside the row, so no parser shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.functions import packages as P
from riskscan.schemas import DEPENDENCY_SCHEMA, conform
from riskscan.sources import jsontext as J

LAUNCH = "launch command"
# Package runners, their sub-commands and flags that take a value.
NPM_RUNNERS = ("npx", "bunx", "pnpx")
NPM_MANAGERS = ("pnpm", "yarn", "npm")
NPM_RUN_WORDS = ("dlx", "exec", "x")
NPM_VALUE_FLAGS = ("-p", "--package", "-c", "--call")
PYTHON_VALUE_FLAGS = ("--python", "-p", "--with", "--index-url", "--index", "--spec")
SCRIPT_FILE = r"(?i)^[./\\]|\.(?:js|mjs|cjs|ts|mts|py)$"
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._\-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"
NPM_SECTIONS = ("dependencies", "optionalDependencies", "peerDependencies", "devDependencies")
INSTALL_HOOKS = ("preinstall", "install", "postinstall")


def first_positional(args: Column, value_flags: tuple[str, ...]) -> Column:
    """The first argument that is neither a flag nor the value of one."""
    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("string").alias("found"))

    def step(state: Column, arg: Column) -> Column:
        takes = arg.isin(*value_flags)
        stays = state["found"].isNotNull() | state["skip"] | takes | arg.startswith("-")
        return F.struct(
            (state["found"].isNull() & ~state["skip"] & takes).alias("skip"),
            F.when(stays, state["found"]).otherwise(arg).alias("found"),
        )

    return F.aggregate(args, start, step, lambda s: s["found"])


def _flag_values(args: Column, flags: tuple[str, ...], prefix: str) -> Column:
    return F.array_compact(
        F.transform(
            args,
            lambda a, i: F.when(a.isin(*flags), F.get(args, i + 1)).when(
                a.startswith(prefix), F.regexp_replace(a, "^[^=]*=", "")
            ),
        )
    )


def _dep(name: Column, ecosystem: str, spec: Column, version: Column) -> Column:
    return F.struct(
        name.alias("name"), F.lit(ecosystem).alias("ecosystem"), F.coalesce(spec, F.lit("")).alias("spec"), version.alias("version")
    )


def npm_dependency(text: Column) -> Column:
    """`name@spec`, where a scope may start with @."""
    name = F.regexp_extract(text, "^(.+)@([^@]*)$", 1)
    spec = F.when(name != "", F.regexp_extract(text, "^(.+)@([^@]*)$", 2)).otherwise(F.lit(""))
    return _dep(F.when(name != "", name).otherwise(text), "npm", spec, P.exact_version(spec))


def python_dependency(text: Column) -> Column:
    """A requirement in its usual text form."""
    text = F.btrim(text)
    direct = text.rlike(P.URL_SPEC) | text.contains(" @ ")
    url_name = F.when(text.contains(" @ "), F.btrim(F.substring_index(text, " @ ", 1))).otherwise(text)
    name = F.regexp_extract(text, REQUIREMENT, 1)
    spec = F.btrim(F.substring_index(F.regexp_extract(text, REQUIREMENT, 2), ";", 1))
    exact = F.when(spec.startswith("==") & ~spec.contains("*"), F.btrim(F.regexp_replace(spec, "^==", "")))
    return (
        F.when(direct, _dep(url_name, "pypi", text, F.lit(None).cast("string")))
        .when(name != "", _dep(name, "pypi", spec, exact))
        .otherwise(_dep(text, "pypi", F.lit(""), F.lit(None).cast("string")))
    )


def launch_packages(servers: DataFrame) -> DataFrame:
    """Packages that a launch command downloads and runs."""
    base, args = P.command_basename(F.col("command")), F.col("args")
    manager = base.isin(*NPM_MANAGERS) & F.coalesce(F.get(args, F.lit(0)).isin(*NPM_RUN_WORDS), F.lit(False))
    rest = F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0)))
    pipx = (base == "pipx") & F.coalesce(F.get(args, F.lit(0)) == "run", F.lit(False))
    rows = servers.where((F.col("transport") == "stdio") & F.col("command").isNotNull()).select(
        "server_id",
        F.when(base.isin(*NPM_RUNNERS) | manager, "npm").when((base == "uvx") | pipx, "pypi").alias("runner"),
        F.when(manager | pipx, rest).otherwise(args).alias("args"),
    )
    named = _flag_values(F.col("args"), ("-p", "--package"), "--package=")
    first = first_positional(F.col("args"), NPM_VALUE_FLAGS)
    npm = F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(F.when(~first.rlike(SCRIPT_FILE), first))))
    source = F.slice(_flag_values(F.col("args"), ("--from",), "--from="), F.lit(1), F.lit(1))
    python = F.when(F.size(source) > 0, source).otherwise(
        F.array_compact(F.array(first_positional(F.col("args"), PYTHON_VALUE_FLAGS)))
    )
    deps = F.when(F.col("runner") == "npm", F.transform(npm, npm_dependency)).when(
        F.col("runner") == "pypi", F.transform(python, python_dependency)
    )
    found = rows.where(F.col("runner").isNotNull()).select("server_id", F.explode(deps).alias("d"))
    return conform(
        found.select("server_id", "d.*", F.lit(LAUNCH).alias("source"), F.lit(True).alias("direct")), DEPENDENCY_SCHEMA
    )


def _name_is(pattern: str) -> Column:
    return F.regexp_extract("file", "[^/]*$", 0).rlike(pattern)


def line_of_text(text: Column, needle: Column) -> Column:
    """One-based line of the first occurrence of `needle`; null when it does not occur."""
    at = F.position(needle, text)
    before = F.left(text, at - 1)
    return F.when(at > 0, (F.char_length(before) - F.char_length(F.translate(before, "\n", "")) + 1).cast("int"))


def _finish(rows: DataFrame) -> DataFrame:
    return conform(rows, DEPENDENCY_SCHEMA)


def requirements(manifests: DataFrame) -> DataFrame:
    """requirements*.txt, one row per requirement line."""
    lines = manifests.where(_name_is(r"^requirements.*\.txt$")).select(
        "server_id", "file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")
    )
    line = F.btrim(F.substring_index("raw", " #", 1))
    lines = lines.withColumn("line_text", line).where((line != "") & ~line.rlike(r"^(?:#|-r|-c|--|-e \.)"))
    dep = python_dependency(F.regexp_replace("line_text", r"^-e\s+", ""))
    return _finish(
        lines.withColumn("d", dep).select(
            "server_id", "d.*", F.col("file").alias("source"), F.lit(True).alias("direct"), (F.col("pos") + 1).alias("line")
        )
    )


QUOTED = r"\"([^\"\n]*)\"|'([^'\n]*)'"
LIST_BODY = r"((?:[^\]\"']|\"[^\"]*\"|'[^']*')*+)"


def _section(text: Column, name: str) -> Column:
    """The lines below a [section] header, up to the next header."""
    return F.regexp_extract(text, rf"(?sm)^\[{name}\]\s*$(.*?)(?=^\[|\z)", 1)


def _quoted(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(rf"({QUOTED})"), F.lit(1)), lambda q: F.substr(q, F.lit(2), F.char_length(q) - 2)
    )


def pyproject(manifests: DataFrame) -> DataFrame:
    """pyproject.toml: project dependencies, optional groups, and the poetry table."""
    text = F.col("text")
    files = manifests.where(_name_is(r"^pyproject\.toml$"))
    listed = F.regexp_extract(_section(text, "project"), rf"(?sm)^dependencies\s*=\s*\[{LIST_BODY}\]", 1)
    groups = F.array_join(
        F.regexp_extract_all(_section(text, r"project\.optional-dependencies"), F.lit(rf"(?s)=\s*\[{LIST_BODY}\]")), "\n"
    )
    plain = files.select("server_id", "file", "text", F.explode(F.concat(_quoted(listed), _quoted(groups))).alias("entry"))
    plain = plain.select(
        "server_id", "file", python_dependency(F.col("entry")).alias("d"), line_of_text(text, F.col("entry")).alias("line")
    )
    pattern = r"(?m)^[ \t]*([\"']?[A-Za-z0-9][A-Za-z0-9._\-]*[\"']?[ \t]*=[ \t]*(?:\"[^\"\n]*\"|'[^'\n]*'|\{[^}]*\}))"
    lines = files.select(
        "server_id", "file", "text",
        F.explode(F.regexp_extract_all(_section(text, r"tool\.poetry\.dependencies"), F.lit(pattern))).alias("raw"),
    )
    name = F.regexp_extract("raw", r"^[\"']?([A-Za-z0-9._\-]+)", 1)
    value = F.btrim(F.regexp_replace("raw", r"^[^=]*=", ""))
    inline = lambda key: F.nullif(F.regexp_extract(value, rf"\b{key}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    is_table = value.startswith("{")
    spec = F.btrim(
        F.when(is_table, F.coalesce(inline("version"), inline("git"), F.lit(""))).otherwise(F.btrim(value, F.lit("\"'")))
    )
    spec = F.when(spec.isin("", "*"), "").when(spec.rlike(r"^\d+(?:\.\d+)*$"), F.concat(F.lit("=="), spec)).otherwise(spec)
    link = F.when(is_table, F.coalesce(inline("git"), inline("url")))
    poetry = lines.where(F.lower(name) != "python").select(
        "server_id", "file", python_dependency(F.concat(name, spec)).alias("d0"), link.alias("link"),
        line_of_text(text, name).alias("line"), name.alias("dep"),
    )
    poetry = poetry.select(
        "server_id", "file", "line",
        F.when(F.col("link").isNotNull(), _dep(F.col("dep"), "pypi", F.col("link"), F.lit(None).cast("string")))
        .otherwise(F.col("d0"))
        .alias("d"),
    )
    both = plain.unionByName(poetry.select("server_id", "file", "d", "line"))
    return _finish(both.select("server_id", "d.*", F.col("file").alias("source"), F.lit(True).alias("direct"), "line"))


def package_json(manifests: DataFrame) -> DataFrame:
    """package.json: the four dependency sections."""
    files = manifests.where(_name_is(r"^package\.json$")).withColumn("v", F.try_parse_json("text"))
    sections = F.concat(*[J.members_at(F.col("v"), f"$.{s}") for s in NPM_SECTIONS])
    rows = files.select("server_id", "file", "text", F.explode(sections).alias("m"))
    spec = J.any_text_at(F.col("m.value"), "$")
    return _finish(
        rows.select(
            "server_id", F.col("m.key").alias("name"), F.lit("npm").alias("ecosystem"), F.col("file").alias("source"),
            F.coalesce(spec, F.lit("")).alias("spec"), P.exact_version(spec).alias("version"), F.lit(True).alias("direct"),
            line_of_text(F.col("text"), F.concat(F.lit('"'), F.col("m.key"), F.lit('"'))).alias("line"),
        )
    )


def lock_packages(manifests: DataFrame) -> DataFrame:
    """package-lock.json: (server_id, source, name, version, top_level)."""
    files = manifests.where(_name_is(r"^package-lock\.json$")).withColumn("v", F.try_parse_json("text"))
    rows = files.select("server_id", "file", F.explode(J.members_at(F.col("v"), "$.packages")).alias("m"))
    rows = rows.where(F.col("m.key").contains("node_modules/") & J.is_object(F.col("m.value")))
    name = F.substring_index("m.key", "node_modules/", -1)
    return rows.select(
        "server_id", F.col("file").alias("source"), name.alias("name"), J.text_at(F.col("m.value"), "$.version").alias("version"),
        (F.col("m.key") == F.concat(F.lit("node_modules/"), name)).alias("top_level"),
    )


def fill_from_lock(direct: DataFrame, lock: DataFrame) -> DataFrame:
    """Direct npm packages without a version take the locked one; other locked packages are indirect."""
    top = lock.where("top_level").groupBy("server_id", "name").agg(
        F.min_by("version", "source").alias("locked")
    )
    npm = F.col("ecosystem") == "npm"
    filled = direct.join(top, ["server_id", "name"], "left").withColumn(
        "version", F.when(npm, F.coalesce("version", "locked")).otherwise(F.col("version"))
    )
    named = direct.where(npm).select("server_id", "name", F.lit(True).alias("_direct")).distinct()
    rest = lock.join(named, ["server_id", "name"], "left").where(~(F.col("top_level") & F.coalesce("_direct", F.lit(False))))
    indirect = rest.select(
        "server_id", "name", F.lit("npm").alias("ecosystem"), "source", F.coalesce("version", F.lit("")).alias("spec"),
        "version", F.lit(False).alias("direct"),
    )
    return conform(filled, DEPENDENCY_SCHEMA).unionByName(conform(indirect, DEPENDENCY_SCHEMA))


def install_scripts(manifests: DataFrame) -> DataFrame:
    """Install hooks of package.json, and setup.py files that replace the install step."""
    files = manifests.where(_name_is(r"^package\.json$")).withColumn("v", F.try_parse_json("text"))
    hooks = F.array_compact(
        F.array(
            *[
                F.when(
                    J.text_at(F.col("v"), f"$.scripts.{h}").isNotNull(),
                    F.struct(F.lit(h).alias("hook"), J.text_at(F.col("v"), f"$.scripts.{h}").alias("command")),
                )
                for h in INSTALL_HOOKS
            ]
        )
    )
    npm = files.select("server_id", "file", F.explode(hooks).alias("h")).select("server_id", "file", "h.hook", "h.command")
    setup = manifests.where(
        _name_is(r"^setup\.py$") & F.col("text").contains("cmdclass") & F.col("text").rlike(r"\binstall\b")
    ).select("server_id", "file", F.lit("cmdclass").alias("hook"), F.lit("setup.py replaces the install step").alias("command"))
    return npm.unionByName(setup)


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """JSON project files that cannot be read."""
    json_files = manifests.where(_name_is(r"^package(?:-lock)?\.json$") & F.try_parse_json("text").isNull())
    return json_files.select(
        "server_id", F.lit("dependencies").alias("stage"), F.concat("file", F.lit(": could not read")).alias("message")
    )


def dependencies(servers: DataFrame | None, manifests: DataFrame | None) -> DataFrame:
    """All packages of all servers, with versions filled from lock files."""
    parts = [] if servers is None else [launch_packages(servers)]
    if manifests is None:
        return parts[0]
    parts += [requirements(manifests), pyproject(manifests), package_json(manifests)]
    return fill_from_lock(reduce(DataFrame.unionByName, parts), lock_packages(manifests))


# Project files, and top-level folders that are not projects of their own.
MANIFEST_NAMES = ("package.json", "pyproject.toml", "requirements.txt", "setup.py")
NOT_PROJECTS = ("node_modules", "tests", "test", "docs", "examples", "dist", "build", "vendor", "__pycache__")


def dependency_roots(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """Folders whose project files belong to a server: (server_id, repo, root).

    `listing(repo, path)` names every file; `sources(server_id, repo, folder)` the folder the
    code is in. Roots are that folder, its parent when it is a build or source folder, the
    repository itself, and top-level folders with a project file of their own.
    """
    own = sources.select("server_id", "repo", F.col("folder").alias("root"))
    is_inner = F.regexp_extract("folder", "[^/]*$", 0).isin("src", "lib", "dist", "build")
    parent = sources.where(is_inner).select(
        "server_id", "repo", F.regexp_replace("folder", "/?[^/]*$", "").alias("root")
    )
    whole = sources.select("server_id", "repo", F.lit("").alias("root"))
    top = F.regexp_extract("path", "^([^/]+)/([^/]+)$", 1)
    name = F.regexp_extract("path", "^([^/]+)/([^/]+)$", 2)
    projects = listing.where(
        name.isin(*MANIFEST_NAMES) & ~top.startswith(".") & ~top.isin(*NOT_PROJECTS)
    ).select("repo", top.alias("root")).distinct()
    shipped = sources.select("server_id", "repo").join(projects, "repo").select("server_id", "repo", "root")
    return own.unionByName(parent).unionByName(whole).unionByName(shipped).dropDuplicates(["server_id", "repo", "root"])
