"""Earlier reports from elsewhere: cleaning, matching, grouping. They never enter the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.functions import urls as U
from riskscan.functions.packages import command_basename
from riskscan.operators.skew import top_k
from riskscan.schemas import SERVER_SCHEMA, conform
from riskscan.sources.manifests import NPM_RUNNERS

# Grades of these reports that are written differently.
GRADES = {"S": "A", "I": "?"}
SEVERITY_ORDER = ("critical", "high", "medium", "low", "info")
REPORT_SCHEMA = (
    "source_url string, npm_package string, grade string, risk_score double, version string, scan_date string, "
    "tool_names array<string>, findings array<struct<severity:string,title:string,description:string,tool_name:string>>, "
    "summary map<string,int>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)


def clean(text: Column, limit: int | None = None, hidden_words: str | None = None) -> Column:
    """Plain dashes, no sentences with unwanted words; cut only if a limit is given."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(" — "), F.lit(": "))
    plain = F.translate(plain, "—–", "--")
    if hidden_words:
        # Only tried where a sentence begins (or the last match ended): the time grows with the length, without dots too.
        plain = F.regexp_replace(plain, rf"(?i)(?:\G|(?<=\.))[^.]*\b(?:{hidden_words})[^.]*\.?\s*", "")
    return F.btrim(plain) if limit is None else F.left(F.btrim(plain), F.lit(limit))


def title(text: Column) -> Column:
    """Upper-case identifiers as a sentence; other titles as they are."""
    words = F.btrim(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" ")))
    shouted = (words == F.upper(words)) & (words != F.lower(words))
    return F.when(shouted, F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2))))).otherwise(words)


def cleaned_reports(reports: DataFrame) -> DataFrame:
    """Reports in our terms."""
    mapped = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    grade = F.coalesce("grade", F.lit("?"))
    findings = F.transform(
        F.coalesce("findings", F.array().cast("array<struct<severity:string,title:string,description:string,tool_name:string>>")),
        lambda f: F.struct(
            F.lower(F.coalesce(f["severity"], F.lit("info"))).alias("severity"),
            F.coalesce(F.nullif(clean(title(f["title"])), F.lit("")), F.lit("Finding")).alias("title"),
            clean(f["description"]).alias("description"),
            F.nullif(f["tool_name"], F.lit("")).alias("tool"),
        ),
    )
    return reports.select(
        "source_url", "npm_package", U.repository_key(F.col("source_url")).alias("repo_key"),
        F.coalesce(F.try_element_at(mapped, grade), grade).alias("grade"),
        F.coalesce("risk_score", F.lit(0.0)).alias("score"), clean(F.col("version")).alias("version"),
        F.left(F.coalesce("scan_date", F.lit("")), F.lit(10)).alias("scanned_at"),
        F.coalesce("tool_names", F.array().cast("array<string>")).alias("tools"),
        findings.alias("findings"), F.col("summary").alias("severity_counts"),
    )


def lookup_keys(servers: DataFrame) -> DataFrame:
    """What a server may be listed under: (server_id, repo_key, package, names).

    Only repositories on the big public host count, and only packages that are launched.
    """
    from riskscan.sources.manifests import launch_packages

    servers = conform(servers, SERVER_SCHEMA)
    repo = U.repository_key(F.col("repo_url"))
    repo = F.when(repo.startswith("github.com/"), repo)
    launched = launch_packages(servers.where(F.col("repo_url").isNull() & command_basename(F.col("command")).isin(*NPM_RUNNERS)))
    package = launched.where(F.col("ecosystem") == "npm").groupBy("server_id").agg(F.min("name").alias("package"))
    joined = servers.select("server_id", repo.alias("repo_key")).join(package, "server_id", "left")
    part = lambda i: F.get(F.split("repo_key", "/"), F.lit(i))
    scope = F.regexp_extract("package", "^@([^/]+)/", 1)
    bare = F.regexp_replace("package", "^@[^/]+/", "")
    names = F.array_distinct(
        F.array_compact(
            F.array(
                U.kebab(part(2)), U.kebab(F.concat_ws("-", part(1), F.when(part(2).isNotNull(), part(2)))), U.kebab(bare),
                F.when(scope != "", U.kebab(F.concat_ws("-", scope, bare))),
            )
        )
    )
    return joined.withColumn("names", F.filter(names, lambda n: n != ""))


def match_reports(servers: DataFrame, reports: DataFrame, results: DataFrame) -> DataFrame:
    """The earlier report of each incomplete or empty result, matched exactly by repository or package.

    `results(server_id, status, all_findings)`; `reports` are cleaned. Two equi-joins; the
    repository match wins.
    """
    needs = results.where((F.col("status") != "completed") | (F.col("all_findings") == 0)).select("server_id")
    keys = lookup_keys(servers).join(needs, "server_id", "left_semi")
    packed = F.struct(*[F.col(c) for c in reports.columns])
    by_repo = reports.where(F.col("repo_key").isNotNull()).groupBy("repo_key").agg(F.max_by(packed, "scanned_at").alias("by_repo"))
    by_package = reports.where(F.col("npm_package").isNotNull()).groupBy(F.col("npm_package").alias("package")).agg(
        F.max_by(packed, "scanned_at").alias("by_package")
    )
    joined = keys.join(by_repo, "repo_key", "left").join(by_package, "package", "left")
    return joined.select("server_id", F.coalesce("by_repo", "by_package").alias("report")).where(F.col("report").isNotNull())


def grouped_findings(rows: DataFrame, key: str = "server_id") -> DataFrame:
    """Findings of reports by severity and title: count, up to five tools, first description.

    `rows(key, pos, severity, title, description, tool)`; info items are only counted.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    own = rows.where(F.col("severity") != "info").withColumn("place", F.when(rank > 0, rank - 1).otherwise(F.lit(5)))
    groups = own.groupBy(key, "severity", "place", "title").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("description", "pos").alias("description")
    )
    used = own.where(F.col("tool").isNotNull()).select(key, "severity", "title", "tool").distinct()
    few = top_k(used, [key, "severity", "title"], [F.col("tool")], 5, ["tool"]).groupBy(key, "severity", "title").agg(
        F.array_join(F.sort_array(F.collect_list("tool")), ", ").alias("tools")
    )
    joined = groups.join(few, [key, "severity", "title"], "left").withColumn("tools", F.coalesce("tools", F.lit("")))
    return joined.orderBy(key, "place", F.col("count").desc(), "title")


def info_counts(rows: DataFrame, key: str = "server_id") -> DataFrame:
    return rows.where(F.col("severity") == "info").groupBy(key).agg(F.count(F.lit(1)).alias("info"))
