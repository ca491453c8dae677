"""Text rules written by users, as rows: validation, replacement, matching."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.functions import globs as G
from riskscan.functions import levels as L
from riskscan.functions import text as TX
from riskscan.operators.match import sql_text
from riskscan.schemas import CANDIDATE_SCHEMA, CATEGORIES, SURFACE_KINDS, conform, evidence

RULE_ID = r"^[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+$"
KNOWN_KEYS = {
    "id", "title", "severity", "category", "confidence", "description", "why_it_matters", "recommendation", "references",
    "malicious", "match",
}
KNOWN_MATCH_KEYS = {"pattern", "patterns", "surfaces", "tool_name", "case_sensitive"}

@dataclass(frozen=True)
class UserRule:
    id: str
    title: str
    severity: str
    patterns: tuple[str, ...]
    category: str = "quality"
    confidence: str = "medium"
    description: str = ""
    surfaces: tuple[str, ...] = ()
    tool_name: str | None = None
    case_sensitive: bool = False
    malicious: bool = False
    origin: str = field(default="user", compare=False)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule files in JSON, one rule or a list under `rules` per file: (load_seq, origin, pos, rule VARIANT)."""
    from riskscan.sources import jsontext as J

    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("origin"), J.parse(F.col("value")).alias("v")
    )
    listed = F.when(J.is_array(F.try_variant_get("v", "$.rules", "variant")), J.items_at(F.col("v"), "$.rules")).otherwise(F.array("v"))
    return files.select("origin", F.posexplode(listed).alias("pos", "rule"))


def rule_problems(rules: DataFrame) -> DataFrame:
    """Rules with the list of what is wrong with them; usable rules have an empty list."""
    from riskscan.sources import jsontext as J

    rule = F.col("rule")
    t = lambda path: J.text_at(rule, path)
    keys = lambda path: F.transform(J.members_at(rule, path), lambda m: m["key"])
    unknown = lambda have, allowed: F.array_except(have, F.array(*[F.lit(k) for k in sorted(allowed)]))
    patterns = F.array_compact(F.concat(F.array(t("$.match.pattern")), F.transform(J.items_at(rule, "$.match.patterns"), lambda p: J.text_at(p, "$"))))
    surfaces = F.transform(J.items_at(rule, "$.match.surfaces"), lambda s: J.text_at(s, "$"))
    bad_surfaces = unknown(surfaces, SURFACE_KINDS)
    listing = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))
    fine = lambda value, allowed: value.isNull() | value.isin(*allowed)
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(t("$.id").rlike(RULE_ID), F.lit(False)), F.lit("id must look like 'CUSTOM-001' (capital letters, digits, dashes)")),
            F.when(t("$.title").isNull(), F.lit("title is missing")),
            F.when(~F.coalesce(t("$.severity").isin(*L.SEVERITIES), F.lit(False)), F.lit("severity is unknown")),
            F.when(~fine(t("$.confidence"), L.CONFIDENCES), F.lit("confidence is unknown")),
            F.when(~fine(t("$.category"), CATEGORIES), F.lit("category is unknown")),
            F.when(~J.is_object(F.try_variant_get(rule, "$.match", "variant")), F.lit("match is missing"))
            .when(F.size(patterns) == 0, F.lit("match has no pattern")),
            listing("unknown keys: ", unknown(keys("$"), KNOWN_KEYS)),
            listing("unknown match keys: ", unknown(keys("$.match"), KNOWN_MATCH_KEYS)),
            listing("unknown surface kinds: ", bad_surfaces),
        )
    )
    return rules.select(
        "origin", "pos", t("$.id").alias("id"), t("$.title").alias("title"), t("$.severity").alias("severity"),
        F.coalesce(t("$.category"), F.lit("quality")).alias("category"),
        F.coalesce(t("$.confidence"), F.lit("medium")).alias("confidence"),
        F.coalesce(t("$.description"), F.lit("")).alias("description"),
        F.coalesce(F.try_variant_get(rule, "$.malicious", "boolean"), F.lit(False)).alias("malicious"),
        patterns.alias("patterns"), surfaces.alias("surfaces"), t("$.match.tool_name").alias("tool_name"),
        F.coalesce(F.try_variant_get(rule, "$.match.case_sensitive", "boolean"), F.lit(False)).alias("case_sensitive"),
        problems.alias("problems"),
    )


def usable_rules(checked: DataFrame) -> tuple[list[UserRule], DataFrame]:
    """Rules ready to run and a table of those that are not.

    Rules are configuration, so they come to the driver: one row per rule a person wrote.
    All regular expressions are tried in one job on an empty input; only if that fails is each
    tried alone, so one broken rule stops nobody else.
    """
    spark = checked.sparkSession
    errors = [(r.id, "; ".join(r.problems)) for r in checked.where(F.size("problems") > 0).collect()]
    good: dict[str, UserRule] = {}
    rows = checked.where(F.size("problems") == 0).orderBy("origin", "pos").collect()
    every = {p for r in rows for p in [*r.patterns, *([r.tool_name] if r.tool_name else [])]}
    fine = compiles(spark, *every) if every else True
    for r in rows:
        rule = UserRule(
            r.id, r.title, r.severity, tuple(r.patterns), r.category, r.confidence, r.description, tuple(r.surfaces),
            r.tool_name, r.case_sensitive, r.malicious, r.origin,
        )
        bad = [p for p in [*rule.patterns, *([rule.tool_name] if rule.tool_name else [])] if not fine and not compiles(spark, p)]
        if bad:
            errors.append((rule.id, f"invalid regular expression: {bad[0]}"))
        else:
            good[rule.id] = rule  # a later rule with the same id replaces an earlier one
    table = spark.createDataFrame(errors, "id string, message string")
    return list(good.values()), table


def compiles(spark: SparkSession, *patterns: str) -> bool:
    """Does the JVM accept these regular expressions?"""
    from pyspark.errors import PySparkException

    try:
        spark.range(1).select(*[F.lit("").rlike(p) for p in patterns]).collect()
    except (PySparkException, Py4JError):
        return False
    return True


def user_candidates(surfaces: DataFrame, rules: Sequence[UserRule]) -> DataFrame:
    """Candidates of user rules. Rules become literal patterns of one projection over the surfaces.

    The first pattern of a rule that matches a text counts. No join is involved, and each
    literal pattern is compiled once per task.
    """
    rules = [r for r in rules if r.patterns]
    if not rules:
        return conform(surfaces.limit(0).select("server_id", "seq"), CANDIDATE_SCHEMA)
    scan = surfaces.where(F.col("text") != "").withColumn("norm", TX.normalize(F.col("text")))
    flag = lambda r: "(?m)" if r.case_sensitive else "(?im)"
    pairs = []
    for i, r in enumerate(rules):
        scope = []
        if r.surfaces:
            scope.append(f"kind in ({', '.join(sql_text(s) for s in r.surfaces)})")
        if r.tool_name:
            scope.append(f"target_name rlike {sql_text(r.tool_name)}")
        tests = " ".join(f"when norm rlike {sql_text(flag(r) + p)} then {j}" for j, p in enumerate(r.patterns))
        if not tests:
            continue
        found = f"case {tests} end"
        guarded = f"case when {' and '.join(scope)} then {found} end" if scope else found
        pairs.append(f"named_struct('rule', {i}, 'pattern', {guarded})")
    hits = scan.withColumn("hit", F.explode(F.expr(f"filter(array({', '.join(pairs)}), h -> h.pattern is not null)")))
    splits = " ".join(
        f"when hit.rule = {i} and hit.pattern = {j} then split(norm, {sql_text(flag(r) + p)}, 2)"
        for i, r in enumerate(rules)
        for j, p in enumerate(r.patterns)
    )
    hits = hits.withColumn("parts", F.expr(f"case {splits} end"))
    before, after = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    hits = hits.withColumn("before", before).withColumn("after", after)
    hits = hits.withColumn("matched", TX.matched_text(F.col("norm"), F.col("before"), F.col("after")))
    args = (F.col("before"), F.col("matched"), F.col("after"))

    def fixed(values: Iterable) -> Column:
        texts = ", ".join(sql_text(v) if isinstance(v, str) else str(v).lower() for v in values)
        return F.expr(f"element_at(array({texts}), hit.rule + 1)")

    flat = [f"{i}:{j}" for i, r in enumerate(rules) for j in range(len(r.patterns))]
    patterns = F.create_map(*[F.lit(x) for k, r_p in zip(flat, [p for r in rules for p in r.patterns], strict=True) for x in (k, r_p)])
    shown = F.element_at(patterns, F.concat_ws(":", F.col("hit.rule").cast("string"), F.col("hit.pattern").cast("string")))
    rows = hits.select(
        "server_id", "seq", fixed(r.id for r in rules).alias("rule_id"), fixed(r.title for r in rules).alias("title"),
        fixed(r.severity for r in rules).alias("severity"),
        F.when(TX.looks_defensive(*args), "low").otherwise(fixed(r.confidence for r in rules)).alias("confidence"),
        fixed(r.category for r in rules).alias("category"),
        fixed(r.description or f"Custom rule {r.id} matched." for r in rules).alias("description"),
        F.array(evidence("text-match", F.col("location"), TX.excerpt(*args), F.concat(F.lit("pattern "), shown))).alias("evidence"),
        "target_kind", "target_name", F.lit(False).alias("confirmed"), fixed(r.malicious for r in rules).alias("malicious"),
        F.right("before", F.lit(TX.PAD)).alias("context_text"),
    )
    return conform(rows, CANDIDATE_SCHEMA)


def select_rules(rules: DataFrame, enabled: Sequence[str] = (), disabled: Sequence[str] = ()) -> DataFrame:
    """Rules (rule_id, ...) chosen by exact id, glob or prefix; `enabled` first, then `disabled`."""
    chosen = rules.where(G.rule_matches(F.col("rule_id"), enabled)) if enabled else rules
    return chosen.where(~G.rule_matches(F.col("rule_id"), disabled)) if disabled else chosen


def chosen_ids(ids: Iterable[str], enabled: Sequence[str] = (), disabled: Sequence[str] = ()) -> list[str]:
    """The same choice for rule ids at hand when a plan is built."""

    def named(rule_id: str, patterns: Sequence[str]) -> bool:
        up = rule_id.upper()
        cleaned = [p.strip().upper() for p in patterns if p.strip()]
        return any(re.match(G.glob_regex(p), up) or up.startswith(p.rstrip("-") + "-") for p in cleaned)

    kept = sorted(i for i in ids if (not enabled or named(i, enabled)) and not named(i, disabled))
    if enabled and not kept:
        raise ValueError(f"no rule matches: {', '.join(enabled)}")
    return kept


def merge_rules(rules: DataFrame) -> DataFrame:
    """One row per rule id: the one loaded last (`load_seq`)."""
    rest = F.struct(*[c for c in rules.columns if c != "rule_id"])
    return rules.groupBy("rule_id").agg(F.max_by(rest, "load_seq").alias("r")).select("rule_id", "r.*")
