"""Suppressions from tables, matched through an index of their fixed parts.

A glob's fixed beginning, end, or inner part must stand in whatever it matches. Each suppression is
filed under the one of its fixed parts that the fewest other suppressions have; a finding looks up
the parts it has of the kinds that are in use. The join is one on equal keys, the globs themselves
are tested on what meets there. Only a suppression without any fixed part meets every finding.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.functions import globs as G
from riskscan.operators.skew import broadcast_if_small, is_small, written

#: Lengths of fixed beginnings and ends that are filed, longest first, and of inner parts.
LENGTHS, INNER = (16, 8, 4, 2), 4
WILD = r"[*?\[]"
#: Names under which findings that meet no suppression are dealt out.
SPARE = 1024
TRIPLE = ("rule_id", "server_id", "target_name")


def _entry(kind: str, key: Column, when: Column, rank: int) -> Column:
    return F.when(when, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key")))


def file_keys(rule: Column, server: Column, target: Column) -> Column:
    """Every (rank, kind, key) that what a suppression matches is sure to have."""
    found = []
    for place, (name, glob) in enumerate((("target", target), ("server", server))):
        wild = glob.rlike(WILD)
        head, tail = F.regexp_extract(glob, r"^([^*?\[]*)", 1), F.regexp_extract(glob, r"([^*?\[\]]*)$", 1)
        inner = F.array_max(F.transform(F.split(glob, r"[*?]"), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
        found.append(_entry(f"{name}=", glob, ~wild, place))
        for i, n in enumerate(LENGTHS):
            found.append(_entry(f"{name}^{n}", F.left(head, F.lit(n)), wild & (F.char_length(head) >= n), 10 + 2 * i + place))
            found.append(_entry(f"{name}${n}", F.right(tail, F.lit(n)), wild & (F.char_length(tail) >= n), 10 + 2 * i + place))
        plain = wild & ~glob.contains("[") & (F.char_length(inner) >= INNER)
        found.append(_entry(f"{name}~", F.left(inner, F.lit(INNER)), plain, 30 + place))
    pattern = F.upper(F.btrim(rule))
    found.append(_entry("rule=", F.rtrim(pattern, F.lit("-")), ~pattern.rlike(WILD), 5))
    found.append(_entry("*", F.lit(""), F.lit(True), 99))
    return F.array_compact(F.array(*found))


def look_up_keys(rule: Column, server: Column, target: Column, kinds: set[str]) -> Column:
    """The (kind, key) pairs a finding looks up, of the kinds in use."""
    found = []
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    for name, value in (("target", target), ("server", server)):
        if f"{name}=" in kinds:
            found.append(F.array(pair(f"{name}=", value)))
        for n in LENGTHS:
            long = F.char_length(value) >= n
            if f"{name}^{n}" in kinds:
                found.append(F.array(F.when(long, pair(f"{name}^{n}", F.left(value, F.lit(n))))))
            if f"{name}${n}" in kinds:
                found.append(F.array(F.when(long, pair(f"{name}${n}", F.right(value, F.lit(n))))))
        if f"{name}~" in kinds:
            starts = F.when(F.char_length(value) >= INNER, F.sequence(F.lit(1), F.char_length(value) - INNER + 1))
            found.append(F.transform(starts, lambda i: pair(f"{name}~", F.substr(value, i, F.lit(INNER)))))
    if "rule=" in kinds:
        # A pattern names a rule or the part of its id before a dash.
        parts = F.split(F.upper(rule), "-")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.rtrim(F.array_join(F.slice(parts, F.lit(1), i), "-"), F.lit("-")))
        found.append(F.transform(heads, lambda h: pair("rule=", h)))
    if "*" in kinds:
        found.append(F.array(pair("*", F.lit(""))))
    empty = F.array().cast("array<struct<kind:string,key:string>>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(f, empty) for f in found]))) if found else empty


def index(suppressions: DataFrame) -> DataFrame:
    """The suppressions (order, ...) with the kind and key they are filed under: the rarest of their parts."""
    own = suppressions.withColumn("_keys", file_keys(F.col("rule"), F.col("server"), F.col("target")))
    parts = own.select("order", F.explode("_keys").alias("k")).select("order", "k.*")
    often = parts.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    best = parts.join(often, ["kind", "key"]).groupBy("order").agg(F.min_by(F.struct("kind", "key"), F.struct("n", "rank", "kind", "key")).alias("b"))
    return own.drop("_keys").join(best.select("order", F.col("b.kind").alias("kind"), F.col("b.key").alias("key")), "order")


def _test(glob: Column) -> Column:
    """How a glob is tested: any (0), equal (1), begins with (2), ends with (3), by its expression (4)."""
    how = F.when(glob == "*", 0).when(~glob.rlike(WILD), 1).when(glob.rlike(r"^[^*?\[]*\*$"), 2).when(glob.rlike(r"^\*[^*?\[]*$"), 3).otherwise(4)
    return F.struct(how.alias("how"), F.when(how < 4, F.btrim(glob, F.lit("*"))).alias("fixed"), F.when(how == 4, G.glob_regex_of(glob)).alias("regex"))


def suppress(findings: DataFrame, suppressions: DataFrame, today: date) -> DataFrame:
    """`findings.suppress` for suppressions in a table: (order, rule, server, target, reason, expires).

    They apply by `order`, which tells them apart. The first unexpired match wins; expired ones
    before it leave a note. Nulls in server or target stand for any, in `expires` for never; a null
    or empty rule matches nothing. Suppressions with equal rule, server and target are matched once,
    and findings that meet the same of them share their notes.
    """
    any_ = lambda name: F.coalesce(name, F.lit("*"))
    wanted = suppressions.select("order", "rule", any_("server").alias("server"), any_("target").alias("target"), F.coalesce("reason", F.lit("")).alias("reason"), "expires")
    wanted = wanted.where(F.btrim(F.coalesce("rule", F.lit(""))) != "")
    # Suppressions with equal globs are one class: what meets grows with the classes, not with their copies.
    globs = ["_pattern", "server", "target"]
    wanted = wanted.withColumn("_pattern", F.upper(F.btrim("rule")))
    named = written(wanted.groupBy(*globs).agg(F.min("rule").alias("rule")).withColumn("_class", F.monotonically_increasing_id()))
    live = F.col("expires").isNull() | (F.col("expires") >= F.lit(today))
    ended = F.concat(F.lit("No longer suppressed, this ended on "), F.date_format("expires", "yyyy-MM-dd"), F.lit(" and has expired: "), F.col("reason"))
    members = wanted.select(*globs, "order", live.alias("live"), F.when(live, F.concat(F.lit("Suppressed: "), F.col("reason"))).otherwise(ended).alias("note"))
    members = written(members.join(named.drop("rule"), globs).drop(*globs))
    classes = named.join(members.groupBy("_class").agg(F.min(F.when(F.col("live"), F.col("order"))).alias("_live")), "_class")
    # What has to be tested is worked out once per class, not once per pair.
    classes = classes.withColumn("_head", F.concat(F.rtrim("_pattern", F.lit("-")), F.lit("-"))).withColumn("order", F.col("_class"))
    classes = classes.select("*", _test(F.col("server")).alias("_server"), _test(F.col("target")).alias("_target"), _test(F.col("_pattern")).alias("_rule"))
    filed = written(index(classes))
    kinds = {r["kind"] for r in filed.select("kind").distinct().collect()}
    triples = findings.select(*TRIPLE).distinct()
    asked = triples.withColumn("_k", F.explode(look_up_keys(F.col("rule_id"), F.col("server_id"), F.col("target_name"), kinds)))
    asked = asked.select(*TRIPLE, F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"))
    met = asked.join(broadcast_if_small(filed), ["kind", "key"])
    fits = lambda value, test: (
        F.when(test["how"] == 0, True).when(test["how"] == 1, value == test["fixed"]).when(test["how"] == 2, F.startswith(value, test["fixed"]))
        .when(test["how"] == 3, F.endswith(value, test["fixed"])).otherwise(F.rlike(value, test["regex"]))
    )
    names = F.startswith(F.upper("rule_id"), F.col("_head")) | fits(F.upper("rule_id"), F.col("_rule"))
    hit = met.where(names & fits(F.col("server_id"), F.col("_server")) & fits(F.col("target_name"), F.col("_target")))
    # Findings that meet the same classes get the same notes, which are worked out once.
    sets = hit.groupBy(*TRIPLE).agg(F.sort_array(F.collect_list("_class")).alias("_classes"), F.min("_live").alias("_first"))
    sets = written(sets.withColumn("_set", F.unhex(F.sha2(F.array_join(F.col("_classes").cast("array<string>"), ","), 256))))
    each = sets.groupBy("_set").agg(F.any_value("_classes").alias("_classes"), F.any_value("_first").alias("_first"))
    used = each.select("_set", "_first", F.explode("_classes").alias("_class")).join(members, "_class")
    used = used.where(F.col("_first").isNull() | (F.col("order") < F.col("_first")) | (F.col("live") & (F.col("order") == F.col("_first"))))
    told = used.groupBy("_set").agg(F.sort_array(F.collect_list(F.struct("order", "note"))).alias("_notes"), F.bool_or("live").alias("_live"))
    told = written(told.select("_set", F.transform("_notes", lambda n: n["note"]).alias("_notes"), "_live"))
    # Findings learn the name of their set; its notes, which grow with the suppressions, move once per set and not once per finding.
    # Files hide how long lists of notes are, so what is broadcast is counted.
    told = F.broadcast(told) if is_small(told.select(F.explode("_notes"))) else told.hint("merge")
    named_sets = sets.select(*[F.col(c).alias(f"_{c}") for c in TRIPLE], "_set")
    named_sets = F.broadcast(named_sets) if is_small(named_sets) else named_sets.hint("merge")
    same = F.lit(True)
    for c in TRIPLE:
        same = same & findings[c].eqNullSafe(named_sets[f"_{c}"])
    # What meets nothing is dealt out under names that no set has.
    nothing = F.concat(F.lit("-"), F.pmod(F.xxhash64(*TRIPLE), F.lit(SPARE))).cast("binary")
    joined = findings.join(named_sets, same, "left").withColumn("_set", F.coalesce("_set", nothing)).join(told, "_set", "left")
    return joined.select(
        *[c for c in findings.columns if c not in ("notes", "status")],
        F.when(F.coalesce("_live", F.lit(False)), "suppressed").otherwise(F.col("status")).alias("status"),
        F.coalesce(F.concat("notes", "_notes"), F.col("notes")).alias("notes"),
    ).select(*findings.columns)
