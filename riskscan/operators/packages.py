"""Package checks: known-bad versions (range join) and look-alike names (fuzzy join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.functions import packages as P
from riskscan.operators.skew import broadcast_if_small

MIN_NAME = 5


def match_known_bad(dependencies: DataFrame, known_bad: DataFrame) -> DataFrame:
    """Dependencies on the known-bad list, with `certain` false when the version is not known.

    An equi-join on ecosystem and normalised name; the version ranges are checked on the
    few rows that meet.
    """
    bad = known_bad.select(
        F.col("ecosystem").alias("_eco"),
        P.normalized_name(F.col("name"), F.col("ecosystem")).alias("_name"),
        "versions", "summary", "references",
    )
    named = dependencies.withColumn("_name", P.normalized_name(F.col("name"), F.col("ecosystem")))
    joined = named.join(
        broadcast_if_small(bad), (F.col("ecosystem") == F.col("_eco")) & (named["_name"] == bad["_name"])
    ).drop("_name", "_eco")
    rules = F.col("versions")
    known = F.col("version").isNotNull() & (F.col("version") != "")
    listed = F.exists(rules, lambda r: P.version_in(F.col("version"), r))
    every = F.array_contains(rules, F.lit("*"))
    open_range = F.exists(rules, lambda r: r.startswith(">"))
    return joined.withColumn("certain", F.when(known, listed).otherwise(every)).where(
        F.when(known, F.col("certain")).otherwise(every | open_range)
    )


def lookalike_targets(
    names: DataFrame, popular: DataFrame, allowed: Sequence[str] = (), official_scopes: Sequence[str] = ()
) -> DataFrame:
    """For distinct `names(ecosystem, name)`, normalised: the popular name each imitates.

    Two names at most one edit apart share a name made by deleting one character from
    each, so an equi-join on those finds all pairs without comparing everything with
    everything. Names that only differ in digits meet on the name without digits.
    """
    pop = popular.select("ecosystem", P.normalized_name(F.col("name"), F.col("ecosystem")).alias("target")).distinct()
    pop = broadcast_if_small(pop)
    name = F.col("name")
    odd = names.join(pop.withColumnRenamed("target", "name"), ["ecosystem", "name"], "left_anti")
    if allowed:
        odd = odd.where(~name.isin(*allowed))
    long = odd.where(F.char_length("name") >= MIN_NAME)
    wanted = pop.where(F.char_length("target") >= MIN_NAME)
    same_scope = F.col("target").startswith("@") == name.startswith("@")
    near = (
        long.withColumn("key", F.explode(P.deletions(name)))
        .join(wanted.withColumn("key", F.explode(P.deletions(F.col("target")))), ["ecosystem", "key"])
        .where(same_scope & P.one_edit_apart(name, F.col("target")))
    )
    bare = lambda c: F.regexp_replace(c, r"\d", "")
    digits = (
        long.withColumn("key", bare(name))
        .join(wanted.withColumn("key", bare(F.col("target"))), ["ecosystem", "key"])
        .where(same_scope & (name != F.col("target")))
    )
    found = near.unionByName(digits).groupBy("ecosystem", "name").agg(F.min("target").alias("target"))
    if not official_scopes:
        return found
    scope = F.substring_index(name, "/", 1)
    imitates = None
    for official in official_scopes:
        hit = (scope != official) & F.regexp_replace(scope, "[-_.]", "").contains(official.lstrip("@"))
        value = F.when(hit, F.lit(f"{official}/*"))
        imitates = value if imitates is None else F.coalesce(imitates, value)
    scoped = (
        odd.where((F.col("ecosystem") == "npm") & name.startswith("@"))
        .withColumn("target", imitates)
        .where(F.col("target").isNotNull())
    )
    both = scoped.select("ecosystem", "name", "target", F.lit(0).alias("p")).unionByName(
        found.select("ecosystem", "name", "target", F.lit(1).alias("p"))
    )
    return both.groupBy("ecosystem", "name").agg(F.min_by("target", "p").alias("target"))


def typosquats(
    dependencies: DataFrame, popular: DataFrame, allowed: Sequence[str] = (), official_scopes: Sequence[str] = ()
) -> DataFrame:
    """Direct dependencies with a look-alike name, the first of each name per server.

    Names are made distinct before the fuzzy join, so a package that a million servers use
    is compared once.
    """
    direct = dependencies.where("direct").withColumn("_norm", P.normalized_name(F.col("name"), F.col("ecosystem")))
    names = direct.select("ecosystem", F.col("_norm").alias("name")).distinct()
    targets = lookalike_targets(names, popular, allowed, official_scopes).withColumnRenamed("name", "_norm")
    first = direct.groupBy("server_id", "ecosystem", "_norm", "name").agg(
        F.min(F.struct("source", F.coalesce("line", F.lit(0)).alias("line"))).alias("at")
    )
    return first.join(targets, ["ecosystem", "_norm"]).select(
        "server_id", "name", "ecosystem", "target", F.col("at.source").alias("source"),
        F.when(F.col("at.line") > 0, F.col("at.line")).alias("line"),
    )
