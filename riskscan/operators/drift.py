"""Definition snapshots: hashing, comparing, accepting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskscan.functions.hashing import canonical_json, definition_hash

SINCE_LAST = "since-last-scan"
IN_SESSION = "during-session"


def tool_hash() -> Column:
    """A stable hash of everything an agent sees of a tool."""
    return definition_hash(
        F.col("name"), F.col("title"), F.col("description"), canonical_json(F.col("input_schema")),
        canonical_json(F.col("output_schema")), canonical_json(F.col("annotations")),
    )


def tool_hashes(tools: DataFrame) -> DataFrame:
    """(server_id, tool, hash); the last definition of a name counts."""
    hashed = tools.select("server_id", F.col("name").alias("tool"), "seq", tool_hash().alias("hash"))
    return hashed.groupBy("server_id", "tool").agg(F.max_by("hash", "seq").alias("hash"))


def compare(before: DataFrame, after: DataFrame, when: str) -> DataFrame:
    """Tools added, removed or changed between two snapshots (server_id, tool, hash).

    A full outer join on the snapshot key. Both sides have one row per key, so no key can
    be hot.
    """
    b = before.select("server_id", "tool", F.col("hash").alias("before_hash"))
    a = after.select("server_id", "tool", F.col("hash").alias("after_hash"))
    joined = b.join(a, ["server_id", "tool"], "full_outer").where(~F.col("before_hash").eqNullSafe(F.col("after_hash")))
    change = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "removed").otherwise("changed")
    return joined.select("server_id", "tool", change.alias("change"), "before_hash", "after_hash", F.lit(when).alias("when"))


def check_snapshot(pins: DataFrame, current: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Changes since the stored snapshot, for the servers scanned now and known before.

    A server never seen before gives nothing, and neither does one that was not scanned.
    `scanned(server_id)` adds servers that were scanned and now list nothing.
    """
    now = current.select("server_id")
    if scanned is not None:
        now = now.unionByName(scanned.select("server_id"))
    known = pins.select("server_id").distinct()
    return compare(
        pins.join(now.distinct(), "server_id", "left_semi"), current.join(known, "server_id", "left_semi"), SINCE_LAST
    )


def accept_snapshot(pins: DataFrame, current: DataFrame, overwrite: bool = False, scanned: DataFrame | None = None) -> DataFrame:
    """The next snapshot: trust on first use.

    Without `overwrite` an old hash wins and removed tools stay, so a change is reported until
    somebody accepts it. With it, servers in `current` are replaced. `scanned(server_id)`
    names servers that were scanned and now list nothing.
    """
    if overwrite:
        seen = current.select("server_id").distinct()
        if scanned is not None:
            seen = seen.unionByName(scanned.select("server_id")).distinct()
        kept = pins.select("server_id", "tool", "hash").join(seen, "server_id", "left_anti")
        return kept.unionByName(current.select("server_id", "tool", "hash"))
    old = pins.select("server_id", "tool", F.col("hash").alias("old"))
    new = current.select("server_id", "tool", F.col("hash").alias("new"))
    return old.join(new, ["server_id", "tool"], "full_outer").select(
        "server_id", "tool", F.coalesce("old", "new").alias("hash")
    )


def observed_changes(snapshots: DataFrame) -> DataFrame:
    """Definitions that differ from the first one seen of a tool: `snapshots(ts, server_id, tool, hash)`.

    The first observation is the baseline; each other hash is reported once, with the time it was
    first seen. Two groupings, so a tool that is observed often is no burden.
    """
    seen = snapshots.groupBy("server_id", "tool", "hash").agg(F.min("ts").alias("ts"))
    base = seen.groupBy("server_id", "tool").agg(F.min_by("hash", F.struct("ts", "hash")).alias("before_hash"))
    changed = seen.join(base, ["server_id", "tool"]).where(F.col("hash") != F.col("before_hash"))
    return changed.select(
        "server_id", "tool", "ts", F.lit("changed").alias("change"), "before_hash", F.col("hash").alias("after_hash"), F.lit(IN_SESSION).alias("when")
    )


def replayed_changes(observations: DataFrame, acceptances: DataFrame | None = None, pins: DataFrame | None = None) -> DataFrame:
    """What a stream of observations and acceptances reports, from the tables of both.

    `observations(ts, server_id, tool, hash, arrival)`, `acceptances(ts, server_id, tool, hash,
    arrival)`, `pins(server_id, tool, hash)`; `arrival` numbers what arrived together. An acceptance
    counts from the arrival it came with on, and the last of an arrival wins; one without a hash
    trusts what is seen next. From then on each hash other than the accepted one is reported once:
    (server_id, tool, ts, change, before_hash, after_hash). Without a pin the first hash is trusted.

    Observations are reduced to one row per tool, hash and arrival before anything is ordered.
    """
    key = ["server_id", "tool"]
    seen = observations.groupBy(*key, "arrival", "hash").agg(F.min("ts").alias("ts")).withColumn("_kind", F.lit(1))
    if acceptances is not None:
        last = acceptances.groupBy(*key, "arrival").agg(F.max_by("hash", F.struct("ts", "hash")).alias("_accepted"))
        seen = seen.unionByName(last.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    else:
        seen = seen.withColumn("_accepted", F.lit(None).cast("string"))
    upto = W.partitionBy(*key).orderBy("arrival", "_kind").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = seen.withColumn("_epoch", F.sum(F.when(F.col("_kind") == 0, 1).otherwise(0)).over(upto))
    first = F.min_by(F.struct("ts", "hash"), F.when(F.col("_kind") == 1, F.struct("arrival", "ts", "hash")))
    epochs = rows.groupBy(*key, "_epoch").agg(F.max("_accepted").alias("_given"), first.alias("_first"))
    if pins is not None:
        old = pins.select(*key, F.col("hash").alias("_pinned"), F.lit(0).cast("bigint").alias("_epoch"))
        epochs = epochs.join(old, [*key, "_epoch"], "left").withColumn("_given", F.coalesce("_given", "_pinned"))
    base = epochs.select(*key, "_epoch", F.coalesce("_given", "_first.hash").alias("before_hash"))
    found = rows.where("_kind = 1").groupBy(*key, "_epoch", "hash").agg(F.min_by("ts", F.struct("arrival", "ts")).alias("ts"))
    changed = found.join(base, [*key, "_epoch"]).where(F.col("hash") != F.col("before_hash"))
    return changed.select(*key, "ts", F.lit("changed").alias("change"), "before_hash", F.col("hash").alias("after_hash"))
