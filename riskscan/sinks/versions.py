"""A history of snapshots as an append-only log: what was accepted for each tool, from when to when.

Every version holds only what changed: rows (server_id, tool, hash) with the time from which they
hold, and no hash where a tool is gone. A version counts once its name is in the list of commits; the
name is given by creating a file that must not exist, so of two writers one fails and nothing a lost
write left behind is ever read. Reading as of a time takes the last row of each tool up to that time.
Compacting writes the state at a time as one table and lets later versions stand.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = ["server_id", "tool"]
SCHEMA = "server_id string, tool string, hash string, valid_from timestamp"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits of the log in order: {"number", "folder", "base"}. There is one small file per version since the last compaction."""
    system, place = _fs(spark, f"{path}/commits")
    if not system.exists(place):
        return []
    rows = spark.read.text(f"{path}/commits", wholetext=True).collect()
    found = sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["number"])
    bases = [i for i, c in enumerate(found) if c["base"]]
    return found[bases[-1] :] if bases else found


def _commit(spark: SparkSession, path: str, number: int, folder: str, base: bool) -> None:
    system, place = _fs(spark, f"{path}/commits/{number:09d}.json")
    out = system.create(place, False)
    out.write(bytearray(json.dumps({"number": number, "folder": folder, "base": base}).encode()))
    out.close()


def _append(spark: SparkSession, path: str, rows: DataFrame, base: bool = False) -> int:
    before = _commits(spark, path)
    number = before[-1]["number"] + 1 if before else 0
    folder = f"v{number:09d}-{uuid.uuid4().hex}"
    rows.select(*KEY, "hash", "valid_from").write.parquet(f"{path}/versions/{folder}")
    _commit(spark, path, number, folder, base)
    return number


def log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log since its last compaction: server_id, tool, hash, valid_from, version."""
    commits = _commits(spark, path)
    if not commits:
        return spark.createDataFrame([], f"{SCHEMA}, version int")
    folders = [f"{path}/versions/{c['folder']}" for c in commits]
    numbers = F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)-[0-9a-f]+/[^/]*$", 1).cast("int")
    return spark.read.schema(SCHEMA).parquet(*folders).select("*", numbers.alias("version"))


def as_of(spark: SparkSession, path: str, time: datetime | None = None) -> DataFrame:
    """server_id, tool, hash, valid_from: what held at a time, or holds now. One grouping over the log."""
    rows = log(spark, path)
    if time is not None:
        rows = rows.where(F.col("valid_from") <= F.lit(time))
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("hash", "valid_from"), F.struct("valid_from", "version")).alias("l"))
    return last.select(*KEY, "l.*").where(F.col("hash").isNotNull())


def accept(spark: SparkSession, path: str, current: DataFrame, time: datetime, overwrite: bool = False, scanned: DataFrame | None = None) -> int:
    """Adds a version with what the snapshot `current(server_id, tool, hash)` changes, from `time` on. Returns its number.

    Without `overwrite` only tools never seen are added and a changed tool keeps its hash, so it is
    reported until somebody accepts it. With it, servers in `current` and `scanned(server_id)` are
    replaced, and their tools that are gone end. A version never begins before the one before it.
    """
    last = log(spark, path).agg(F.max("valid_from").alias("t")).first()["t"]
    if last is not None and last > time:
        raise ValueError(f"a version from {last} on is there already")
    old = as_of(spark, path).select(*KEY, F.col("hash").alias("_old"))
    new = current.groupBy(*KEY).agg(F.max("hash").alias("_new"))
    both = old.join(new, KEY, "full_outer")
    if overwrite:
        seen = current.select("server_id")
        if scanned is not None:
            seen = seen.unionByName(scanned.select("server_id"))
        both = both.join(seen.distinct(), "server_id", "left_semi").where(~F.col("_old").eqNullSafe(F.col("_new")))
    else:
        both = both.where(F.col("_old").isNull())
    return _append(spark, path, both.select(*KEY, F.col("_new").alias("hash"), F.lit(time).cast("timestamp").alias("valid_from")))


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """server_id, tool, hash, valid_from, valid_to: each hash and how long it held; no end for what holds now.

    The window runs over the versions of one tool, of which a version adds one row at most.
    """
    later = W.partitionBy(*KEY).orderBy("valid_from", "version")
    rows = log(spark, path).withColumn("valid_to", F.lead("valid_from").over(later))
    ended = F.col("hash").isNotNull() & ~F.coalesce(F.col("valid_from") == F.col("valid_to"), F.lit(False))
    return rows.where(ended).select(*KEY, "hash", "valid_from", "valid_to")


def changes(spark: SparkSession, path: str, before: datetime, after: datetime) -> DataFrame:
    """What differs between two times, as `drift.compare` has it."""
    from riskscan.operators import drift

    return drift.compare(as_of(spark, path, before), as_of(spark, path, after), drift.SINCE_LAST)


def compact(spark: SparkSession, path: str, time: datetime) -> int:
    """Writes what held at `time`, and all rows after it, as one table that the log begins with. Returns its number.

    Times before `time` can't be read any more; older folders stay until somebody deletes them.
    """
    later = log(spark, path).where(F.col("valid_from") > F.lit(time)).select(*KEY, "hash", "valid_from")
    return _append(spark, path, as_of(spark, path, time).unionByName(later), base=True)
