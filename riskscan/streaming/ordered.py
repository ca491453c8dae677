"""Streams whose results depend on the order of events, worked out by the batch operators.

A run of time-outs or the place in a session needs a server's events in the order of their time,
and one server may send most of them. So nothing is sorted in a Python worker: each micro-batch is
a table, and the operators of `riskscan.operators.runtime`, which cut a busy server into time
buckets, run over it in the JVM. Between micro-batches two small tables are kept per stream: rows
that may still be overtaken (those younger than the watermark) and one summary row per server.

Three things can happen to a row, and the counts of all three are kept. It comes in time: it is
worked on as soon as the watermark passes it. It comes late, behind the watermark but not behind a
second, longer one: it goes to a table of corrections. It comes behind both, or has no time: it is
lost and only counted.

Every micro-batch writes its tables under its own number and its marks last; a repeated one
overwrites what it wrote before, and results are read up to the last marks only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from riskscan.operators import runtime as R

#: Results and late rows lie in a folder for each micro-batch.
OF_BATCH = StructField("of_batch", IntegerType())
MARKS = "newest timestamp, mark timestamp, lost_mark timestamp, on_time bigint, late bigint, lost bigint"


@dataclass(frozen=True)
class Step:
    """What is done with the rows of a micro-batch that are next in order.

    `work(ready, carry)` gives rows, which are written once; `shown(rows)` are the results and
    `carry(rows, mark)` the summaries for the next micro-batch, of the schema `carried`; no row
    from before `mark` will be worked on any more.
    """

    carried: str
    work: Callable[[DataFrame, DataFrame], DataFrame]
    shown: Callable[[DataFrame], DataFrame]
    carry: Callable[[DataFrame, datetime | None], DataFrame]


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def marks(spark: SparkSession, path: str) -> DataFrame:
    """batch, newest, mark, lost_mark, on_time, late, lost: one row per finished micro-batch."""
    if not _exists(spark, f"{path}/marks"):
        return spark.createDataFrame([], f"{MARKS}, batch int")
    return spark.read.schema(f"{MARKS}, batch int").parquet(f"{path}/marks")


def micro_batch(step: Step, path: str, late: str, lost: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """The function for `foreachBatch`."""
    wait, give_up = R.seconds(late), R.seconds(lost)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here, before = f"{path}/state/batch={number}", f"{path}/state/batch={number - 1}"
        old = marks(spark, path).where(F.col("batch") < number).orderBy(F.col("batch").desc()).first()
        time, mark, lost_mark = F.col(ts), old and old["mark"], old and old["lost_mark"]
        place = F.when(time.isNull(), "lost")
        if mark is not None:
            place = place.when(time < F.lit(lost_mark), "lost").when(time < F.lit(mark), "late")
        arrived = _stored(batch.withColumn("_place", place.otherwise("on_time")), f"{here}/arrived")
        sums = {r["_place"]: r for r in arrived.groupBy("_place").agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest")).collect()}
        newest = max((t for t in (old and old["newest"], *(r["newest"] for k, r in sums.items() if k == "on_time")) if t is not None), default=None)
        new_mark = F.lit(newest).cast("timestamp") - F.expr(f"interval {wait} seconds")
        fresh = arrived.where(F.col("_place") == "on_time").drop("_place")
        kept = batch.schema
        pending = spark.read.schema(kept).parquet(f"{before}/pending") if old else spark.createDataFrame([], kept)
        carry = spark.read.schema(step.carried).parquet(f"{before}/carry") if old else spark.createDataFrame([], step.carried)
        waiting = pending.unionByName(fresh)
        rows = _stored(step.work(waiting.where(time < new_mark), carry), f"{here}/rows")
        step.shown(rows).write.mode("overwrite").parquet(f"{path}/rows/of_batch={number}")
        arrived.where(F.col("_place") == "late").drop("_place").write.mode("overwrite").parquet(f"{path}/late/of_batch={number}")
        step.carry(rows, newest and newest - timedelta(seconds=wait)).write.mode("overwrite").parquet(f"{here}/carry")
        waiting.where(~F.coalesce(time < new_mark, F.lit(False))).write.mode("overwrite").parquet(f"{here}/pending")
        count = lambda k: F.lit(sums[k]["n"] if k in sums else 0).cast("bigint").alias(k)
        done = spark.range(1).select(
            F.lit(newest).cast("timestamp").alias("newest"), new_mark.alias("mark"), (new_mark - F.expr(f"interval {give_up} seconds")).alias("lost_mark"),
            count("on_time"), count("late"), count("lost"),
        )
        done.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        _remove(spark, f"{here}/arrived")
        _remove(spark, f"{here}/rows")
        _remove(spark, f"{path}/state/batch={number - 2}")

    return run


def run_in_order(stream: DataFrame, step: Step, path: str, checkpoint: str, late: str = "10 minutes", lost: str = "1 day", ts: str = "ts") -> None:
    """Process what is available and stop; the next call with the same folders goes on from there.

    Rows are worked on `late` behind the newest time seen, rows that come after that are
    corrections, and those that come `lost` later still are only counted.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(micro_batch(step, path, late, lost, ts)).start().awaitTermination()


def results(spark: SparkSession, path: str, step: Step | None = None, schema: StructType | None = None) -> DataFrame:
    """The results of the finished micro-batches.

    With `step` and the `schema` of the stream's rows, also what the waiting rows would give if
    the stream ended now; nothing is stored for that.
    """
    rows = _finished(spark, path, spark.read.parquet(f"{path}/rows"))
    last = marks(spark, path).agg(F.max("batch").alias("n")).first()["n"]
    if step is None or last is None:
        return rows
    here = f"{path}/state/batch={last}"
    return rows.unionByName(step.shown(step.work(spark.read.schema(schema).parquet(f"{here}/pending"), spark.read.schema(step.carried).parquet(f"{here}/carry"))))


def _finished(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    done = marks(spark, path).select(F.col("batch").alias("of_batch"))
    return rows.join(F.broadcast(done), "of_batch", "left_semi").drop("of_batch")


def corrections(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that came late, behind the watermark but not behind the second one."""
    return _finished(spark, path, spark.read.schema(StructType([*schema, OF_BATCH])).parquet(f"{path}/late"))


# ---- steps ----------------------------------------------------------------------------------


def timeout_step(limit: int = 2, bucket: str = "hour") -> Step:
    """Calls at which `limit` time-outs in a row are reached: rows `server_id, ts, seq, timed_out`.

    The summary of a server is how many time-outs in a row its calls so far end with; servers
    that end with none have no summary.
    """

    def work(ready: DataFrame, carry: DataFrame) -> DataFrame:
        calls = ready.select("server_id", "ts", "seq", F.col("timed_out").cast("int").alias("amount"), F.lit(True).alias("real"))
        begun = carry.select("server_id", "ts", "seq", F.col("n").cast("int").alias("amount"), F.lit(False).alias("real"))
        return R.timeout_runs(calls.unionByName(begun), "server_id", "ts", ["ts", "seq"], F.col("amount"), bucket)

    def carry(rows: DataFrame, mark: datetime | None) -> DataFrame:
        n = F.when(F.col("real"), F.col("in_a_row")).otherwise(F.col("amount")).cast("bigint")
        last = rows.groupBy("server_id").agg(F.max_by(F.struct("ts", "seq", n.alias("n")), F.struct("ts", "seq")).alias("l"))
        return last.select("server_id", "l.*").where("n > 0")

    return Step("server_id string, ts timestamp, seq bigint, n bigint", work, lambda rows: rows.where(F.col("real") & (F.col("in_a_row") == limit)).select("server_id", "ts", "seq"), carry)


def budget_step(budget: int, quiet: str = "30 minutes", bucket: str = "hour") -> Step:
    """Every event with its place in the session of its server and whether it is over the budget: rows `server_id, ts, seq`.

    The summary of a server is the place and time of its last event, as long as its session may go on.
    """
    pause = R.seconds(quiet)

    def work(ready: DataFrame, carry: DataFrame) -> DataFrame:
        events = ready.select("server_id", "ts", "seq", F.lit(1).cast("bigint").alias("amount"), F.lit(True).alias("real"))
        begun = carry.select("server_id", "ts", "seq", F.col("n").alias("amount"), F.lit(False).alias("real"))
        return R.session_places(events.unionByName(begun), "server_id", "ts", ["ts", "seq"], quiet, F.col("amount"), bucket)

    def carry(rows: DataFrame, mark: datetime | None) -> DataFrame:
        last = rows.groupBy("server_id").agg(F.max_by(F.struct("ts", "seq", F.col("place").alias("n")), F.struct("ts", "seq")).alias("l"))
        last = last.select("server_id", "l.*")
        return last if mark is None else last.where(F.col("ts") >= F.lit(mark).cast("timestamp") - F.expr(f"interval {pause} seconds"))

    shown = lambda rows: rows.where("real").select("server_id", "ts", "seq", F.col("place").cast("int").alias("place"), (F.col("place") > budget).alias("over"))
    return Step("server_id string, ts timestamp, seq bigint, n bigint", work, shown, carry)


def window_step(key: str, size: str) -> Step:
    """Event counts and value sums per key and window: rows `ts`, the key, `value`.

    The results of a micro-batch are parts of windows: `windows` adds them up, with corrections.
    """

    def work(ready: DataFrame, carry: DataFrame) -> DataFrame:
        return window_parts(ready, key, size)

    return Step("none int", work, lambda rows: rows, lambda rows, mark: rows.sparkSession.createDataFrame([], "none int"))


def window_parts(rows: DataFrame, key: str, size: str) -> DataFrame:
    return rows.groupBy(F.window("ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def windows(parts: DataFrame, late: DataFrame, key: str, size: str) -> DataFrame:
    """w, key, events, total, corrected: windows with what came late; `corrected` is how many rows that were."""
    more = window_parts(late, key, size).withColumn("corrected", F.col("events"))
    every = parts.withColumn("corrected", F.lit(0).cast("bigint")).unionByName(more)
    return every.groupBy("w", key).agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.sum("corrected").alias("corrected"))
