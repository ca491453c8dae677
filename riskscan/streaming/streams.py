"""Streaming operators over event tables.

Stateless scans reuse the batch operators. Windows and joins carry watermarks, so late rows are
dropped and state stays bounded. Stateful logic that windows cannot express keeps a few
values per key with `transformWithState`, which needs the RocksDB state store. What depends on the
order of a key's events, and what is done about late rows, is in `riskscan.streaming.ordered`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from riskscan.operators import match as M
from riskscan.operators import runtime as R
from riskscan.operators.runtime import limit_reason

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = (
    "ts timestamp, server_id string, kind string, pid int, name string, cmdline string, remote_address string, phase string, "
    "method string, detail string, memory_mb double, cpu_seconds double"
)


def read_events(spark: SparkSession, path: str, schema: str | StructType = EVENT_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """Runtime events as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_kafka_events(spark: SparkSession, servers: str, topic: str, per_batch: int = 1_000_000) -> DataFrame:
    """The same events as JSON on a Kafka topic (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_batch).load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("e")).select("e.*")


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a TIMESTAMP; watermarks refuse timestamps without time zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


# ---- stateless ------------------------------------------------------------------------------


def text_hits(surfaces: DataFrame) -> DataFrame:
    """Candidates of the text rules on arriving texts."""
    return M.resolve_tool_references(M.surface_hits(surfaces))


def planted_hits(texts: DataFrame, planted: DataFrame) -> DataFrame:
    """Arriving texts that hold a planted value of their server; `planted` is a static table."""
    values = planted.where(F.col("value") != "").select("server_id", "value").distinct()
    return texts.join(values, "server_id").where(F.contains("text", F.col("value"))).select("server_id", "ts", "location")


def alerts(events: DataFrame, servers: DataFrame | None = None, late: str = "10 minutes") -> DataFrame:
    """Suspicious programs and outside connections as they happen, each once within the watermark.

    `servers` is a static table: what package launchers fetch at startup raises no alert.
    """
    programs = R.suspicious_processes(events.where(F.col("kind") == "process")).select(
        "ts", "server_id", F.lit("process").alias("alert"), F.col("program").alias("what"), "phase"
    )
    outside = R.outside_connections(events.where(F.col("kind") == "connection"), servers).select(
        "ts", "server_id", F.lit("connection").alias("alert"), F.col("remote_address").alias("what"), "phase"
    )
    return distinct_events(programs.unionByName(outside), ["server_id", "alert", "what", "phase"], late)


# ---- windows and watermarks -------------------------------------------------------------------


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event per key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, key: str, size: str = "30 seconds", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Event counts and value sums per key and window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), key).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")
    )


def resource_alerts(
    events: DataFrame, memory_mb: float, processes: int, cpu_seconds: float, tick: str = "30 seconds", late: str = "1 minute"
) -> DataFrame:
    """Ticks in which a server breaks a limit. A process counts once per tick, with its largest sample."""
    sampled = events.withWatermark("ts", late).groupBy(F.window("ts", tick).alias("tick"), "server_id", "pid").agg(
        F.max("memory_mb").alias("memory_mb"), F.max("cpu_seconds").alias("cpu_seconds")
    )
    ticks = sampled.groupBy("tick", "server_id").agg(
        F.sum("memory_mb").alias("memory_mb"), F.count(F.lit(1)).alias("processes"), F.sum("cpu_seconds").alias("cpu_seconds")
    )
    return ticks.withColumn("reason", limit_reason(memory_mb, processes, cpu_seconds)).where(F.col("reason").isNotNull())


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity per key with the number of events and of error events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), key).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


# ---- state ------------------------------------------------------------------------------------


def _ending(ttl_ms: int | None) -> str:
    """State with a time to live needs processing time; a run over what is available at once keeps none."""
    return "None" if ttl_ms is None else "ProcessingTime"


class DriftProcessor(StatefulProcessor):
    """Keeps the accepted hash of a tool and reports each other one once.

    The state may start from a stored snapshot; without one the first hash seen is trusted. Another
    hash is reported and remembered as reported; the accepted hash stays until a row says that
    another one is accepted. That counts from the micro-batch it comes with on, and what was
    reported before is forgotten. State that is not used any more ends by itself after a time.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "hash string", self.ttl_ms)
        self.reported = handle.getMapState("reported", "hash string", "seen boolean", self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.accepted.update((initialState.hash,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Only the first time of each hash and the last acceptance are kept: a tool has few hashes, however often it is observed.
        first: dict = {}
        said = None
        for row in rows:
            if row.accepted:
                said = max(said, (row.ts, row.hash is not None, row.hash or "")) if said else (row.ts, row.hash is not None, row.hash or "")
            elif row.hash not in first or row.ts < first[row.hash]:
                first[row.hash] = row.ts
        if said:
            self.reported.clear()
            if said[1]:
                self.accepted.update((said[2],))
            else:
                self.accepted.clear()
        seen = sorted(first.items(), key=lambda x: (x[1], x[0]))
        if not seen:
            return
        old = self.accepted.get()[0] if self.accepted.exists() else seen[0][0]
        self.accepted.update((old,))
        for hash_, ts in seen:
            if hash_ != old and not self.reported.containsKey((hash_,)):
                self.reported.updateValue((hash_,), (True,))
                yield Row(server_id=key[0], tool=key[1], ts=ts, change="changed", before_hash=old, after_hash=hash_)

    def close(self) -> None:
        pass


DRIFT_SCHEMA = "server_id string, tool string, ts timestamp, change string, before_hash string, after_hash string"


def drift(snapshots: DataFrame, ttl_ms: int | None = None, pins: DataFrame | None = None, acceptances: DataFrame | None = None) -> DataFrame:
    """Changed definitions in a stream of observations (ts, server_id, tool, hash).

    `pins(server_id, tool, hash)` is the stored snapshot a new stream starts from; a stream that
    goes on from its checkpoint has its own state and reads them no more. `acceptances(ts,
    server_id, tool, hash)` is a second stream: a hash that is accepted from now on, or none to
    trust what is seen next. `drift.replayed_changes` gives the same from tables. A stream that
    runs on should pass `ttl_ms`: state that nothing touches for so long ends.
    """
    rows = snapshots.select("ts", "server_id", "tool", "hash", F.lit(False).alias("accepted"))
    if acceptances is not None:
        rows = rows.unionByName(acceptances.select("ts", "server_id", "tool", "hash", F.lit(True).alias("accepted")))
    begin = None if pins is None else pins.select("server_id", "tool", "hash").groupBy("server_id", "tool")
    return rows.groupBy("server_id", "tool").transformWithState(
        statefulProcessor=DriftProcessor(ttl_ms), outputStructType=DRIFT_SCHEMA, outputMode="Append", timeMode=_ending(ttl_ms), initialState=begin
    )


# ---- joins of streams -------------------------------------------------------------------------


def connection_programs(processes: DataFrame, connections: DataFrame, within: str = "10 minutes", late: str = "2 minutes") -> DataFrame:
    """Connections of a stream with the program that made them: the last one seen under the process id at most `within` before.

    `processes(server_id, pid, ts, name)`, `connections(server_id, pid, ts, remote_address, phase)`:
    an interval join under watermarks, so both sides keep no more than `within` and `late` of their
    rows. Processes are samples: one that repeats counts once per watermark. A connection whose
    program is not known comes out with none once the watermark has passed it. Connections that
    are equal in all these columns are one. `runtime.connection_programs` gives the same from tables.
    """
    seen = processes.withWatermark("ts", late).select(
        F.col("server_id").alias("_server"), F.col("pid").alias("_pid"), F.col("ts").alias("_started"), F.col("name").alias("_name")
    )
    asked = connections.withWatermark("ts", late).select("server_id", "pid", "ts", "remote_address", "phase")
    near = (F.col("server_id") == F.col("_server")) & (F.col("pid") == F.col("_pid")) & F.expr(f"_started <= ts and _started >= ts - interval {R.seconds(within)} seconds")
    joined = asked.join(seen, near, "left_outer")
    best = F.max(F.struct("_started", "_name")).alias("_best")
    one = joined.groupBy("server_id", "pid", "ts", "remote_address", "phase").agg(best)
    return one.select("server_id", "pid", "ts", "remote_address", "phase", F.col("_best._name").alias("program"), F.col("_best._started").alias("started"))


def outside_programs(events: DataFrame, servers: DataFrame | None = None, within: str = "10 minutes", late: str = "2 minutes") -> DataFrame:
    """Outside connections of a stream of events with the program behind each."""
    outside = R.outside_connections(events.where(F.col("kind") == "connection"), servers)
    return connection_programs(events.where(F.col("kind") == "process"), outside, within, late)


# ---- running --------------------------------------------------------------------------------


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Process what is available and stop, writing Parquet. Returns how many rows came too late for their watermark.

    Append output goes straight to a file sink, which is exactly-once. Update output goes
    through `foreachBatch`, one folder per batch, so a repeated batch overwrites itself.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(batch_writer(path)).start()
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last state of each key from a table of updates with a `batch` column."""
    packed = F.struct(*values)
    rows = updates.groupBy(*keys).agg(F.max_by(packed, "batch").alias("v"))
    return rows.select(*keys, "v.*")


def as_snapshots(events: DataFrame, server: Column, tool: Column, definition: Column) -> DataFrame:
    """Observations of definitions with their hash, for `drift`."""
    return events.select(
        F.col("ts"), server.alias("server_id"), tool.alias("tool"), F.left(F.sha2(definition, 256), F.lit(32)).alias("hash")
    )
