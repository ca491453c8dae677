"""SARIF and JSON logs as Spark data sources: `df.write.format(...)`, `spark.readStream.format(...)`.

Writing. Each task writes whole logs under a hidden name of its own attempt. Only the driver's commit
moves them to their place and then writes a list of the logs of this commit, so a task that is
killed, repeated or run twice leaves no half log and none twice. A stream's list carries the number
of its micro-batch: a micro-batch that is committed again adds nothing.

Reading. `riskscan-log-tail` follows a folder of logs with one record per line. Its offset is a
file name and a number of bytes, up to the last whole line, so lines appended to the newest log are
read as they come, each once, also after a restart. Long logs are read in parts by many tasks.

All files are opened through `pyarrow.fs`, which takes local, HDFS, S3 and GCS paths.
"""

from __future__ import annotations

import gzip
import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from riskscan.operators.skew import written
from riskscan.sinks.reports import SARIF_SCHEMA

#: Results in one SARIF log; code scanning tools refuse longer ones.
RESULTS_EACH = 25_000
#: How hard gzip tries on a log: results repeat most of their text, so little is gained by more.
GZIP_LEVEL = 4
#: Bytes of a log that one task reads.
PART = 64 << 20
#: Bytes looked at together for the last line end of a log.
TAIL = 1 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else fs.FileSystem.from_uri(f"file://{path}")


def _names(path: str) -> dict[str, int]:
    """Logs of a folder and their sizes; hidden names are not logs."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


@dataclass
class Written(WriterCommitMessage):
    """The hidden names of the logs that a task has finished."""

    names: list[str]


class _LogWriter:
    """What batch and stream writers share. `ending` names the kind of log."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool = False):
        self.path = options["path"]
        self.kind = options["kind"]
        self.tool = options.get("tool", "riskscan")
        self.each = int(options.get("resultseach", RESULTS_EACH))
        self.columns = schema.fieldNames()
        self.overwrite = overwrite
        self.compression = options.get("compression", "none").lower()
        # Logs of lines are followed by byte offsets, so they stay plain.
        if self.compression not in (("none", "gzip") if self.kind == "sarif" else ("none",)):
            raise ValueError(f"{self.kind} logs can't be written with compression {self.compression!r}")
        wanted = {"sarif": {"rule_id", "rule", "result"}, "lines": {"value"}}[self.kind]
        if not wanted <= set(self.columns):
            raise ValueError(f"the rows need the columns {', '.join(sorted(wanted))}")

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.path)
        system.create_dir(f"{root}/_staged", recursive=True)
        names: list[str] = []
        stream, raw, rules, count = None, None, {}, 0

        def put(text: str) -> None:
            stream.write(text.encode())

        def end() -> None:
            if self.kind == "sarif":
                listed = ",".join(rules[k] for k in sorted(rules))
                put(f'],"tool":{{"driver":{{"name":{json.dumps(self.tool)},"rules":[{listed}]}}}}}}]}}')
            stream.close()
            raw.close()

        for row in rows:
            if stream is None or (self.kind == "sarif" and count >= self.each):
                if stream is not None:
                    end()
                names.append(f"{uuid.uuid4().hex}.{'sarif' if self.kind == 'sarif' else 'jsonl'}{'.gz' if self.compression == 'gzip' else ''}")
                raw, rules, count = system.open_output_stream(f"{root}/_staged/{names[-1]}", compression=None), {}, 0
                stream = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=GZIP_LEVEL) if self.compression == "gzip" else raw
                if self.kind == "sarif":
                    put(f'{{"$schema":{json.dumps(SARIF_SCHEMA)},"version":"2.1.0","runs":[{{"results":[')
            if self.kind == "sarif":
                put(("," if count else "") + row["result"])
                rules.setdefault(row["rule_id"], row["rule"])
            else:
                put(row["value"].replace("\n", " ") + "\n")
            count += 1
        if stream is not None:
            end()
        return Written(names)

    def finish(self, messages: list, label: str) -> None:
        """Moves finished logs to their place; the list of them comes last."""
        system, root = _system(self.path)
        system.create_dir(f"{root}/_commits", recursive=True)
        old = list(_names(self.path)) if self.overwrite else []
        moved = []
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{root}/_staged/{name}", f"{root}/{label}-{name}")
                moved.append(f"{label}-{name}")
        with system.open_output_stream(f"{root}/_commits/{label}.json", compression=None) as out:
            out.write(json.dumps(moved).encode())
        for name in old:
            system.delete_file(f"{root}/{name}")

    def drop(self, messages: list) -> None:
        system, root = _system(self.path)
        for message in messages:
            for name in message.names if message else ():
                system.delete_file(f"{root}/_staged/{name}")


class LogWriter(_LogWriter, DataSourceWriter):
    def commit(self, messages: list) -> None:
        # Names of later commits come later, so that a reader that follows the folder finds them.
        self.finish(messages, f"log-{time.time_ns():020d}")

    def abort(self, messages: list) -> None:
        self.drop(messages)


class LogStreamWriter(_LogWriter, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        from pyarrow import fs

        system, root = _system(self.path)
        label = f"batch-{batchId:09d}"
        if system.get_file_info(f"{root}/_commits/{label}.json").type == fs.FileType.File:
            self.drop(messages)
            return
        # Logs that an earlier try at this micro-batch moved before it stopped.
        for name in _names(self.path):
            if name.startswith(f"{label}-"):
                system.delete_file(f"{root}/{name}")
        self.finish(messages, label)

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


class _Logs(DataSource):
    kind = ""

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LogWriter({**self.options, "kind": self.kind}, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return LogStreamWriter({**self.options, "kind": self.kind}, schema, False)


class SarifLogs(_Logs):
    """Rows `rule_id, rule, result` (JSON texts) as SARIF logs. Options: path, tool, resultsEach, compression (none, or gzip for `.sarif.gz`)."""

    kind = "sarif"

    @classmethod
    def name(cls) -> str:
        return "riskscan-sarif"


class LineLogs(_Logs):
    """Rows `value` as logs with one line per row. Option: path."""

    kind = "lines"

    @classmethod
    def name(cls) -> str:
        return "riskscan-lines"


@dataclass
class Part(InputPartition):
    """Bytes `begin` to `end` of a log that was read up to `known` before; a line belongs to the part it begins in."""

    name: str
    begin: int
    end: int
    known: int


class _Reading:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part = int(options.get("partbytes", PART))

    def whole_lines(self, name: str, size: int) -> int:
        """Where the last whole line of a log ends."""
        system, root = _system(self.path)
        with system.open_input_file(f"{root}/{name}") as source:
            end = size
            while end > 0:
                begin = max(0, end - TAIL)
                at = source.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def parts(self, start: dict, end: dict) -> list[Part]:
        out = []
        for name, size in sorted(_names(self.path).items()):
            if name < start["file"] or name > end["file"]:
                continue
            begin = start["at"] if name == start["file"] else 0
            # The newest log is read to its last whole line; older ones have ended.
            stop = end["at"] if name == end["file"] else size
            out += [Part(name, at, min(at + self.part, stop), begin) for at in range(begin, stop, self.part)]
        return out

    def newest(self) -> dict:
        sizes = _names(self.path)
        if not sizes:
            return {"file": "", "at": 0}
        last = max(sizes)
        return {"file": last, "at": self.whole_lines(last, sizes[last])}

    def read(self, partition: Part) -> Iterator[tuple[str, str, int]]:
        system, root = _system(self.path)
        with io.BufferedReader(system.open_input_file(f"{root}/{partition.name}"), TAIL) as source:
            source.seek(partition.begin)
            at = partition.begin
            if at > partition.known:
                # A line that began in the part before belongs to it.
                source.seek(at - 1)
                at += len(source.readline()) - 1
            while at < partition.end:
                line = source.readline()
                if not line:
                    break
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), partition.name, at
                at += len(line)


class TailStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        return self.newest()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(start, end)


class TailReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts({"file": "", "at": 0}, self.newest())


class LogTail(DataSource):
    """Lines of a folder of logs: value, file, at. Options: path, partBytes.

    Logs are named in the order they were begun and only the newest grows, as logs that are rotated
    do. A last line without its end is read when it is whole.
    """

    @classmethod
    def name(cls) -> str:
        return "riskscan-log-tail"

    def schema(self) -> str:
        return "value string, file string, at bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TailReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for source in (SarifLogs, LineLogs, LogTail):
        spark.dataSource.register(source)


def sarif_rows(findings: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Rows for `riskscan-sarif`: every finding with the rule object of its rule, rules looked up by a join on their ids.

    Findings are read twice, so pass written ones. Rule objects are few and written first: their
    size is known then, and results need not be moved to meet them.
    """
    from riskscan.sinks.reports import sarif_results, sarif_rules

    rules = written(sarif_rules(findings, catalog).withColumnRenamed("value", "rule"))
    return sarif_results(findings).withColumnRenamed("value", "result").join(rules, "rule_id").select("server_id", "rule_id", "rule", "result")


def json_lines(df: DataFrame) -> DataFrame:
    """Rows for `riskscan-lines`: each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
