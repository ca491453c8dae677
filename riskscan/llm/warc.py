"""WARC archives, written with an index and read back by coalesced byte ranges.

Writing: each task writes its pages into archives of its own in the shared folder, one gzip
member per record, and returns one index row per record: archive, offset, length, URL and digest.
The index is saved as a table before anything else happens. An archive's name is new in every
attempt of a task, so an attempt that is lost leaves a file that no index row names.

Reading: index rows are sorted by archive and offset; ranges that lie close together are fetched
in one read of a bounded size and cut into records. Any selection of index rows can be read.

Archives are opened through `pyarrow.fs`, which takes local, HDFS, S3 and GCS paths.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows, fresh_folder, is_empty, saved, whole

#: Bytes after which a new archive is begun.
ARCHIVE = 256 << 20
#: Records closer than GAP are fetched together, up to RANGE bytes at once.
GAP, RANGE = 64 << 10, 8 << 20
#: Payloads of this many bytes or more are written once, others always.
LEAST_SHARED = 0
INDEX = "page_id {id}, url string, archive string, offset bigint, length bigint, payload_digest string, record_type string, refers_to {id}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    """The same id for a page wherever it is named."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _member(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(payload)))]) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + payload + b"\r\n\r\n") + pack.flush()


def _record(page_id: object, url: str, payload: bytes, size: int, at: str, shown: str, revisit: bool, refers_to: object) -> bytes:
    """A response with its payload, or a revisit of the page named, which keeps the header only."""
    url = "".join(url.split())
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", at)]
    fields += [("WARC-Target-URI", url or f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha1:{shown}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _member([*fields, ("Content-Type", "application/http; msgtype=response")], head if revisit else head + payload)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """_id, url, _payload, _size, _digest, _refers, _revisit: one row per record. pages: _id, url, _payload.

    Of equal payloads of at least `least` bytes the largest page_id is the response; of rows that
    share it, one with the greatest URL. The others revisit it and carry no payload. A payload
    whose pages all have no id has one response too. Payloads are equal if their SHA-256 and size are.

    Rows are told apart by what they hold and counted, never by numbers given on the way: pages
    that come from a shuffle may come in another order when they are read again.
    """
    payload, shared = F.col("_payload"), F.octet_length("_payload") >= least
    digests = {"_size": F.octet_length(payload).cast("long"), "_digest": F.sha1(payload), "_key": F.sha2(payload, 256)}
    sized = pages.select("_id", "url", "_payload").withColumns(digests)
    none, no = F.lit(None).cast(pages.schema["_id"].dataType), F.lit(False)
    short = sized.filter(~shared).select("_id", "url", "_payload", "_size", "_digest", none.alias("_refers"), no.alias("_revisit"))
    keyed = sized.filter(shared)
    # Repeated rows are counted by part, so that no row of this table stands for a hot page alone.
    rows = keyed.withColumn("_part", F.spark_partition_id()).groupBy("_key", "_size", "_digest", "_id", "url", "_part").agg(F.count(F.lit(1)).alias("_n"))
    rows = saved(rows, "payload-keys")
    order = F.struct(F.col("_id").isNotNull().alias("some"), "_id", "url", "_part")
    first = rows.groupBy("_key", "_size").agg(F.max(order).alias("_first"))
    with_first = rows.join(first, ["_key", "_size"])
    same = F.col("_id").eqNullSafe(F.col("_first._id")) & F.col("url").eqNullSafe(F.col("_first.url"))
    more = F.col("_n") - F.when(same & (F.col("_part") == F.col("_first._part")), 1).otherwise(0)
    copies = with_first.withColumn("_more", more).filter("_more > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_more"))))
    again = copies.select("_id", "url", F.lit(None).cast("binary").alias("_payload"), "_size", "_digest", F.col("_first._id").alias("_refers"), F.lit(True).alias("_revisit"))
    chosen = saved(with_first.filter(same).groupBy("_key", "_size", "_id", "url").agg(F.sum("_n").alias("_same")), "responses")

    def responses(wanted: DataFrame) -> DataFrame:
        w = wanted.select(*[F.col(c).alias(f"_of{c}") for c in ("_key", "_size", "_id", "url")])
        at = [keyed[c].eqNullSafe(w[f"_of{c}"]) for c in ("_key", "_size", "_id", "url")]
        return keyed.join(w, at[0] & at[1] & at[2] & at[3]).drop(*w.columns)

    once = responses(chosen.filter("_same = 1"))
    repeated = chosen.filter("_same > 1")
    if not is_empty(repeated):
        once = once.unionByName(responses(repeated).dropDuplicates(["_key", "_size"]))
    answered = once.select("_id", "url", "_payload", "_size", "_digest", none.alias("_refers"), no.alias("_revisit"))
    return answered.unionByName(again) if least <= 0 else answered.unionByName(again).unionByName(short)


class _Archives:
    """The archives of one task: a new one is begun when the last is full."""

    def __init__(self, folder: str, begun: str, most: int):
        self.system, self.path = _open(folder)
        self.system.create_dir(self.path, recursive=True)
        self.begun, self.most = begun, most
        self.stream, self.name, self.at = None, "", 0

    def put(self, record: bytes) -> tuple[str, int, int]:
        """Archive, offset and length of the record."""
        if self.stream is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name)), ("WARC-Date", self.begun), ("Content-Type", "application/warc-fields")]
            info = _member(about, b"format: WARC File Format 1.1\r\n")
            self.stream.write(info)
            self.at = len(info)
        self.stream.write(record)
        self.at += len(record)
        return self.name, self.at - len(record), len(record)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def written(pages: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """The index, saved: one row per record. pages: what `revisits` gives."""
    arrow_rows(pages.sparkSession, 300)
    begun = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder, begun, archive)
        try:
            for batch in batches:
                rows, digests, kinds = [], [], []
                for row in batch.to_pylist():
                    shown, again = base64.b32encode(bytes.fromhex(row["_digest"])).decode(), row["_revisit"]
                    rows.append(archives.put(_record(row["_id"], row["url"] or "", row["_payload"] or b"", row["_size"], begun, shown, again, row["_refers"])))
                    digests.append(shown)
                    kinds.append("revisit" if again else "response")
                names, offsets, lengths = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id"), batch.column("url"), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                        pa.array(digests, pa.string()), pa.array(kinds, pa.string()), batch.column("_refers"),
                    ],
                    ["page_id", "url", "archive", "offset", "length", "payload_digest", "record_type", "refers_to"],
                )
        finally:
            archives.close()

    id_type = pages.schema["_id"].dataType.simpleString()
    return saved(pages.select("_id", "url", "_payload", "_size", "_digest", "_refers", "_revisit").mapInArrow(run, INDEX.format(id=id_type)), "index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[int, int, int]]:
    """(start, end, records) of reads that cover sorted (offset, length) rows."""
    out: list[tuple[int, int, int]] = []
    for offset, length in rows:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2] + 1)
        else:
            out.append((offset, offset + length, 1))
    return out


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the payload of one record."""
    plain = zlib.decompress(data, 31)
    head, _, body = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, body[: int(fields["content-length"])]


def read(index: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """The records that the index rows name: all index columns, payload_bytes, read_digest, read_type, payload.

    payload_bytes and read_digest are those of the full payload: worked out from the bytes of a
    response, as the record states them for a revisit, which has none (its payload is null).
    """
    arrow_rows(index.sparkSession, 300)
    columns = index.columns
    parts = parts or index.sparkSession.sparkContext.defaultParallelism * 2
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", payload_bytes bigint, read_digest string, read_type string, payload binary"

    def fetched(source, spans: list[tuple[int, int]]) -> Iterator[tuple[int, str, str, bytes | None]]:
        at = 0
        for start, end, count in ranges(spans):
            data = source.read_at(end - start, start)
            for offset, length in spans[at : at + count]:
                fields, block = parsed(data[offset - start : offset - start + length])
                head, _, payload = block.partition(b"\r\n\r\n")
                if fields["warc-type"] == "revisit":
                    stated = int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                    yield stated, fields["warc-payload-digest"].removeprefix("sha1:"), "revisit", None
                else:
                    yield len(payload), base32_sha1(payload), fields["warc-type"], payload
            at += count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            names, spans = batch.column("archive").to_pylist(), list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            found, at = [], 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                with system.open_input_file(f"{path}/{names[at]}") as source:
                    found.extend(fetched(source, spans[at:end]))
                at = end
            more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*columns, "payload_bytes", "read_digest", "read_type", "payload"])

    spread = index.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(run, schema)


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED) -> tuple[DataFrame, str]:
    """Writes a record per row; returns the saved index and the folder of the archives.

    Null pages have an empty payload, null URLs a name made of the page's id. Equal payloads are
    written once, as `revisits` says. No rows give no archives and an empty index.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, "warc")
    source = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.encode(whole(html_col), "UTF-8").alias("_payload"))
    return written(revisits(source, least), folder), folder
