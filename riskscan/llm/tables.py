"""Written tables in the shared folder, and small helpers the operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.operators.skew import checkpoint_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of `spark.checkpoint.dir`."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later steps survive a lost executor.

    The path is kept on the frame, so that `forget` can remove what is no longer needed.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


def forget(*frames: DataFrame | None) -> None:
    """Removes tables that `saved` wrote; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "saved_at", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be none of the frame's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """At most this many rows go to Python at once: texts are long and workers share little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
SPACES = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, size: int = PIECE):
    """A long text in parts that end at white space, so that no word is cut."""
    start = 0
    while len(data) - start > size:
        cut = SPACES.search(data, start + size)
        if cut is None:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:]


#: Characters of a text that are lower-cased and split at a time.
PIECE_CHARS = 1 << 20
WORD = re.compile(r"\w+")


def word_pieces(text: str, size: int = PIECE_CHARS):
    """The lower-case words of a text in lists, each from a part of the text that ends between words."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and (text[cut].isalnum() or text[cut] == "_"):
            cut += 1
        yield WORD.findall(text[start:cut].lower())
        start = cut
    yield WORD.findall(text[start:].lower())
