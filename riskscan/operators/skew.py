"""Building blocks that stay even when one key holds a large part of all rows.

Windows over a hot key put all its rows into one task. The helpers here split a key by a
hash or by time first, reduce each part, and only bring bounded summaries together.
Joins are left to adaptive execution, which splits skewed join partitions at run time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SALTS = 32
#: Rows per key up to which Spark's window group limit applies (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
BROADCAST_ROWS = 100_000


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str | Column],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first k rows per key with their rank, exactly.

    Up to GROUP_LIMIT rows, Spark itself keeps the first k of each key in every task before the
    shuffle, so one window is enough, hot keys or not. Beyond it every key is cut into `salts`
    parts by a hash of the `spread` columns; each part keeps its own first k, so the final window
    sees at most `salts * k` rows per key. `order` must be total within a key for the result to
    be repeatable.
    """
    if k <= GROUP_LIMIT:
        return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= k)
    whole = W.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k).drop("_salt")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The first row per key by `order`. A plain aggregate, so it is combined before the shuffle."""
    rest = F.struct(*order, *[v for v in values if v not in order])
    return df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_first")).select(
        *keys, *[F.col(f"_first.{v}").alias(v) for v in values if v not in keys]
    )


def split_running(
    df: DataFrame, key: str, order: Sequence[Column], bucket: Column, sums: dict[str, Column]
) -> DataFrame:
    """Running sums per key, with each key cut into time buckets.

    Sums run inside a bucket; what came before is added from one summary row per bucket.
    `order` must not put a row of a later bucket before a row of an earlier one.
    """
    b = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = b.groupBy(key, "_bucket").agg(*[F.sum(c).alias(f"_{n}_total") for n, c in sums.items()])
    totals = totals.select(
        key, "_bucket", *[F.coalesce(F.sum(f"_{n}_total").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums]
    )
    running = b.select("*", *[F.sum(c).over(inside).alias(f"_{n}_in") for n, c in sums.items()])
    joined = running.join(totals, [key, "_bucket"])
    return joined.select(
        *df.columns, *[(F.col(f"_{n}_in") + F.col(f"_{n}_before")).alias(n) for n in sums]
    )


def split_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, str]
) -> DataFrame:
    """Previous value per key, with each key cut into time buckets.

    `values` maps output names to columns. The first row of a bucket takes the last row of
    the nearest earlier bucket that has rows.
    """
    b = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    last = b.groupBy(*keys, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carried = last.select(
        *keys, "_bucket", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carried")
    )
    local = b.withColumn("_local", F.lag(packed).over(inside))
    joined = local.join(carried, [*keys, "_bucket"])
    previous = F.coalesce(F.col("_local"), F.col("_carried"))
    return joined.withColumn("_prev", previous).select(
        *df.columns, *[F.col(f"_prev.{n}").alias(n) for n in values]
    )


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Has the table at most this many rows? Reads no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the row count is within the bound; else the table as it is."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the source has fewer partitions than there are cores.

    A small file with one row group would keep one core busy. A large table always has more
    partitions than cores and is left alone, so no large table is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Where it is unset a local session gets a fresh folder of its own; on a cluster that
    would not be shared, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    import tempfile

    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    sc.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The folder in the shared folder that holds all tables this application writes on its way."""
    return f"{checkpoint_dir(spark).rstrip('/')}/riskscan-{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Removes every table `written` made; call it when the results of a run are stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows written once as a table in the shared folder and read back.

    Everything built on the result starts from the table: it is not computed again when
    read twice or when an executor is lost, reads stay columnar, and its size is known.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
