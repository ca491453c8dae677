"""Tool names across servers: collisions, look-alikes, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.functions import text as T
from riskscan.operators.skew import top_k


def last_two_servers(tools: DataFrame) -> DataFrame:
    """Per tool name the last and the second-to-last server that uses it.

    Two servers per name are all that "some other server" needs, which avoids joining the
    tools with themselves on popular names. `server_seq` orders servers when present.
    """
    order = [F.col("server_seq").desc()] if "server_seq" in tools.columns else []
    used = tools.groupBy("name", "server_id").agg(
        *([F.max("server_seq").alias("server_seq")] if order else [F.count(F.lit(1)).alias("_n")])
    )
    two = top_k(used, ["name"], [*order, F.col("server_id").desc()], 2, ["server_id"])
    return two.groupBy("name").agg(
        F.max(F.when(F.col("rank") == 1, F.col("server_id"))).alias("last_server"),
        F.max(F.when(F.col("rank") == 2, F.col("server_id"))).alias("second_server"),
    )


def other_server(server: Column) -> Column:
    """From the columns of `last_two_servers`: the last user of the name that is not `server`."""
    return F.when(F.col("last_server") == server, F.col("second_server")).otherwise(F.col("last_server"))


def name_collisions(tools: DataFrame) -> DataFrame:
    """Tools whose name another server uses too, with that server."""
    joined = tools.join(last_two_servers(tools), "name").withColumn("peer", other_server(F.col("server_id")))
    return joined.where(F.col("peer").isNotNull()).drop("last_server", "second_server")


def lookalike_names(tools: DataFrame) -> DataFrame:
    """Tools with a non-ASCII name, and whether its ASCII skeleton is a known tool name."""
    odd = tools.where(F.col("name").rlike(T.NON_ASCII)).withColumn("skeleton", T.ascii_skeleton(F.col("name")))
    known = tools.select(F.col("name").alias("skeleton"), F.lit(True).alias("known")).distinct()
    return odd.join(known, "skeleton", "left").withColumn(
        "copies", F.coalesce(F.col("known") & (F.col("skeleton") != F.col("name")), F.lit(False))
    ).drop("known")


def duplicate_names(tools: DataFrame) -> DataFrame:
    """Names that one server lists more than once, with the count."""
    counts = tools.groupBy("server_id", "name").agg(F.count(F.lit(1)).alias("copies"), F.min("seq").alias("seq"))
    return counts.where(F.col("copies") > 1)
