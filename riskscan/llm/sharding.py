"""Shards of near equal size that keep linked documents together: balanced label propagation.

Linked documents start in shards by a hash. In each round every document looks at the shards of
its group's members (a join of the groups' counts per shard, never pairs of members) and asks to
move to the shard that holds most of them. A quota for each pair of shards decides how much may
move: what goes both ways, and beyond that what the goal has room for, so that no shard gets more
than its even part. Larger gains go first, whole groups together, and a group that doesn't fit is
cut; what is left turns to other shards with room. Rounds end when nobody asks to move. Documents without links then fill every shard up to the
even part, along running sums of their sizes.

All steps are DataFrame operations. What reaches the driver is a table of shards by shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskscan.llm.tables import forget, saved, whole

SHARDS = 8
#: Rounds after which propagation stops even if documents could still move: it settles long before.
ROUNDS = 30
#: Parts that movers are dealt to by group, and that a part is dealt to where a quota cuts it.
PARTS, FINE_PARTS = 64, 1024
#: Rows in a part of a running sum.
PART_ROWS = 20_000


def _bucket(column: str, buckets: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(buckets))


def _lookup(values: dict[int, float], key: Column) -> Column:
    """A small table of numbers as an expression; 0 where it has none."""
    if not values:
        return F.lit(0.0)
    pairs = [x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def quotas(wanted: dict[tuple[int, int], float], room: dict[int, float]) -> dict[tuple[int, int], float]:
    """Bytes that may move between each pair of shards: swaps, and what the goal has room for."""
    allowed = {(a, b): min(size, wanted.get((b, a), 0.0)) for (a, b), size in wanted.items()}
    for goal in {b for _, b in wanted}:
        rest = {a: size - allowed[a, b] for (a, b), size in wanted.items() if b == goal}
        free = max(0.0, room.get(goal, 0.0))
        share = min(1.0, free / sum(rest.values())) if sum(rest.values()) > 0 else 0.0
        for a, size in rest.items():
            allowed[a, goal] += size * share
    return allowed


def _accepted(movers: DataFrame, allowed: dict[tuple[int, int], float], shards: int) -> DataFrame:
    """The movers within the quotas; movers: _row, _size, _shard, _goal, _gain, _group."""
    way = F.col("_shard") * shards + F.col("_goal")
    quota = _lookup({a * shards + b: size for (a, b), size in allowed.items()}, F.col("_way"))
    rank = F.least(F.lit(40), F.floor(F.log2(F.col("_gain").cast("double")))).cast("int")
    dealt = movers.withColumns({"_way": way, "_rank": rank, "_part": _bucket("_group", PARTS, "group"), "_fine": _bucket("_row", FINE_PARTS, "row")})
    order = W.partitionBy("_way").orderBy(F.desc("_rank"), "_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = dealt.groupBy("_way", "_rank", "_part").agg(F.sum("_size").alias("_bytes"))
    parts = parts.withColumn("_end", F.sum("_bytes").over(order)).withColumn("_room", quota - (F.col("_end") - F.col("_bytes")))
    parts = parts.filter("_room > 0").select("_way", "_rank", "_part", (F.col("_bytes") <= F.col("_room")).alias("_all"), "_room")
    # At most shards^2 * 41 * PARTS rows, whatever the input.
    at = dealt.join(F.broadcast(parts), ["_way", "_rank", "_part"])
    inner = W.partitionBy("_way", "_rank", "_part").orderBy("_fine").rowsBetween(W.unboundedPreceding, W.currentRow)
    fine = at.filter("not _all").groupBy("_way", "_rank", "_part", "_fine", "_room").agg(F.sum("_size").alias("_bytes"))
    fine = fine.withColumn("_end", F.sum("_bytes").over(inner)).filter("_end <= _room").select("_way", "_rank", "_part", "_fine")
    cut = at.filter("not _all").join(fine, ["_way", "_rank", "_part", "_fine"], "left_semi")
    return at.filter("_all").select("_row", "_goal").union(cut.select("_row", "_goal"))


def propagated(nodes: DataFrame, links: DataFrame, even: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """_row, _size, _shard of linked documents after propagation.

    nodes: _row, _size. links: _row, _group; members of a group are linked, and a document may be
    in several groups. even: the size that no shard may pass by a move.
    """
    labels = saved(nodes.select("_row", "_size", _bucket("_row", shards, "start").cast("int").alias("_shard")), "labels")
    closed: set[int] = set()
    for _ in range(rounds):
        load = {r["_shard"]: float(r["_bytes"]) for r in labels.groupBy("_shard").agg(F.sum("_size").alias("_bytes")).collect()}
        room = {s: even - load.get(s, 0.0) for s in range(shards)}
        counts = [F.count_if(F.col("_shard") == s).alias(f"_c{s}") for s in range(shards)]
        groups = saved(links.join(labels.select("_row", "_shard"), "_row").groupBy("_group").agg(*counts), "counts")
        seen = links.join(groups, "_group").groupBy("_row").agg(F.min("_group").alias("_group"), *[F.sum(f"_c{s}").alias(f"_c{s}") for s in range(shards)])
        here = seen.join(labels, "_row")
        # Shards with room, and the own one; equal ones in an order that a group's members share.
        choices = [
            F.struct(F.col(f"_c{s}").alias("n"), F.xxhash64("_group", F.lit(s)).alias("tie"), F.lit(s).alias("shard"), (F.col("_shard") == s).alias("own"))
            for s in range(shards)
        ]
        open_ones = [F.when((F.col("_shard") == s) | F.lit(room[s] > 0 and s not in closed), choices[s]) for s in range(shards)]
        all_counts = F.array(*[F.col(f"_c{s}") for s in range(shards)])
        best = here.withColumns({"_best": F.greatest(*open_ones), "_own": F.element_at(all_counts, F.col("_shard") + 1)})
        movers = best.filter("_best.shard != _shard").select(
            "_row", "_size", "_shard", F.col("_best.shard").alias("_goal"), F.greatest(F.lit(1), F.col("_best.n") - F.col("_own") + 1).alias("_gain"), "_group"
        )
        movers = saved(movers, "movers")
        wanted = {(r["_shard"], r["_goal"]): float(r["_bytes"]) for r in movers.groupBy("_shard", "_goal").agg(F.sum("_size").alias("_bytes")).collect()}
        accepted = saved(_accepted(movers, quotas(wanted, room), shards), "accepted")
        got = {r["_goal"] for r in accepted.select("_goal").distinct().collect()}
        # A shard too full for any of those that ask is none to ask for: they turn to others.
        refused = {goal for _, goal in wanted} - got
        closed |= refused
        if got:
            after = saved(labels.join(accepted, "_row", "left").select("_row", "_size", F.coalesce("_goal", "_shard").alias("_shard")), "labels")
            forget(labels)
            labels = after
        forget(movers, accepted, groups)
        if not got and not refused:
            break
    return labels


def _parts(rows: int) -> int:
    """How many parts a running sum over so many rows is cut into."""
    return 1 << max(4, math.ceil(math.log2(max(1, rows / PART_ROWS))))


def filled(rest: DataFrame, deficits: list[float], rows: int) -> DataFrame:
    """_row, _size, _shard of unlinked documents, dealt out along their running size to the shards' deficits."""
    parts = _parts(rows)
    dealt = rest.withColumn("_part", _bucket("_row", parts, "fill"))
    sums = dealt.groupBy("_part").agg(F.sum("_size").alias("_bytes"))
    before = sums.select("_part", (F.sum("_bytes").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_bytes")).alias("_before"))
    inner = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("_before") + F.sum("_size").over(inner) - F.col("_size") / 2
    placed = dealt.join(before, "_part").withColumn("_at", middle)
    shard, end = None, 0.0
    for s, deficit in enumerate(deficits):
        end += deficit
        test = F.col("_at") < end
        shard = F.when(test, s) if shard is None else shard.when(test, s)
    last = max((s for s, d in enumerate(deficits) if d > 0), default=len(deficits) - 1)
    return placed.select("_row", "_size", shard.otherwise(last).alias("_shard"))


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    The law is `bytes`: shards have near equal sizes, apart by about one document. Linked
    documents are those of equal text. size is the UTF-8 length plus 1 (null: none, so 1), slot
    counts from 0 in each shard without gaps, grown_shard is null under this law. Null texts are
    equal to empty ones. Repeated rows get a place each. No rows give no rows.
    """
    text = whole(text_col)
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), size.alias("_size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(F.encode(text, "UTF-8"), 256).alias("_sha"))
    rows = saved(rows, "rows")
    groups = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_group")).filter("_n > 1").select("_sha", "_group")
    # Written first: a join of two tables can be split at a hot group, one that ends a grouping can't.
    groups = saved(groups, "groups")
    links = saved(rows.join(groups, "_sha").select("_row", "_size", "_group"), "links")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes")).first()
    even = float(total["bytes"] or 0) / shards
    linked = propagated(links.select("_row", "_size"), links.select("_row", "_group"), even, shards)
    load = {r["_shard"]: float(r["_bytes"]) for r in linked.groupBy("_shard").agg(F.sum("_size").alias("_bytes")).collect()}
    deficits = [max(0.0, even - load.get(s, 0.0)) for s in range(shards)]
    unlinked = float(total["bytes"] or 0) - sum(load.values())
    scale = unlinked / sum(deficits) if sum(deficits) > 0 else 0.0
    rest = rows.select("_row", "_size").join(links.select("_row"), "_row", "left_anti")
    fill = filled(rest, [d * scale for d in deficits], total["n"])
    placed = linked.unionByName(fill).select("_row", "_shard").join(rows.drop("_sha"), "_row")
    placed = saved(placed.withColumn("_part", _bucket("_row", _parts(total["n"]), "slot")), "placed")
    sums = placed.groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy("_shard").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = sums.select("_shard", "_part", (F.sum("_n").over(running) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_shard", "_part").orderBy("_row")) - 1
    out = placed.join(before, ["_shard", "_part"]).withColumn("slot", (F.col("_before") + within).cast("long"))
    forget(rows, links)
    return out.select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
