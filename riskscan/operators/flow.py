"""Which definitions of a variable reach a use of it, line by line, without a syntax tree.

A definition holds in the block it stands in, which ends at the first line that is indented less.
For a use inside that block the last such definition hides all before it: what was assigned anew, or
cleaned, is the new value. Definitions in blocks that have ended since, such as one branch of a
condition, may reach the use as well and hide nothing. In a loop, definitions further down reach a
use in the next round, unless one in the loop itself stands before the use.

All of it is windows and joins over the lines of a function: the last line before each line that is
indented less, for each indentation the function has; the last definition before each use, for each
indentation; and a chain of nodes "any definition from the k-th to the i-th", which makes as many
edges as there are definitions and not one per definition and use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _node(key: Sequence[str], kind: str, *parts: str) -> Column:
    return F.concat_ws("\x01", *key, F.lit(kind), *[F.col(p).cast("string") for p in parts])


def enclosing(lines: DataFrame, definitions: DataFrame, key: Sequence[str]) -> DataFrame:
    """(*key, pos, level, before, loop): for each line and level the last line before it that is indented less, and whether that opens a loop.

    `lines(*key, pos, indent, is_loop)`. Levels are the indentations of the function's lines and definitions.
    """
    there = lines.select(*key, F.col("indent").alias("level")).unionByName(definitions.select(*key, "level")).groupBy(*key).agg(F.collect_set("level").alias("_levels"))
    each = lines.join(there, list(key)).select(*key, "pos", "indent", "is_loop", F.explode("_levels").alias("level"))
    upto = W.partitionBy(*key, "level").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.max(F.when(F.col("indent") < F.col("level"), F.struct("pos", "is_loop"))).over(upto)
    return each.withColumn("_last", last).select(*key, "pos", "indent", "level", F.col("_last.pos").alias("before"), F.coalesce("_last.is_loop", F.lit(False)).alias("loop"))


def reaching(lines: DataFrame, definitions: DataFrame, uses: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The definitions that reach each use: (*key, name, pos, node), and edges (src, dst) into these nodes.

    `lines(*key, pos, indent, is_loop)`; `definitions(*key, name, pos, level)` with the indentation
    of the block they hold in; `uses(*key, name, pos)`. The node of a definition is `definition_node`.
    A line's uses come before its own definition. Uses without any definition before them have none.
    """
    key = list(key)
    name = [*key, "name"]
    order = W.partitionBy(*name).orderBy("pos")
    # Of several definitions of a name on one line there is one.
    defs = definitions.groupBy(*name, "pos").agg(F.min("level").alias("level")).withColumn("nr", F.row_number().over(order))
    used = uses.select(*name, "pos").distinct()
    around = enclosing(lines, definitions, key)
    # The last definition of each level before a use hides the earlier ones if no line between them is indented less.
    asked = used.join(around.select(*key, "pos", "level", "before"), [*key, "pos"])
    both = asked.withColumn("_kind", F.lit(0)).unionByName(defs.select(*name, "pos", "level", "nr").withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    upto = W.partitionBy(*name, "level").orderBy("pos", "_kind").rowsBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("_last", F.max(F.when(F.col("_kind") == 1, F.struct("pos", "nr"))).over(upto)).where("_kind = 0")
    # What a line opens, a loop or a `with`, holds in its block: that line itself is the one indented less.
    hides = F.when(F.col("_last.pos") >= F.coalesce("before", F.lit(-1)), F.col("_last"))
    hidden = seen.groupBy(*name, "pos").agg(F.max(hides).alias("k"))
    mixed = used.withColumn("_kind", F.lit(0)).unionByName(defs.select(*name, "pos", "nr").withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    before = W.partitionBy(*name).orderBy("pos", "_kind").rowsBetween(W.unboundedPreceding, -1)
    counted = mixed.withColumn("i", F.coalesce(F.max("nr").over(before), F.lit(0))).where("_kind = 0").select(*name, "pos", "i")
    states = counted.join(hidden, [*name, "pos"], "left").select(
        *name, "pos", "i", F.greatest(F.coalesce("k.nr", F.lit(1)), F.lit(1)).alias("k"), F.coalesce("k.pos", F.lit(-1)).alias("hidden_at")
    )
    to_state = states.where("i > 0").select(*name, "pos", _node(name, "s", "k", "i").alias("node"))
    spans = states.where("i > 0").groupBy(*name, "k").agg(F.max("i").alias("_most"))
    links = spans.withColumn("i", F.explode(F.sequence("k", "_most"))).withColumn("_h", F.col("i") - 1)
    own = links.select(_node(name, "d", "i").alias("src"), _node(name, "s", "k", "i").alias("dst"))
    onward = links.where("i > k").select(_node(name, "s", "k", "_h").alias("src"), _node(name, "s", "k", "i").alias("dst"))
    # Loops: the lines around a use that open one, and the definitions inside the outermost of them.
    loops = around.where(F.col("loop") & (F.col("level") <= F.col("indent"))).groupBy(*key, "pos").agg(F.max("before").alias("inner"), F.min("before").alias("outer"))
    carried = states.join(loops, [*key, "pos"]).where("hidden_at < inner")
    to_loop = carried.select(*name, "pos", _node(name, "l", "outer").alias("node"))
    inside = defs.join(loops.select(*key, "pos", "outer"), [*key, "pos"])
    rounds = inside.select(_node(name, "d", "nr").alias("src"), _node(name, "l", "outer").alias("dst"))
    return to_state.unionByName(to_loop), own.unionByName(onward).unionByName(rounds)


def numbered(definitions: DataFrame, key: Sequence[str]) -> DataFrame:
    """The definitions with their number and node, as `reaching` has them."""
    name = [*key, "name"]
    defs = definitions.groupBy(*name, "pos").agg(F.min("level").alias("level"))
    defs = defs.withColumn("nr", F.row_number().over(W.partitionBy(*name).orderBy("pos")))
    return defs.withColumn("node", _node(name, "d", "nr"))
