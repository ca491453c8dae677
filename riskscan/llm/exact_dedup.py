"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and the
place in the sort becomes the block's integer name. Then each adjacent pair of names is named
the same way, level by level, until one integer is left per document. Two documents of the
same number of blocks have the same final name exactly when their texts are equal.

Names are looked up by a 128-bit key of the block, so block contents are shuffled once, after
a partial distinct, and never joined. The key is checked to be collision-free on the data;
if it were not, naming starts again with another salt. Pairs of names are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import forget, fresh, is_empty, saved, whole

#: Bytes in a block.
BLOCK = 4096
#: Runs of these count as one space.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column | str) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(whole(text), SPACE_RUN, " ")


def _blocks(df: DataFrame, block: int, salt: int) -> DataFrame:
    """One row per block, with its 128-bit key; the empty text has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / F.lit(block)).cast("int"))
    at = df.select("*", n.alias("_n")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_pos"))
    cut = F.substring("_bytes", F.col("_pos") * block + 1, F.lit(block))
    return at.withColumn("_block", cut).withColumns(
        {"_k1": F.xxhash64(F.lit(salt), "_block"), "_k2": F.xxhash64(F.lit(salt + 1), "_block")}
    )


def _named(keys: DataFrame, order: list[str]) -> DataFrame:
    """Sorted distinct keys with their place as an integer name; gaps between partitions don't matter."""
    return keys.sortWithinPartitions(*order).withColumn("_name", F.monotonically_increasing_id())


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, salt: int = 0) -> DataFrame:
    """One row per input row: `_row`, `doc_id`, `text_sha256`, and the identity `_n`, `_name`.

    Null texts count as empty; repeated rows keep a `_row` each. Other columns are not read.
    """
    source = df.select(F.col(id_col).alias("_id"), F.encode(normalised(text_col), "UTF-8").alias("_bytes"))
    cut = _blocks(source.withColumn("_row", F.monotonically_increasing_id()), block, salt)
    digest = F.when(F.col("_pos") == 0, F.sha2("_bytes", 256))
    places = saved(cut.select("_row", "_id", "_n", "_pos", "_k1", "_k2", digest.alias("_sha")), "places")
    while True:
        distinct = _blocks(source, block, salt).select("_k1", "_k2", "_block").distinct()
        names = saved(_named(distinct, ["_block"]).select("_k1", "_k2", "_name"), "names")
        if is_empty(names.groupBy("_k1", "_k2").count().filter("count > 1")):
            break
        forget(places, names)
        return identities(df, id_col, text_col, block, salt + 2)
    level = saved(places.select("_row", "_n", "_pos", "_k1", "_k2").join(names, ["_k1", "_k2"]).select("_row", "_n", "_pos", "_name"), "level")
    done, left = [level.filter("_n = 1")], level.filter("_n > 1").withColumn("_left", F.col("_n"))
    kept = [places, names, level]
    while not is_empty(left):
        first = F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name")))
        second = F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name")))
        pairs = left.groupBy("_row", "_n", F.ceil(F.col("_left") / 2).alias("_left"), F.floor(F.col("_pos") / 2).alias("_pos")).agg(
            first.alias("_a"), F.coalesce(second, F.lit(-1)).alias("_b")
        )
        pairs = saved(pairs, "pairs")
        of_pairs = saved(_named(pairs.select("_a", "_b").distinct(), ["_a", "_b"]), "names")
        level = saved(pairs.join(of_pairs, ["_a", "_b"]).select("_row", "_n", "_pos", "_left", "_name"), "level")
        forget(pairs, of_pairs)
        done.append(level.filter("_left = 1"))
        left = level.filter("_left > 1")
        kept.append(level)
    ends = done[0].select("_row", "_n", "_name")
    for more in done[1:]:
        ends = ends.unionByName(more.select("_row", "_n", "_name"))
    rows = places.filter("_pos = 0").select("_row", F.col("_id").alias("doc_id"), F.col("_sha").alias("text_sha256"))
    out = saved(rows.join(ends, "_row"), "identities")
    forget(*kept)
    return out


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space runs become one space. Of equal texts
    the row with the smallest doc_id stays; a null id comes last, and of repeated rows with
    that id exactly one stays. Null texts equal the empty text. No rows give no rows.
    """
    rows = identities(df, id_col, text_col, block)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    groups = rows.groupBy("_n", "_name").agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    # Written first: a join of two tables can be split at a hot group, one that ends a grouping can't.
    groups = saved(groups, "groups")
    return rows.join(groups, ["_n", "_name"]).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256"
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns; of repeated rows one."""
    groups = saved(exact_groups(df, id_col, text_col), "exact")
    keep, sha = fresh(df, "_keep"), fresh(df, "_sha")
    stay = groups.filter("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(sha))
    digest = F.sha2(F.encode(normalised(df[text_col]), "UTF-8"), 256)
    # A row stays if its id and text do; ids that occur once, which is usual, need no more than this.
    kept = df.join(stay, df[id_col].eqNullSafe(stay[keep]) & (digest == stay[sha]), "left_semi")
    again = groups.groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if is_empty(again):
        return kept
    return kept.withColumn(sha, F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)).dropDuplicates([id_col, sha]).drop(sha)
