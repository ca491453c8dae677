"""Near duplicates by SimHash fingerprints, candidates pruned by the pigeonring principle.

A fingerprint has 64 bits in four segments on a ring, and two fingerprints link at three or
fewer differing bits. If they do, there is a start on the ring from which every chain of 1, 2,
3, 4 consecutive segments differs in at most 0, 1, 2, 3 bits (the proportional budgets, rounded
down). Candidates therefore share a whole segment and, within the next, all but one bit; one of
four parts of that next segment takes the difference, so each fingerprint is stored under 16
keys of 28 bits. The longer chains and then the full distance are checked on candidates only.

Links are worked out between distinct fingerprints, so exact copies cost nothing. Inside a key
every fingerprint is first compared with one leader. Only fingerprints that are still in another
component than their leader are compared with the rest of the key, so a dense cluster never
becomes all its pairs and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.llm.components import components
from riskscan.llm.tables import arrow_rows, forget, fresh, is_empty, pieces, saved, whole

#: Words in a shingle, seed of its hash, bits that may differ.
WORDS, SEED, DISTANCE = 3, 42, 3
SEGMENTS, SEGMENT_BITS = 4, 16
#: The segment after the shared one is cut into so many parts; the differing bit is in one of them.
PARTS = 4
PART_BITS = SEGMENT_BITS // PARTS


def shingle_hashes(data: bytes, size: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a UTF-8 text, in pieces; bytes.lower changes A-Z only."""
    carried: list[bytes] = []
    made = False
    digest = xxhash.xxh64_intdigest
    for piece in pieces(data):
        words = carried + piece.lower().split()
        if len(words) >= size:
            made = True
            shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
            yield np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(words) - size + 1)
            words = words[len(words) - size + 1 :]
        carried = words
    if carried and not made:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(data: bytes) -> int:
    """The signed 64-bit fingerprint: a bit is set if it is in over half the hashes."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    bits = np.packbits((2 * counts > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _fp per row; null and empty texts and texts of white space have fingerprint zero."""
    arrow_rows(df.sparkSession, 500)
    source = df.select(F.col(id_col).alias("_id"), F.encode(whole(text_col), "UTF-8").alias("_data"))

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x.as_buffer().to_pybytes()) for x in batch.column("_data")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints, pa.int64())], ["_id", "_fp"])

    id_type = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {id_type}, _fp bigint")


def _keys() -> Column:
    """The 16 keys of `_fp`: start and part, the shared segment, the next segment without the part."""
    full = (1 << SEGMENT_BITS) - 1
    keys = []
    for start in range(SEGMENTS):
        own = F.shiftrightunsigned("_fp", SEGMENT_BITS * start).bitwiseAND(F.lit(full))
        after = F.shiftrightunsigned("_fp", SEGMENT_BITS * ((start + 1) % SEGMENTS)).bitwiseAND(F.lit(full))
        for part in range(PARTS):
            rest = after.bitwiseAND(F.lit(full & ~(((1 << PART_BITS) - 1) << (PART_BITS * part))))
            keys.append(F.lit((start * PARTS + part) << 32) + F.shiftleft(own, SEGMENT_BITS) + rest)
    return F.array(*keys)


def viable(a: str, b: str, key: str) -> Column:
    """Every chain from the key's start is within its budget; the last chain is the full distance."""
    turn = f"cast(shiftrightunsigned({key}, 34) * {SEGMENT_BITS} as int)"
    differ = f"({a} ^ {b})"
    ring = f"(shiftrightunsigned({differ}, {turn}) | shiftleft({differ}, 64 - {turn}))"
    tests = [f"bit_count({ring} & {(1 << SEGMENT_BITS * n) - 1}L) <= {n * DISTANCE // SEGMENTS}" for n in range(1, SEGMENTS)]
    return F.expr(" and ".join([*tests, f"bit_count({differ}) <= {DISTANCE}"]))


def linked(prints: DataFrame) -> DataFrame:
    """node, root: each distinct fingerprint that links with another, with its component.

    prints: _fp, _weight (how many documents have it), a row per fingerprint.
    """
    keyed = prints.select("_fp", "_weight", F.explode(_keys()).alias("_key"))
    # The most frequent fingerprint leads: near copies lie around the text they were made from.
    heads = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max_by("_fp", "_weight").alias("_lead"))
    shared = saved(keyed.join(heads.filter("_n > 1").drop("_n"), "_key").select("_key", "_fp", "_lead"), "keys")
    star = shared.filter((F.col("_fp") != F.col("_lead")) & viable("_fp", "_lead", "_key"))
    first = components(star.select("_fp", "_lead"), "_fp", "_lead")

    own = first.select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    lead = first.select(F.col("node").alias("_lead"), F.col("root").alias("_lead_root"))
    placed = shared.join(own, "_fp", "left").join(lead, "_lead", "left")
    placed = placed.withColumns({"_root": F.coalesce("_root", "_fp"), "_lead_root": F.coalesce("_lead_root", "_lead")})
    placed = saved(placed.select("_key", "_fp", "_root", "_lead_root"), "placed")
    outside = placed.filter("_root != _lead_root").select("_key", F.col("_fp").alias("_other"), F.col("_root").alias("_other_root"))
    rest = outside.join(placed, "_key").filter((F.col("_root") != F.col("_other_root")) & viable("_fp", "_other", "_key"))
    second = components(rest.select("_root", "_other_root").distinct(), "_root", "_other_root")
    above = second.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    tops = first.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    # Roots of the first round that had no edge there are nodes of the second only.
    alone = second.join(first.select("node"), "node", "left_anti").select("node", "root")
    out = saved(tops.unionByName(alone), "linked")
    forget(shared, first, placed, second)
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links, its own included; a null id is
    larger than all. Null, empty and white texts have fingerprint zero and link like any other.
    Texts of fewer than three words are one shingle. No rows give no rows. Only the two named
    columns are read.
    """
    rows = saved(fingerprints(df, id_col, text_col), "prints")
    prints = saved(rows.groupBy("_fp").agg(F.count(F.lit(1)).alias("_weight"), F.min("_id").alias("_least")), "distinct")
    links = linked(prints)
    placed = prints.join(links.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    placed = saved(placed.select("_fp", "root", "_least"), "placed")
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = placed.join(least, "root").select("_fp", "component_id")
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return rows.join(classes, "_fp").select(F.col("_id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` of which one per component stays: that with the smallest id.

    Of rows that repeat this id one stays. Rows without an id can't be told apart, so all stay.
    """
    groups = saved(near_groups(df, id_col, text_col), "near")
    keep, twice = fresh(df, "_keep"), fresh(df, "_twice")
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(keep))
    again = stay.groupBy(keep).count().filter("count > 1").select(F.col(keep).alias(twice))
    kept = df.join(stay, df[id_col] == stay[keep], "left_semi")
    if not is_empty(again):
        once = kept.join(again, kept[id_col] == again[twice], "left_anti")
        kept = once.unionByName(kept.join(again, kept[id_col] == again[twice], "left_semi").dropDuplicates([id_col]))
    if is_empty(groups.filter(F.col("doc_id").isNull())):
        return kept
    return kept.unionByName(df.filter(df[id_col].isNull()))
