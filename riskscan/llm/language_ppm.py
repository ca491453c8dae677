"""The language of texts by prediction by partial matching.

Each language has a tree of byte contexts of up to `ORDER` bytes with the counts of the bytes that
follow. A byte costs -log2(n / (N + d)) bits in the longest context of the text that the tree holds,
where n of N bytes after it were this one and d different ones were seen. If it never followed, an
escape costs -log2(d / (N + d)) bits and the context one byte shorter is asked; below the empty
context a byte costs 8 bits. Contexts that the tree doesn't hold cost nothing to leave. The
statistics are frozen: a text's code length is the sum over all its bytes, and the language with the
shortest code is predicted. Its score is its share among the languages if each has the probability
2^-length.

Trees are sorted arrays of whole contexts, at most eight bytes as one number, so nothing is hashed.
They are learned from a bounded sample of labelled texts and sent to all tasks; texts stay in their
rows and are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows, saved

#: Bytes of the longest context; up to 7 fit.
ORDER = 4
#: The sample has at most this many rows and characters of a language, and characters of all languages together.
SAMPLE_ROWS, SAMPLE_CHARS, ALL_CHARS = 800, 500_000, 16_000_000
#: Bytes of texts that are scored as one array.
TOGETHER = 1 << 20
UNKNOWN = "und"
#: Values of the hash that orders ids.
HASHES = 1 << 40


class Level(NamedTuple):
    """The contexts of one length: what follows costs, and what an escape costs."""

    follows: np.ndarray
    cost: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


class Model(NamedTuple):
    """One tree per language, as levels from the empty context on."""

    languages: list[str]
    trees: list[list[Level]]


def _grams(parts: list[tuple[bytes, bytes]], order: int = ORDER) -> np.ndarray:
    """Each byte of each part with the `order` bytes before it as one number. Parts: what stands before, text.

    A text begins after zero bytes.
    """
    data = np.frombuffer(b"".join(before.rjust(order, b"\0") + text for before, text in parts), np.uint8).astype(np.uint64)
    grams = data.copy()
    for back in range(1, order + 1):
        grams[back:] |= data[:-back] << np.uint64(8 * back) if back < len(data) else 0
    keep = np.ones(len(data), bool)
    at = 0
    for _, text in parts:
        keep[at : at + order] = False
        at += order + len(text)
    return grams[keep]


def _low(grams: np.ndarray, size: int) -> np.ndarray:
    """The last `size` bytes."""
    return grams & np.uint64((1 << (8 * size)) - 1)


def tree(texts: list[bytes], order: int = ORDER) -> list[Level]:
    """The context tree of texts."""
    grams = _grams([(b"", t) for t in texts], order)
    levels = []
    for size in range(order + 1):
        follows, n = np.unique(_low(grams, size + 1), return_counts=True)
        contexts, where = np.unique(follows >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(where, weights=n, minlength=len(contexts)), np.bincount(where, minlength=len(contexts))
        cost = -np.log2(n / (total + kinds)[where])
        levels.append(Level(follows, cost, contexts, -np.log2(kinds / (total + kinds))))
    return levels


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def bits(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """The code length of the last byte of each gram."""
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    for size in range(len(levels) - 1, -1, -1):
        level, own = levels[size], _low(grams[left], size + 1)
        at, there = _find(level.follows, own)
        out[left[there]] += level.cost[at[there]]
        left, own = left[~there], own[~there] >> np.uint64(8)
        at, there = _find(level.contexts, own)
        out[left[there]] += level.escape[at[there]]
    out[left] += 8
    return out


def lengths(texts: list[bytes], model: Model) -> np.ndarray:
    """Bits of each text (rows) by each language's tree (columns)."""
    order = len(model.trees[0]) - 1
    out = np.zeros((len(texts), len(model.trees)))

    def add(parts: list[tuple[int, bytes, bytes]]) -> None:
        # Equal grams of many texts are looked up once.
        found, where = np.unique(_grams([p[1:] for p in parts], order), return_inverse=True)
        rows, sizes = np.array([p[0] for p in parts]), np.array([len(p[2]) for p in parts])
        begins = np.cumsum(sizes) - sizes
        for k, levels in enumerate(model.trees):
            np.add.at(out[:, k], rows, np.add.reduceat(bits(found, levels)[where], begins))

    held, size = [], 0
    for row, text in enumerate(texts):
        for start in range(0, len(text), TOGETHER):
            part = text[start : start + TOGETHER]
            held.append((row, text[max(0, start - order) : start], part))
            size += len(part)
            if size >= TOGETHER:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    return out


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, together: int = ALL_CHARS) -> DataFrame:
    """lang, text of at most `rows` texts of each language and `chars` characters of them together.

    With many languages each has an equal part of `together` characters. The texts are picked by a
    hash of the id among those with a letter and read in windows of equal length that begin at a
    place given by that hash; rows without a language don't count. labelled: doc_id, text, lang.
    Languages are a set of tags, each of which is a part of the model.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).withColumn("_h", F.xxhash64("doc_id"))
    ids = usable.filter("doc_id is not null").select("doc_id", "lang", "_h")
    # Only the lowest hashes can be picked: a language with more ids than wanted sends its share of them to the window.
    share = F.least(F.lit(1.0), F.lit(8.0 * rows) / F.approx_count_distinct("doc_id"))
    wanted = ids.groupBy("lang").agg(F.floor(share * F.lit(float(HASHES))).alias("_below"))
    low = ids.join(F.broadcast(wanted), "lang").filter(F.pmod("_h", F.lit(HASHES)) <= F.col("_below"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(HASHES)), "doc_id"))
    picked = saved(low.distinct().withColumn("_k", place).filter(F.col("_k") <= rows), "picked")
    counted = picked.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    each = max(1, min(chars, together // max(1, counted.count())))
    picked = picked.join(F.broadcast(counted.withColumn("_most", F.greatest(F.lit(1), F.floor(F.lit(each) / F.col("_n"))).cast("int"))), "lang")
    begin = F.pmod(F.col("_h"), F.greatest(F.lit(1), F.length("text") - F.col("_most") + 1)).cast("int") + 1
    own = usable.join(F.broadcast(picked.select("doc_id", "lang", "_most")), ["doc_id", "lang"])
    # Rows that repeat an id count once.
    return own.groupBy("doc_id", "lang").agg(F.max(F.substr("text", begin, F.col("_most"))).alias("text")).select("lang", "text")


def fitted(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, together: int = ALL_CHARS, order: int = ORDER) -> Model:
    """A model of the languages in `labelled` (doc_id, text, lang)."""
    got = sample(labelled, rows, chars, together).toPandas()
    languages = sorted(got["lang"].unique().tolist())
    return Model(languages, [tree([t.encode() for t in got.loc[got["lang"] == x, "text"]], order) for x in languages])


def predicted(df: DataFrame, model: Model, text_col: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns with the predicted language and its score from 0 to 1.

    `und` with score 0 are null texts, texts without a letter, and all texts if the model has no
    language. Of equal lengths the language first by name is predicted. Columns of the two names
    are replaced; no others are read or changed. Texts are read whole, long ones in parts.
    """
    spark = df.sparkSession
    arrow_rows(spark, 300)
    kept = [c for c in df.columns if c not in (name, score)]
    inner, answer = f"_text of {name}", f"_answer of {name}"
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("language string, share double")
    def best(texts):
        import pandas as pd

        own = sent.value
        data = [(t or "").encode() for t in texts]
        there = np.array([len(t) > 0 for t in data], bool)
        if not own.languages or not there.any():
            return pd.DataFrame({"language": [UNKNOWN] * len(data), "share": np.zeros(len(data))})
        found = lengths(data, own)
        first = found.argmin(axis=1)
        more = np.minimum(found - found.min(axis=1, keepdims=True), 1000)
        share = 1 / np.exp2(-more).sum(axis=1)
        return pd.DataFrame({"language": [own.languages[i] if t else UNKNOWN for i, t in zip(first, there, strict=True)], "share": np.where(there, share, 0.0)})

    # A text without a letter goes to Python as null.
    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    rows = df.withColumn(inner, lettered).withColumn(answer, best(inner))
    return rows.select(*kept, F.col(f"`{answer}`.language").alias(name), F.col(f"`{answer}`.share").alias(score))


def code_lengths(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang, bits: the exact code length of each text by each language's tree; 0 bits for null and empty texts."""
    arrow_rows(df.sparkSession, 300)
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not batch.num_rows or not own.languages:
                continue
            found = lengths([(t or "").encode() for t in batch.column("_text").to_pylist()], own)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), len(own.languages))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.languages * batch.num_rows, pa.string()), pa.array(found.ravel())], ["id", "lang", "bits"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang string, bits double")
