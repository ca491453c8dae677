"""Alignment of the tokens of two tokenizers through products of incidence matrices.

A token covers bytes of its text. With A the matrix of the first tokenizer's tokens by bytes and B
that of the second's, the entries of A·Bᵀ are the pairs of tokens that overlap, each with the number
of bytes they share. Byte offsets where a token ends in both texts cut the tokens into groups; the
product of the matrices of tokens by groups has the pairs that share a group. All matrices are
compressed rows made here: pointers and columns. A product is worked out row by row (Gustavson):
the rows of the right matrix that a row of the left one names are put together, equal columns added.

Texts are cut at single spaces between other characters first: neither tokenizer makes a token
across such a place, which is checked on the vocabularies, so both end a token there. What lies
between is encoded once while it is remembered, and what it gives is added up by text.

Counts over the corpus: the links of each text are written as a table of distinct id pairs with
their numbers and summed by pair. The most frequent pairs, up to `HOT`, are sent to all tasks; the
others, all rarer than these, are joined by a shuffle. No text and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows, saved

#: Id pairs whose counts are sent to all tasks: 17 bytes each.
HOT = 500_000
#: Parts of texts remembered per task; then the memory is emptied. Results don't depend on it.
REMEMBERED = 200_000
#: Longer parts are not remembered.
LONG = 200
#: Characters that are encoded in one call, and of texts that are put together in one.
AT_ONCE, TOGETHER = 100_000, 1_000_000
#: Entries that a product works on at once; a single row may have more.
BLOCK = 1 << 20
#: Id pairs a task adds up before it hands them on.
SUMMED = 4_000_000


class Rows(NamedTuple):
    """A matrix of zeros and ones in compressed rows."""

    ptr: np.ndarray
    ind: np.ndarray


def product(left: Rows, right: Rows, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows, columns and values of the entries of the product other than zero, in blocks of whole rows."""
    sizes = right.ptr[left.ind + 1] - right.ptr[left.ind]
    ahead = np.concatenate([[0], np.cumsum(sizes)])
    row_ends = ahead[left.ptr]
    first = 0
    while first < len(left.ptr) - 1:
        last = max(first + 1, int(np.searchsorted(row_ends, row_ends[first] + block, side="right")) - 1)
        some = slice(left.ptr[first], left.ptr[last])
        rows = np.repeat(np.arange(first, last), row_ends[first + 1 : last + 1] - row_ends[first:last])
        shift = np.repeat(right.ptr[left.ind[some]] - ahead[some], sizes[some])
        columns = right.ind[np.arange(row_ends[first], row_ends[last]) + shift]
        if len(rows):
            if ((columns[1:] < columns[:-1]) & (rows[1:] == rows[:-1])).any():
                order = np.lexsort((columns, rows))
                rows, columns = rows[order], columns[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])]))
            yield rows[new], columns[new], np.diff(np.append(new, len(rows)))
        first = last


def entries(left: Rows, right: Rows) -> np.ndarray:
    """How many entries each row of the product has at most: exactly so many if no two fall together."""
    sizes = right.ptr[left.ind + 1] - right.ptr[left.ind]
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[left.ptr])


def by_byte(ends: np.ndarray) -> Rows:
    """Tokens by bytes."""
    return Rows(np.concatenate([[0], ends]), np.arange(ends[-1] if len(ends) else 0))


def bytes_by_token(ends: np.ndarray) -> Rows:
    """The same matrix turned: bytes by tokens. A token of no bytes is in no row."""
    return Rows(np.arange((ends[-1] if len(ends) else 0) + 1), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)))


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the A and B tokens that overlap, and the bytes they share, by A and B."""
    parts = list(product(by_byte(a_ends), bytes_by_token(b_ends)))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token."""
    cuts = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
    return np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)


def group_matrices(a_groups: np.ndarray, b_groups: np.ndarray) -> tuple[Rows, Rows]:
    """A tokens by groups, and groups by B tokens: the product of these has the pairs that share a group."""
    count = int(a_groups[-1]) + 1 if len(a_groups) else 0
    return Rows(np.arange(len(a_groups) + 1), a_groups), Rows(np.searchsorted(b_groups, np.arange(count + 1)), np.arange(len(b_groups)))


def shared(a_ends: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the A and B tokens that share a group, in blocks: a long group has many."""
    for rows, columns, _ in product(*group_matrices(*groups(a_ends, b_ends))):
        yield rows, columns


class Aligned(NamedTuple):
    """What a part of a text gives."""

    n_a: int
    n_b: int
    n_groups: int
    n_shared: int
    pairs: np.ndarray
    spelled: str


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(free)): b for b in range(256)}


class Aligner:
    """Encodes with both tokenizers. Made once per Python worker."""

    #: U+180E was white space in older versions of Unicode: no cut beside it.
    CUT = regex.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
    EDGE = regex.compile("[\\s᠎]")

    def __init__(self, a_path: str, b_path: str):
        import json

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i) or "" if c in letters) for i in range(size)]
        self.b = SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = map(len, (self.a_bytes, self.b_bytes))
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        before = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        words = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        # No piece has a space after another character, and one space comes before each text.
        apart = not any("▁" in p.lstrip("▁") for p in names) and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")
        self.cuts = words and apart
        self.a_spelled = [f"{i}{end}" for end in ",|" for i in range(self.a_size)]
        self.b_spelled = [f"{i}{end}" for end in ",;\n" for i in range(self.b_size)]
        self.spelled = self.a_spelled + self.b_spelled
        self.known: dict[str, Aligned | None] = {}

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by both; None if either doesn't give back its bytes."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        data = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _together(self, parts: list[str]) -> list[Aligned | None]:
        """What parts give that are joined by single spaces at certain cuts."""
        ids = self._ids(" ".join(parts))
        if ids is None:
            return [None] if len(parts) == 1 else [self._together([p])[0] for p in parts]
        a, b = ids
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        a_groups, b_groups = groups(a_ends, b_ends)
        part_ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        a_parts, b_parts = np.searchsorted(part_ends, a_ends), np.searchsorted(part_ends, b_ends)
        rows, columns, _ = overlaps(a_ends, b_ends)
        pairs = a[rows] * self.b_size + b[columns]
        wide = entries(*group_matrices(a_groups, b_groups))
        a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (a_groups, b_groups))
        b_closing = np.append(b_parts[1:] != b_parts[:-1], True)
        # Groups one after another, A's tokens before B's in each.
        a_place = np.arange(len(a)) + np.searchsorted(b_groups, a_groups)
        b_place = np.arange(len(b)) + np.searchsorted(a_groups, b_groups, side="right")
        order = np.empty(len(a) + len(b), np.int64)
        order[a_place] = a + self.a_size * a_last
        order[b_place] = b + 2 * self.a_size + self.b_size * (b_last + 0 + b_closing)
        spelled = "".join(map(self.spelled.__getitem__, order.tolist())).split("\n")
        count = len(parts)
        n_a, n_b = np.bincount(a_parts, minlength=count), np.bincount(b_parts, minlength=count)
        n_groups = np.bincount(a_parts[a_last], minlength=count)
        n_shared = np.bincount(a_parts, weights=wide, minlength=count).astype(np.int64)
        link_ends = np.cumsum(np.bincount(a_parts[rows], minlength=count))
        cut = np.split(pairs, link_ends[:-1])
        return [Aligned(*x) for x in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_shared.tolist(), cut, spelled[:count], strict=True)]

    def _encode(self, parts: list[str]) -> list[Aligned | None]:
        """What each part gives; parts with white space at an end are encoded alone."""
        out: list[Aligned | None] = [None] * len(parts)
        held, size = [], 0
        for i, part in enumerate(parts):
            if self.EDGE.match(part[0]) or self.EDGE.match(part[-1]):
                out[i] = self._together([part])[0]
                continue
            held.append(i)
            size += len(part)
            if size >= AT_ONCE:
                self._put(out, parts, held)
                held, size = [], 0
        self._put(out, parts, held)
        return out

    def _put(self, out: list, parts: list[str], held: list[int]) -> None:
        if held:
            for i, got in zip(held, self._together([parts[i] for i in held]), strict=True):
                out[i] = got

    def texts(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The parts of each text; None for a text that has no tokens."""
        cut = [(self.CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        own: dict[str, Aligned | None] = {}
        new = [p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in self.known]
        for part, got in zip(new, self._encode(new), strict=True):
            own[part] = got
        found = []
        for text, parts in zip(texts, cut, strict=True):
            rows = [own[p] if p in own else self.known[p] for p in parts]
            if None in rows:
                # A part isn't given back as it is: whether the text is, the whole of it decides.
                rows = self._together([text])
            found.append(None if not rows or None in rows else rows)
        if len(self.known) + len(own) > REMEMBERED:
            self.known.clear()
        self.known.update((p, got) for p, got in own.items() if len(p) <= LONG)
        return found


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _rows(own: Aligner, texts: list[str], pair_type: np.dtype) -> Iterator[tuple]:
    """n_a, n_b, n_groups, n_links, n_shared, groups, pairs and times of each text."""
    for parts in own.texts(texts):
        if parts is None:
            yield 0, 0, 0, 0, 0, "", np.empty(0, pair_type), np.empty(0, np.int32)
            continue
        links = np.concatenate([p.pairs for p in parts])
        pairs, times = np.unique(links, return_counts=True)
        sums = [sum(p[k] for p in parts) for k in range(4)]
        yield *sums[:3], len(links), sums[3], ";".join(p.spelled for p in parts), pairs.astype(pair_type), times.astype(np.int32)


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _row, n_a, n_b, n_groups, n_links, n_shared, groups, pairs, times: one row per input row.

    A encodes a space and the text, B the text (it puts a space before it). `groups` lists the ids
    of each group as `a1,a2|b1;a3|b2`. `pairs` are the distinct linked ids, as A's id times the size
    of B's vocabulary plus B's id, `times` how many links of the text have them. Null and empty texts,
    and texts that either tokenizer doesn't give back byte by byte, have no tokens: zeros, an empty
    `groups` and empty arrays. Texts are whole. Repeated rows give repeated results, no rows none.
    """
    arrow_rows(df.sparkSession, 300)
    own = aligner(a_path, b_path)
    kind, pair_type = ("int", np.dtype(np.int32)) if own.a_size * own.b_size < 1 << 31 else ("bigint", np.dtype(np.int64))
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"))

    def together(texts: list[str]) -> Iterator[list[str]]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > TOGETHER:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            done = [row for part in together(texts) for row in _rows(both, part, pair_type)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[6]) for r in done])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in done]))) for k in (6, 7)]
            counts = [pa.array([r[k] for r in done], pa.int64()) for k in range(5)]
            names = ["id", "_row", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "pairs", "times"]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_row"), *counts, pa.array([r[5] for r in done], pa.string()), *lists], names)

    id_type = source.schema["_id"].dataType.simpleString()
    schema = f"id {id_type}, _row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups string, pairs array<{kind}>, times array<int>"
    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many links of all rows have each id pair. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([p for p, _ in held])
            found, where = np.unique(pairs, return_inverse=True)
            return found, np.bincount(where, weights=np.concatenate([n for _, n in held]), minlength=len(found)).astype(np.int64)

        for batch in batches:
            pairs = batch.column("pairs").flatten().to_numpy().astype(np.int64)
            held.append((pairs, batch.column("times").flatten().to_numpy().astype(np.int64)))
            size += len(pairs)
            if size > SUMMED:
                held = [summed()]
                size = len(held[0][0])
                if size > SUMMED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])

    arrow_rows(rows.sparkSession, 300)
    return rows.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def marked(counts: DataFrame, b_size: int) -> DataFrame:
    """pair, n, top: is the count the highest of the pair's B id?"""
    b = F.col("pair") % b_size
    # One row per B id: the size of its vocabulary bounds the broadcast.
    best = counts.groupBy(b.cast("long").alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(best), b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("top"))


def scored(rows: DataFrame, b_size: int, hot: int = HOT) -> DataFrame:
    """The rows of `aligned` without their pairs, with n_best and count_sum. The rows must be a written table.

    n_best counts the links whose pair is linked most often among all pairs of its B id, ties
    included; count_sum adds up the counts of all links. Both are 0 without tokens.
    """
    spark = rows.sparkSession
    pairs = saved(marked(saved(pair_counts(rows), "pair-counts"), b_size), "pairs")
    most = pairs.orderBy(F.desc("n"), "pair").limit(hot).toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast((most["pair"].to_numpy(np.int64), most["n"].to_numpy(np.int64), most["top"].to_numpy(bool)))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers, tops = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            found, times = lists.flatten().to_numpy().astype(np.int64), batch.column("times").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
            there = known[at] == found if len(known) else np.zeros(len(found), bool)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            at = at[there]
            np.add.at(best, row[there], times[there] * tops[at])
            np.add.at(total, row[there], times[there] * numbers[at])
            left = ~there
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=batch.num_rows))]).astype(np.int32))
            rest = pa.StructArray.from_arrays([pa.array(found[left]), pa.array(times[left])], ["pair", "times"])
            columns = [batch.column(c) for c in kept] + [pa.array(best), pa.array(total), pa.ListArray.from_arrays(offsets, rest)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum", "_rest"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    arrow_rows(spark, 300)
    found = rows.mapInArrow(run, f"{types}, n_best bigint, count_sum bigint, _rest array<struct<pair:bigint,times:bigint>>")
    if len(most) < hot:
        return found.drop("_rest")
    found = saved(found, "aligned-part")
    rest = found.select("_row", F.explode("_rest").alias("_x")).select("_row", "_x.pair", "_x.times").join(pairs, "pair")
    more = rest.groupBy(F.col("_row").alias("_of")).agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("_best"))
    joined = found.join(more, found["_row"] == more["_of"], "left")
    return joined.select(
        *[c for c in kept], (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")
    )
