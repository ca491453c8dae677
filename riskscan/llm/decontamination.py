"""Benchmark decontamination: MinHash containment search, partitioned by size, then exact verification.

Test items are short and documents are long, so the similarity of an item and a whole document
says nothing. Items are put into classes by their number of shingles, powers of two. For each
class a document is read in windows of two blocks, a block holding as many shingles as the
largest item of the class, each window overlapping the next by half: whatever part of a document
an item is copied into lies inside a window at most four times its size. An item whose shingles
are contained there to the threshold has a similarity to the window of at least

    t * n / (n + w - t * n),   n >= block / 2 + 1 shingles, w = 2 * block,

about 0.19 at a threshold of 0.8. Windows and items meet when they agree in any of 64 MinHash
values, so such a pair is missed with a probability below 2 in a million. Candidates are verified
by the exact containment of the item's shingles in the whole document, compared as text.

An item of fewer than five words is one shingle of all its words: windows of as many words of a
document are looked up as they are, so it is found inside longer documents too.

The items are the small side: they are read in blocks of a bounded number of items and characters,
each block one pass over the documents, which stay in their rows; nothing but the matches leaves a
row. What a document takes in memory depends on its own length and not on the longest item's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows, whole, word_pieces

#: Words in a shingle, containment that counts, MinHash values, items in a pass and their characters.
WORDS, THRESHOLD, HASHES, ITEMS, ITEM_CHARS = 5, 0.8, 64, 20_000, 30_000_000
#: From this block on, documents are not filled up to whole blocks.
WIDE = 64
#: Shingles looked up at a time; words remembered per worker.
PIECE_SHINGLES, REMEMBERED = 1 << 18, 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_texts(words: list[str], size: int = WORDS) -> list[str]:
    """Shingles as text; fewer words are one shingle, no words none."""
    if len(words) < size:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def _spread(values: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit integers."""
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


class Hasher:
    """Hashes of shingles from remembered hashes of words."""

    def __init__(self, size: int = WORDS):
        self.size = size
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = known[words[i]] = xxhash.xxh32_intdigest(words[i])
        return np.array(found, np.uint32).astype(np.uint64)

    def shingles(self, words: list[str]) -> np.ndarray:
        """One 32-bit hash per shingle, the same for a shingle wherever it stands."""
        if not words:
            return np.zeros(0, np.uint32)
        hashed = self.words(words)
        n = max(1, len(hashed) - self.size + 1)
        total = np.zeros(n, np.uint64)
        for offset in range(min(self.size, len(hashed))):
            total = _spread(total + hashed[offset : offset + n])
        return (total >> np.uint64(32)).astype(np.uint32)


def _turns(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the hash functions."""
    rng = np.random.default_rng(20_021)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def _turned(hashes: np.ndarray, factor: np.uint32, offset: np.uint32) -> np.ndarray:
    """One hash function: factor and offset, then the high bits folded over the low ones."""
    values = hashes * factor + offset
    return values ^ (values >> np.uint32(15))


class Search:
    """A block of items, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, size: int = WORDS, hashes: int = HASHES):
        self.threshold, self.size = threshold, size
        self.hasher = Hasher(size)
        self.factors, self.offsets = _turns(hashes)
        self.shingles: list[set[str]] = []
        self.ids: list[int] = []
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        #: Items of fewer words than a shingle has, by their number of words: text and numbers.
        self.short: dict[int, dict[str, list[int]]] = {}
        for item, text in items:
            words = [w for piece in word_pieces(text) for w in piece]
            own = set(shingle_texts(words, size))
            if not own:
                continue
            if len(words) < size:
                self.short.setdefault(len(words), {}).setdefault(" ".join(words), []).append(item)
                continue
            classes.setdefault(1 << (len(own) - 1).bit_length(), []).append((len(self.ids), np.unique(self.hasher.shingles(words))))
            self.ids.append(item)
            self.shingles.append(own)
        #: Per class: the block size, and per hash function the sorted minima of its items with their numbers.
        self.classes = {}
        for block, members in sorted(classes.items()):
            numbers = np.array([n for n, _ in members])
            rows = []
            for factor, offset in zip(self.factors, self.offsets, strict=True):
                low = np.array([_turned(h, factor, offset).min() for _, h in members], np.uint32)
                order = np.argsort(low, kind="stable")
                rows.append((low[order], numbers[order]))
            self.classes[block] = rows
        #: Per number of words: a hasher and the sorted hashes of the short items.
        self.short_hashes = {}
        for count, texts in sorted(self.short.items()):
            hasher = Hasher(count)
            self.short_hashes[count] = hasher, np.unique(np.concatenate([hasher.shingles(t.split(" ")) for t in texts]))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text in lists that overlap by more than a window."""
        reach = 2 * max(self.classes, default=1) + self.size
        tail: list[str] = []
        for words in word_pieces(text):
            part = tail + words
            yield part
            tail = part[-reach:]

    def candidates(self, texts: Iterable[str]) -> dict[int, set[int]]:
        """Per number of a text, the items that agree with one of its windows in any MinHash value."""
        found: dict[int, set[int]] = {}
        held, total = [], 0
        for number, text in enumerate(texts if self.classes else ()):
            for words in self.parts(text):
                hashes = self.hasher.shingles(words)
                if len(hashes):
                    held.append((number, hashes))
                    total += len(hashes)
                if total >= PIECE_SHINGLES:
                    self._look_up(held, found)
                    held, total = [], 0
        if held:
            self._look_up(held, found)
        return found

    def _look_up(self, held: list[tuple[int, np.ndarray]], found: dict[int, set[int]]) -> None:
        for block, rows in self.classes.items():
            owners = np.concatenate([np.full(-(-len(hashes) // block), number) for number, hashes in held])
            if block < WIDE:
                filled = []
                for _, hashes in held:
                    filled += [hashes, np.repeat(hashes[-1:], -len(hashes) % block)]
                # Blocks stand in columns, so that a minimum runs over whole rows.
                turned = np.ascontiguousarray(np.concatenate(filled).reshape(-1, block).T)
            else:
                turned = np.concatenate([hashes for _, hashes in held])
                ends = np.cumsum([len(hashes) for _, hashes in held])
                starts = np.concatenate([np.arange(end - len(hashes), end, block) for end, (_, hashes) in zip(ends, held, strict=True)])
            for factor, offset, (items, numbers) in zip(self.factors, self.offsets, rows, strict=True):
                values = _turned(turned, factor, offset)
                low = values.min(axis=0) if block < WIDE else np.minimum.reduceat(values, starts)
                # Windows of two blocks; those of one block are for texts that have no more. A window over
                # the end of a text belongs to both texts: verification tells them apart.
                for windows, ends in ((low, (0,)), (np.minimum(low[:-1], low[1:]), (0, 1))):
                    at = np.minimum(np.searchsorted(items, windows), len(items) - 1)
                    for i in np.flatnonzero(items[at] == windows).tolist():
                        value = windows[i]
                        hits = numbers[np.searchsorted(items, value) : np.searchsorted(items, value, "right")].tolist()
                        for end in ends:
                            found.setdefault(int(owners[i + end]), set()).update(hits)

    def held_by(self, text: str, candidates: Iterable[int]) -> list[tuple[int, float]]:
        """(item, containment) of the candidates whose shingles the whole text holds to the threshold."""
        wanted = {n: self.shingles[n] for n in sorted(candidates)}
        sought = set().union(*wanted.values())
        there: set[str] = set()
        for words in self.parts(text):
            there.update(sought.intersection(shingle_texts(words, self.size)))
        shares = [(self.ids[n], len(own & there) / len(own)) for n, own in wanted.items()]
        return [(item, share) for item, share in shares if share >= self.threshold]

    def short_held_by(self, text: str) -> list[tuple[int, float]]:
        """The items of few words that stand in the text, each once."""
        there: dict[tuple[int, str], None] = {}
        for words in self.parts(text) if self.short else ():
            for count, (hasher, wanted) in self.short_hashes.items():
                if len(words) < count:
                    continue
                for i in np.flatnonzero(np.isin(hasher.shingles(words), wanted)).tolist():
                    said = " ".join(words[i : i + count])
                    if said in self.short[count]:
                        there[count, said] = None
        return [(item, 1.0) for count, said in there for item in self.short[count][said]]

    def matches(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        found = self.candidates(texts)
        return [(self.held_by(text, found[i]) if i in found else []) + self.short_held_by(text) for i, text in enumerate(texts)]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", rows: int = ITEMS, chars: int = ITEM_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The different items (id and text) in blocks of about `rows` and about `chars` characters, dealt out by a hash."""
    different = items.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).distinct()
    size = different.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // rows), -(-size["chars"] // chars))
    for part in range(parts):
        own = different.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield [(r["id"], r["text"]) for r in own.orderBy("id", "text").toLocalIterator()]


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, containment: every item that a document holds to the threshold.

    Containment is the share of the item's distinct five-word shingles (lower case, words only)
    that occur in the document. An item of fewer than five words is one shingle of all its words,
    held by a document in which they stand in a row. Null and empty texts and items hold
    and match nothing. Repeated rows are reported as often as they occur, repeated items once. Of
    the tables only ids and texts are read.
    """
    spark = df.sparkSession
    arrow_rows(spark, 300)
    source = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_col].dataType.simpleString()}, containment double"
    out = None
    for block in item_blocks(items, item_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            search = Search(sent.value, threshold)
            for batch in batches:
                found = search.matches(batch["text"].tolist())
                rows = [(i, item, share) for i, held in zip(batch["doc_id"], found, strict=True) for item, share in held]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "containment"])

        found = source.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def cleaned(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` that hold no item; all columns stay. Ids play no part."""
    spark = df.sparkSession
    arrow_rows(spark, 300)
    kept = df
    for block in item_blocks(items, item_col):
        sent = spark.sparkContext.broadcast(block)
        made: dict[int, Search] = {}

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            if 0 not in made:
                made[0] = Search(sent.value, threshold)  # noqa: B023
            return pd.Series([not held for held in made[0].matches(texts.tolist())], dtype=bool)  # noqa: B023

        kept = kept.filter(clean(whole(text_col)))
    return kept
