"""Byte-pair encoding and decoding with forced-boundary splitting.

A merge can only make a token of the vocabulary. So between two bytes that stand side by side in
no token, no merge can ever reach across: the cut there is certain. Words are cut at all such
places, the fragments are encoded on their own, and their ids put together are the ids of the
word. Texts stay in their rows: nothing is shuffled.

The rules come from the tokenizer file (a `tokenizers` BPE with normalisation, a splitting
pattern and word ends); the merges inside a fragment are done by that library's BPE model.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows

#: Words and fragments remembered per task; then the memory is emptied. Results don't depend on it.
REMEMBERED = 200_000
#: Longer words and fragments are not remembered.
LONG = 64
#: Characters the fast splitting rule is used for: Latin, Greek, Cyrillic and common punctuation,
#: where all versions of Unicode in use agree. Other texts are split by the library itself.
COMMON = regex.compile("[\x00-ȳͰ-ͳ΄-ΊΎ-ΡΣ-ҁ -‧‪-⁞₠-₿]*")
#: White space as the file's `\s` has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class Codec:
    """Encodes and decodes with one tokenizer file. Made once per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        rules = json.loads(open(path, encoding="utf-8").read())
        self.library = Tokenizer.from_file(path)
        model = rules["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self.last = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.end, cache_capacity=0)
        self.added = {x["content"]: x["id"] for x in rules["added_tokens"]}
        self.find_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(self._split_pattern(rules))
        self.letters = self._byte_letters()
        self.joinable = self._joinable()
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = {i: t.encode() for i, t in names.items()}
        self.words: dict[str, bytes] = {}
        self.fragments: dict[tuple[str, bool], bytes] = {}

    @staticmethod
    def _split_pattern(rules: dict) -> str:
        split = rules["pre_tokenizer"]["pretokenizers"][0]
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("the file's splitting rule is not one that keeps the matches")
        # The `\s` of the file's rule, spelled out: engines differ on control characters.
        return split["pattern"]["Regex"].replace(r"\s", WHITE)

    def _byte_letters(self) -> list[str]:
        """The letter that stands for each byte: its own if printable, else the next free one from 256."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        free = iter(range(256, 512))
        return [chr(b) if b in printable else chr(next(free)) for b in range(256)]

    def _joinable(self) -> set[str]:
        """Pairs of letters that stand side by side inside a token."""
        pairs: set[str] = set()
        for token in self.vocab:
            bare = token.removesuffix(self.end) if self.end else token
            pairs.update(map("".join, zip(bare, bare[1:], strict=False)))
        return pairs

    def cut(self, letters: str) -> list[str]:
        """The fragments between certain cuts."""
        joinable, out, start = self.joinable, [], 0
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] not in joinable:
                out.append(letters[start:i])
                start = i
        out.append(letters[start:])
        return out

    def _fragment(self, letters: str, last: bool) -> bytes:
        known = self.fragments.get((letters, last))
        if known is None:
            tokens = (self.last if last else self.inner).tokenize(letters)
            known = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(letters) <= LONG:
                if len(self.fragments) >= REMEMBERED:
                    self.fragments.clear()
                self.fragments[letters, last] = known
        return known

    def _word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        known = self.words.get(word)
        if known is None:
            parts = self.cut("".join(map(self.letters.__getitem__, word.encode())))
            known = b"".join(self._fragment(p, i == len(parts)) for i, p in enumerate(parts, 1))
            if len(word) <= LONG:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = known
        return known

    def _split(self, text: str) -> list[str]:
        if COMMON.fullmatch(text):
            if not text.isascii():
                from unicodedata import normalize

                # One letter at a time, as the library does: a sigma has one small form.
                text = normalize("NFC", text).replace("Σ", "σ")
            return self.pattern.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self._pre_tokens(normal)]

    def _pre_tokens(self, normal: str) -> list[tuple[str, tuple[int, int]]]:
        back = {c: b for b, c in enumerate(self.letters)}
        found = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [(bytes(map(back.__getitem__, letters)).decode(), at) for letters, at in found]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = self.find_added.split(text) if self.find_added else [text]
        out = []
        for part in parts:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out.extend(map(self._word, self._split(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; without a decoder in the file, tokens are joined by spaces."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, if asked for), ids_sha256, decoded_sha256 per input row.

    Null texts count as empty and have no tokens; texts are never cut off. Repeated rows give
    repeated results, no rows none. Only the two named columns are read.
    """
    spark = df.sparkSession
    arrow_rows(spark, 500)
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        own = codec(path)
        for batch in batches:
            counts, before, after, lists = [], [], [], []
            for text in batch.column("_text"):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                before.append(hashlib.sha256(ids).hexdigest())
                after.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.frombuffer(ids, "<i4"))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the decoded texts of arrays of ids; null ids give the empty text."""
    arrow_rows(df.sparkSession, 500)
    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("_ids"))

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode() for x in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
