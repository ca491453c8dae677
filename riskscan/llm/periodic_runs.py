"""Runs of repeated words, found through string synchronising sets.

A run is a stretch of words that repeats with a smallest period q at least `LEAST` times and that
no neighbouring word extends. Periods from t to 2t - 1 are looked for at the scale t = 1, 2, 4, ...:

- Every window of t words has a hash, made from two hashes of the scale before. A position i is in
  the synchronising set if the smallest hash among the windows at i to i + t is that of the first
  or of the last of them. Whether it is depends on the 2t words from i on and on nothing else, so
  equal contexts are chosen alike wherever they stand.
- Windows that lie in a run of a period of t / 4 or less are left out of that choice: they are
  known from the scales before, which supply these small periods. What is not such a region has
  a chosen position among any t neighbours.
- A run of period q, t <= q < 2t, of four times its period or longer therefore holds a chosen
  position among its first t, and the same context stands q words later and not sooner. So the
  next position with the same context, if t to 2t - 1 words away, proposes its distance as a period.
- Proposals that overlap by a period are one; each is then extended word by word to both sides,
  which also rules out that equal hashes of unequal windows bring in a run.

The texts of a batch are handled as one array; a scale keeps the texts that are long enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows, pieces

#: A run holds its period at least this many times; the proof above needs four or more.
LEAST = 4
#: Shorter runs are not reported.
SHORTEST = 6
#: Words of the texts that are handled as one array; a longer text is an array of its own.
TOGETHER = 500_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value, one to one; the greatest stands for none."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the `width` values from each place on; beyond the end there is nothing."""
    n = len(values)
    blocks = -(-(n + width) // width)
    padded = np.full(blocks * width, NONE)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _reach(words: np.ndarray, at: int, period: int, end: int) -> int:
    """The first place from `at` on whose word differs from the one a period later; `end` - period at most."""
    step = 32
    while at + period < end:
        stop = min(at + step, end - period)
        other = np.flatnonzero(words[at:stop] != words[at + period : stop + period])
        if len(other):
            return at + int(other[0])
        at, step = stop, step * 2
    return at


def _reach_back(words: np.ndarray, at: int, period: int, begin: int) -> int:
    """The smallest place such that all words from it to `at` equal the ones a period later."""
    step = 32
    while at > begin:
        start = max(at - step, begin)
        other = np.flatnonzero(words[start:at] != words[start + period : at + period])
        if len(other):
            return start + int(other[-1]) + 1
        at, step = start, step * 2
    return at


def runs_of(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs of the texts that stand one after another in `words` (numbers), each up to its end.

    Rows of (begin, end, period) in places of `words`, by begin and period; with runs of `LEAST`
    times their period of any length.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - begins
    place = np.arange(len(words), dtype=np.int64)
    limit = np.repeat(ends, sizes)
    hashes = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    found: list[tuple[int, int, int]] = []
    scale = 1
    while True:
        keep = limit - _begin_of(place, begins) >= LEAST * scale
        if not keep.all():
            place, limit, hashes = place[keep], limit[keep], hashes[keep]
        if not len(place):
            break
        shifted = np.concatenate([hashes[scale:], np.zeros(min(scale, len(hashes)), np.uint64)])[: len(hashes)]
        context = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + shifted)
        offered = _mixed(hashes ^ np.uint64(scale))
        # Windows beyond the end of their text and windows of known small periods are not offered.
        offered[place + scale > limit] = NONE
        if scale >= 4:
            offered[_covered([f for f in found if f[2] * 4 <= scale], place, scale)] = NONE
        lowest = _smallest(offered, scale + 1)
        last = np.concatenate([offered[scale:], np.full(min(scale, len(offered)), NONE)])[: len(offered)]
        chosen = np.flatnonzero((lowest != NONE) & ((lowest == offered) | (lowest == last)) & (place + 2 * scale <= limit))
        found.extend(_checked(words, place, limit, begins, context, chosen, scale))
        # The hash of a window of twice the words.
        hashes = context
        scale *= 2
    return np.array(sorted(found, key=lambda f: (f[0], f[2])), np.int64).reshape(-1, 3)


def _begin_of(place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The begin of the text that holds each place; of texts that begin together the last has words."""
    return begins[np.searchsorted(begins, place, side="right") - 1]


def _covered(known: list[tuple[int, int, int]], place: np.ndarray, scale: int) -> np.ndarray:
    """Does the window of `scale` words at each place lie in one of the known runs?"""
    change = np.zeros(len(place) + 1, np.int64)
    wide = np.array([(a, b - scale + 1) for a, b, _ in known if b - a >= scale], np.int64).reshape(-1, 2)
    np.add.at(change, np.searchsorted(place, wide[:, 0]), 1)
    np.add.at(change, np.searchsorted(place, wide[:, 1]), -1)
    return np.cumsum(change[:-1]) > 0


def _checked(words, place, limit, begins, context, chosen, scale) -> Iterator[tuple[int, int, int]]:
    """The runs that neighbouring equal contexts propose, each once."""
    order = chosen[np.argsort(context[chosen], kind="stable")]
    first, second = order[:-1], order[1:]
    apart = place[second] - place[first]
    near = (context[first] == context[second]) & (apart >= scale) & (apart < 2 * scale) & (limit[first] == limit[second])
    at, apart = first[near], apart[near]
    by = np.lexsort((place[at], apart))
    at, apart = at[by], apart[by]
    where = place[at]
    # Stretches of one period that overlap by a period are parts of the same run.
    new = np.ones(len(at), bool)
    new[1:] = (apart[1:] != apart[:-1]) | (where[1:] - where[:-1] > 2 * scale)
    heads = np.flatnonzero(new)
    if not len(heads):
        return
    starts = _begin_of(where[heads], begins)
    done: dict[int, int] = {}
    rows = zip(where[heads].tolist(), apart[heads].tolist(), starts.tolist(), limit[at[heads]].tolist(), strict=True)
    for head, period, begin, end in rows:
        if head < done.get(period, -1):
            continue
        left = _reach_back(words, head, period, begin)
        # Equal contexts are equal stretches unless two hashes fell together: the words decide.
        right = _reach(words, left, period, end) + period
        done[period] = right - period
        if right - left >= LEAST * period:
            yield left, right, period


def repeated(words: np.ndarray, seed: int) -> np.ndarray:
    """The words with a stretch of a known period put in, for tests of what finds it.

    From word a = seed % n on, the words repeat those from a on with the period
    1 + (n - a) // (3 + seed % 8).
    """
    n = len(words)
    if not n:
        return words
    a = seed % n
    period = 1 + (n - a) // (3 + seed % 8)
    return np.concatenate([words[:a], np.resize(words[a : a + period], n - a)])


def _numbered(text: bytes, names: dict[bytes, int]) -> np.ndarray:
    parts = []
    for piece in pieces(text):
        found = piece.split()
        parts.append(np.fromiter((names.setdefault(w, len(names)) for w in found), np.int64, len(found)))
    return np.concatenate(parts)


def _results(texts: list[tuple[bytes, int | None]]) -> Iterator[tuple[int, np.ndarray, str]]:
    """Number of words, runs, and the collapsed text of each text."""
    names: dict[bytes, int] = {}
    each = [_numbered(text, names) for text, _ in texts]
    each = [w if seed is None else repeated(w, seed) for w, (_, seed) in zip(each, texts, strict=True)]
    ends = np.cumsum([len(w) for w in each])
    words = np.concatenate(each)
    runs = runs_of(words, ends)
    spelled = list(names)
    first = 0
    for own, end in zip(each, ends.tolist(), strict=True):
        begin = end - len(own)
        last = first
        while last < len(runs) and runs[last, 0] < end:
            last += 1
        mine = runs[first:last]
        change = np.zeros(len(own) + 1, np.int64)
        mine = mine[mine[:, 1] - mine[:, 0] >= SHORTEST]
        np.add.at(change, mine[:, 0] + mine[:, 2] - begin, 1)
        np.add.at(change, mine[:, 1] - begin, -1)
        kept = own[np.cumsum(change[:-1]) == 0]
        collapsed = b" ".join(map(spelled.__getitem__, kept.tolist())).decode()
        yield len(own), np.stack([mine[:, 0] - begin, mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1), collapsed
        first = last


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: Column | None = None) -> DataFrame:
    """id, n_words, runs (start, length, period, by start and period), collapsed: one row per input row.

    Words are what stands between ASCII white space. `collapsed` holds the words that no run has
    after its first period, joined by one space. `seed` puts a stretch of known period into the
    rows where it isn't null, as `repeated` says. Null and empty texts have no words, no runs and
    an empty `collapsed`. Repeated rows give repeated results, no rows none. Texts are read whole;
    a text of n words takes memory in proportion to n. Only the named columns are read.
    """
    arrow_rows(df.sparkSession, 300)
    planted = F.lit(None).cast("long") if seed is None else seed.cast("long")
    source = df.select(F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("_text"), planted.alias("_seed"))
    id_field = source.schema["_id"].dataType.simpleString()

    def together(batch: pa.RecordBatch) -> Iterator[list[tuple[bytes, int | None]]]:
        """The rows in lists whose texts have at most TOGETHER words, or one text."""
        held, size = [], 0
        for text, own in zip(batch.column("_text"), batch.column("_seed").to_pylist(), strict=True):
            data = text.as_py()
            if held and size + len(data) // 2 > TOGETHER:
                yield held
                held, size = [], 0
            held.append((data, own))
            size += len(data) // 2 + 1
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            done = [row for part in together(batch) for row in _results(part)]
            runs = np.concatenate([r for _, r, _ in done])
            offsets = np.concatenate([[0], np.cumsum([len(r) for _, r, _ in done])]).astype(np.int32)
            fields = pa.StructArray.from_arrays([pa.array(runs[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array([n for n, _, _ in done], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), fields),
                    pa.array([c for _, _, c in done], pa.string()),
                ],
                ["id", "n_words", "runs", "collapsed"],
            )

    return source.mapInArrow(run, f"id {id_field}, {SCHEMA}")
