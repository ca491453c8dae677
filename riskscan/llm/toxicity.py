"""Toxicity by a small convolutional text classifier, trained in numpy.

A text becomes a sequence of word hashes; each hash that enough training texts hold has an
embedding, all others share the zero one. Filters of several widths slide over the sequence,
each keeps its largest response (max pooling over the whole text), and a logistic layer turns
the maxima into a score. A convolution over embeddings is a sum of per-offset tables indexed by
word, so scoring is table look-ups, in pieces that overlap by the widest filter.

Training reads a bounded sample of the labelled rows; a part of it is set aside to calibrate the
score and to choose a threshold per language. Scoring reads every text whole, inside its row. A
model that saw no rows of both labels can't tell texts apart and rejects nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows, saved, whole, word_pieces

#: Rows of each label in the training sample, and characters for each of them: what short texts leave, long ones use.
SAMPLE_ROWS, SAMPLE_CHARS = 5000, 10_000
#: Filter widths in words, filters of each width, size of an embedding.
WIDTHS, FILTERS, SIZE = (1, 2, 3), 6, 8
#: A word needs so many training texts to get an embedding.
LEAST_TEXTS = 3
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.02, 1e-4
#: Words scored at a time; words remembered per worker.
PIECE_WORDS, REMEMBERED = 1 << 16, 300_000


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    """hashes: sorted word hashes; row i + 1 of the embeddings belongs to hash i, row 0 to all other words."""

    hashes: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Were there rows of both labels to learn from, and words to tell them by?
    learned: bool = False

    def tables(self) -> list[np.ndarray]:
        """Per width: offset x word x filter, what a word at an offset adds to each filter."""
        return [np.einsum("wd,odf->owf", self.embeddings, f, optimize=True).astype(np.float32) for f in self.filters]


#: Unknown words on both sides of a text, so that every text has a place without known words.
MARGIN = np.zeros(max(WIDTHS), np.int32)


def _responses(ids: np.ndarray, tables: list[np.ndarray], biases: list[np.ndarray]) -> list[np.ndarray]:
    """Per width: position x filter."""
    out = []
    for table, bias in zip(tables, biases, strict=True):
        n = len(ids) - len(table) + 1
        total = table[0][ids[:n]]
        for offset in range(1, len(table)):
            total += table[offset][ids[offset : offset + n]]
        out.append(total + bias)
    return out


class Scorer:
    """Scores texts with a model; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = model.tables()
        self.rows = {int(h): i for i, h in enumerate(model.hashes, 1)}
        self.known: dict[str, int] = {}

    def ids(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        rows = list(map(known.get, found))
        if None in rows:
            for i, row in enumerate(rows):
                if row is None:
                    rows[i] = known[found[i]] = self.rows.get(word_hash(found[i]), 0)
        return np.array(rows, np.int32)

    def score(self, text: str) -> float:
        best, reach = None, max(WIDTHS) - 1
        tail = MARGIN
        for found in word_pieces(text):
            ids = np.concatenate([tail, self.ids(found)])
            best, tail = self._best(best, ids), ids[len(ids) - reach :]
        best = self._best(best, np.concatenate([tail, MARGIN]))
        z = float(np.maximum(best, 0) @ self.model.out + self.model.out_bias)
        return float(1 / (1 + np.exp(-np.clip(self.model.scale * z + self.model.shift, -30, 30))))

    def _best(self, best: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
        """The largest response of each filter, pieces overlapping by the widest filter."""
        reach = max(WIDTHS) - 1
        for start in range(0, len(ids) - reach, PIECE_WORDS):
            responses = _responses(ids[start : start + PIECE_WORDS + reach], self.tables, self.model.biases)
            tops = np.concatenate([r.max(axis=0) for r in responses])
            best = tops if best is None else np.maximum(best, tops)
        return best


def sample(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """y, text, lang of at most `rows` labelled rows of each label, of at most `rows * chars` characters together.

    documents: doc_id, text, lang; labels: doc_id and the label. The rows are picked among the
    labels that have a text, those of up to `chars` characters first, then by a hash of the id.
    Texts are whole unless the picked ones of a label pass `rows * chars` characters: then the
    longest of them, all longer than `chars`, are read in a window of equal length, which begins
    at a place given by a hash of the id. Only ids and lengths are joined; the picked ids are few
    enough by their bound to go to the texts instead of moving texts. Labels other than 0 and 1,
    rows without id, and labels without a text don't count. This is all that training sees.
    """
    found = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").distinct()
    texts = documents.select("doc_id", whole("text").alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    lengths = texts.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("_n"))
    there = saved(found.join(lengths, "doc_id"), "labelled")
    first = [F.col("_n") > chars, F.xxhash64("doc_id"), "doc_id"]
    picked = []
    for y in (0, 1):
        own = there.filter(f"y = {y}").orderBy(*first).limit(rows)
        most = level([r["_n"] for r in own.select("_n").collect()], rows * chars)
        picked.append(own.select("doc_id", "y", F.lit(most).alias("_most")))
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - F.col("_most") + 1)).cast("int") + 1
    part = F.when(F.length("text") <= F.col("_most"), F.col("text")).otherwise(F.substr("text", begin, F.col("_most")))
    return texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("y", part.alias("text"), "lang")


def level(lengths: list[int], total: int) -> int:
    """The greatest length to which texts can be cut off so that all together have at most `total` characters."""
    left = total
    for k, n in enumerate(sorted(lengths)):
        each = left // (len(lengths) - k)
        if n > each:
            return each
        left -= n
    return max(lengths, default=0)


def train(texts: list[str], labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Fits embeddings, filters and the output layer; calibrates on every fifth row."""
    rng = np.random.default_rng(seed)
    hashed = [np.array([word_hash(w) for part in word_pieces(t) for w in part], np.uint32) for t in texts]
    aside = np.arange(len(texts)) % 5 == 0
    fitting = np.flatnonzero(~aside)
    seen: dict[int, list[int]] = {}
    for i in fitting:
        for h in np.unique(hashed[i]).tolist():
            seen.setdefault(h, [0, 0])[labels[i]] += 1
    hashes = np.array(sorted(h for h, (a, b) in seen.items() if a + b >= LEAST_TEXTS), np.uint32)
    size = len(hashes) + 1
    embeddings = rng.normal(0, 0.05, (size, SIZE)).astype(np.float32)
    # The first coordinate starts at the word's smoothed log-odds, so that training starts near a sensible model.
    n = np.array([seen[int(h)] for h in hashes], np.float64).reshape(-1, 2)
    total = np.maximum(np.bincount(labels[fitting], minlength=2), 1)
    odds = np.log((n[:, 1] + 0.5) / (total[1] + 1)) - np.log((n[:, 0] + 0.5) / (total[0] + 1))
    if size > 1:
        embeddings[1:, 0] = np.clip(odds, -3, 3) / 3
    embeddings[0] = 0
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 0.7
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, out_bias = rng.normal(0, 0.1, FILTERS * len(WIDTHS)) + 0.3, 0.0
    rows = [np.searchsorted(hashes, h) for h in hashed]
    ids = []
    for r, h in zip(rows, hashed, strict=True):
        there = (hashes[np.minimum(r, size - 2)] == h) if size > 1 else np.zeros(len(h), bool)
        ids.append(np.concatenate([MARGIN, np.where(there, r + 1, 0).astype(np.int32), MARGIN]))
    model = Model(hashes, embeddings, filters, biases, out, out_bias, learned=size > 1 and len(set(labels[fitting].tolist())) == 2)
    if not model.learned:
        # Nothing tells texts apart: all score the share of label 1, which is next to 0 without rows.
        ones = float(labels.mean()) if len(labels) else 0.0
        model.scale, model.shift = 0.0, float(np.log(max(ones, 1e-9) / max(1 - ones, 1e-9)))
        return model
    # Adagrad; pooling sends each filter's gradient to one place in a text, so only the words there move.
    dense = {"out": model.out} | {f"f{k}": f for k, f in enumerate(filters)} | {f"b{k}": v for k, v in enumerate(biases)}
    memory = {key: np.full(value.shape, 1e-3) for key, value in dense.items()}
    word_memory = np.full(embeddings.shape, 1e-3, np.float32)
    weight = len(fitting) / (2 * total[labels])
    for _ in range(EPOCHS if len(fitting) else 0):
        order = rng.permutation(fitting)
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            used, local = np.unique(np.concatenate([ids[i] for i in batch]), return_inverse=True)
            own = Model(used, embeddings[used], filters, biases, model.out, model.out_bias)
            tables, grads = own.tables(), {key: np.zeros(value.shape) for key, value in dense.items()}
            word_grad, bias_grad, at = np.zeros_like(own.embeddings), 0.0, 0
            for i in batch:
                text = local[at : at + len(ids[i])]
                at += len(text)
                responses = _responses(text, tables, biases)
                places = [r.argmax(axis=0) for r in responses]
                pooled = np.concatenate([r[p, np.arange(FILTERS)] for r, p in zip(responses, places, strict=True)])
                z = np.maximum(pooled, 0) @ model.out + model.out_bias
                step = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
                grads["out"] += step * np.maximum(pooled, 0)
                bias_grad += step
                back = (step * model.out * (pooled > 0)).astype(np.float32).reshape(len(WIDTHS), FILTERS)
                for k, width in enumerate(WIDTHS):
                    grads[f"b{k}"] += back[k]
                    for offset in range(width):
                        word = text[places[k] + offset]
                        grads[f"f{k}"][offset] += own.embeddings[word].T * back[k]
                        np.add.at(word_grad, word, (filters[k][offset] * back[k]).T)
            for key, value in dense.items():
                g = grads[key] / len(batch) + DECAY * value
                memory[key] += g * g
                value -= RATE * g / np.sqrt(memory[key])
            g = word_grad / len(batch) + DECAY * own.embeddings
            word_memory[used] += g * g
            embeddings[used] -= RATE * g / np.sqrt(word_memory[used])
            embeddings[0] = 0
            model.out_bias -= RATE * bias_grad / len(batch)
    scorer = Scorer(model)
    _calibrate(model, np.array([scorer.score(texts[i]) for i in np.flatnonzero(aside)]), labels[aside], [langs[i] for i in np.flatnonzero(aside)])
    return model


def _calibrate(model: Model, scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = 20) -> None:
    """Scale and shift that make the score a probability on the rows set aside, and the best threshold per language.

    A language with fewer than `least` rows of either label there keeps 0.5.
    """
    if len(set(labels.tolist())) < 2:
        return
    z = np.log(np.clip(scores, 1e-9, 1 - 1e-9) / np.clip(1 - scores, 1e-9, 1))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.mean((p - labels) * z) + 0.01 * (a - 1), np.mean(p - labels)])
        w = p * (1 - p) + 1e-6
        h = np.array([[np.mean(w * z * z) + 0.01, np.mean(w * z)], [np.mean(w * z), np.mean(w) + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - float(np.clip(step[0], -1, 1))), b - float(np.clip(step[1], -1, 1))
    model.scale, model.shift = a, b
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    names = np.array(langs)
    for lang in sorted(set(langs)):
        own = names == lang
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) < least:
            continue
        cuts = np.linspace(0.3, 0.9, 61)
        right = [np.mean((p[own] >= c) == labels[own]) for c in cuts]
        best = cuts[np.flatnonzero(np.isclose(right, max(right)))]
        model.thresholds[lang] = float(best[np.argmin(np.abs(best - 0.5))])


def fitted(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model from the sample of labelled rows; without rows of both labels it can't tell texts apart."""
    got = sample(documents, labels, label, rows, chars).toPandas()
    mixed = np.argsort(np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in got["text"]], np.uint32), kind="stable")
    got = got.iloc[mixed]
    return train(got["text"].tolist(), got["y"].to_numpy(np.int64), got["lang"].tolist())


def scored(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with `name`, 0 to 1, higher for label 1; nothing but the text enters the score.

    Null and empty texts are scored as texts without words. All columns of `df` stay.
    """
    spark = df.sparkSession
    arrow_rows(spark, 500)
    sent = spark.sparkContext.broadcast(model)
    workers: dict[int, Scorer] = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if 0 not in workers:
            workers[0] = Scorer(sent.value)
        return texts.map(workers[0].score)

    return df.withColumn(name, score(whole(text_col)))


def rejected(model: Model, score: Column | str = "score", lang: Column | str = "lang") -> Column:
    """Is the score at or above the threshold of the row's language? A language without one has 0.5.

    A model that hasn't learned to tell labels apart rejects nothing.
    """
    if not model.learned:
        return F.lit(False)
    pairs = [x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(v))]
    own = F.try_element_at(F.create_map(*pairs), F.coalesce(F.col(lang) if isinstance(lang, str) else lang, F.lit(""))) if pairs else F.lit(None).cast("double")
    return (F.col(score) if isinstance(score, str) else score) >= F.coalesce(own, F.lit(0.5))
