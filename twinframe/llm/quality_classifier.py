"""Quality from positive and unlabelled texts.

A linear model over hashed byte-class trigrams, hashed words and a few repetition measures minimises the non-negative
unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with trusted positives p, unlabelled texts u and the share pi
of positives among all texts. No negative label is used.

pi is estimated first: a plain positive-against-unlabelled model scores all texts, and pi is the least ratio of the
share of all texts above a score to the share of held-back positives above it, as only there negatives can be rare.

The models are fitted on bounded samples (``max_positives``, ``max_unlabelled``); score histograms for pi cover all
texts. Null and empty texts have only the bias and measures of length zero. Without positives every score is 0.5.
Repeated rows are scored each. Only the id, text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.arrow_text import Powers, Texts, letter_bytes, mixed, repeated_words, texts_of
from twinframe.llm.labels import bounded, chosen_texts

SHAPES, WORDS, MEASURES = 768, 512, 8
WIDTH = SHAPES + WORDS + MEASURES
MAX_POSITIVES = MAX_UNLABELLED = 6000
BINS = 400


def byte_classes() -> np.ndarray:
    """A class for each byte value: letters by case, digits, space, newline, beyond ASCII, and each symbol by itself."""
    table = np.zeros(256, dtype=np.int64)
    symbols = [b for b in range(33, 127) if not chr(b).isalnum()]
    for i, b in enumerate(symbols):
        table[b] = 8 + i
    table[97:123], table[65:91], table[48:58], table[128:] = 1, 2, 3, 4
    table[32], table[10], table[9] = 5, 6, 7
    return table


class Features:
    """Feature rows of a run of texts, each block scaled to unit length."""

    def __init__(self) -> None:
        self.powers = Powers()
        self.classes = byte_classes()
        self.letters = letter_bytes()

    def _block(self, of: np.ndarray, bucket: np.ndarray, n: int, width: int) -> np.ndarray:
        counts = np.bincount(of * width + bucket, minlength=n * width).reshape(n, width)
        total = counts.sum(1, keepdims=True)
        return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)

    def rows(self, texts: Texts) -> np.ndarray:
        n, size = len(texts), np.diff(texts.offsets)
        of = np.repeat(np.arange(n), size)
        c = self.classes[texts.data]
        inside = of[2:] == of[:-2] if len(of) > 2 else np.zeros(0, dtype=bool)
        code = ((c[:-2] * 64 + c[1:-1]) * 64 + c[2:])[inside] if len(of) > 2 else np.zeros(0, dtype=np.int64)
        shapes = self._block(of[2:][inside] if len(of) > 2 else code, (mixed(code) % np.uint64(SHAPES)).astype(np.int64), n, SHAPES)
        words = texts.words(self.powers, lower=True, member=self.letters)
        bag = self._block(words.text, (words.hash % np.uint64(WORDS)).astype(np.int64), n, WORDS)
        spaced = texts.words(self.powers)
        n_words = np.bincount(spaced.text, minlength=n)
        same = (spaced.hash[1:] == spaced.hash[:-1]) & (spaced.text[1:] == spaced.text[:-1])
        pairs = np.unique(mixed(spaced.hash ^ mixed(spaced.text.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
        least, most = np.maximum(n_words, 1), np.maximum(size, 1)
        classes = [np.bincount(of[c == k], minlength=n) / most for k in (1, 2)]
        other = np.bincount(of[c >= 8], minlength=n) / most
        measures = np.stack(
            [
                np.ones(n),
                np.log1p(n_words) / 8,
                np.bincount(spaced.text[1:][same], minlength=n) / least,
                np.bincount(spaced.text[pairs], minlength=n) / least,
                repeated_words(spaced, n) / least,
                *classes,
                other,
            ],
            axis=1,
        )
        return np.hstack([shapes, bag, measures.astype(np.float32)])


@dataclass
class Model:
    weights: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30).astype(np.float64)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 250, decay: float = 1e-4) -> Model:
    """Weights by Adam on whole samples. ``prior`` None: positives against unlabelled, both with the same weight.

    With the logistic loss l(z) = log(1 + exp(-z)), l(z) - l(-z) = -z, so pi * R_p(+) - pi * R_p(-) has a constant slope.
    """
    weights = np.zeros(positive.shape[1], dtype=np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    mean = positive.mean(0)
    for step in range(1, steps + 1):
        p, u = np.clip(positive @ weights, -30, 30), np.clip(unlabelled @ weights, -30, 30)
        slope = (1 / (1 + np.exp(-u)) / len(u)) @ unlabelled
        if prior is None:
            slope = slope - (1 / (1 + np.exp(p)) / len(p)) @ positive
        elif np.logaddexp(0, u).mean() >= prior * np.logaddexp(0, p).mean():
            slope = slope - prior * mean
        else:  # the negative risk fell below zero, it is overfitted: step back, as the non-negative estimator asks
            slope = prior * (1 / (1 + np.exp(-p)) / len(p)) @ positive - slope
        slope = slope + decay * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights = weights - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(weights.astype(np.float32), 0.5 if prior is None else prior)


def feature_rows(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """``key`` and the feature row of each text as half-precision bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                rows = features.rows(texts).astype(np.float16)
                keys = batch.column(0).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in rows], pa.binary())], names=[key, "row"])

    picked = docs.select(F.col(key), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{key}` {picked.schema[0].dataType.simpleString()}, row binary")


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            parts = [model.score(features.rows(texts)) for texts in texts_of(batch.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=[id_col, "score"])

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return picked.select(F.col(id_col), F.lit(0.5).alias("score"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text scores ``least`` or more, columns as they were; all rows without a model."""
    if model is None:
        return docs

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        for column in columns:
            parts = [model.score(features.rows(texts)) for texts in texts_of(column)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.where(score(F.col(text_col).cast("string")) >= least)


def _matrix(rows: DataFrame, order: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The collected feature rows and, if named, the boolean column ``order``, whose false rows come first. They come as
    Arrow batches, which the JVM and Python hold as bytes, not as an object for each row."""
    table = rows.select("row", *([order] if order else [])).toArrow()
    flags = np.array(table.column(order).to_pylist(), dtype=bool) if order else np.zeros(len(table), dtype=bool)
    matrix, places = np.empty((len(flags), WIDTH), dtype=np.float32), np.empty(len(flags), dtype=np.int64)
    places[np.argsort(flags, kind="stable")] = np.arange(len(flags))
    at = 0
    for batch in table.column("row").chunks:
        part = np.frombuffer(b"".join(batch.to_pylist()), dtype=np.float16).reshape(-1, WIDTH)
        matrix[places[at : at + len(part)]] = part
        at += len(part)
    return matrix, np.sort(flags)


def estimated_prior(docs: DataFrame, held: np.ndarray, model: Model, id_col: str, text_col: str) -> float:
    """Share of positives among all texts, from the histogram of all their scores and of the held-back positives'."""
    bins = scored(docs, model, id_col, text_col).groupBy(F.floor(F.col("score") * BINS).alias("bin")).count().collect()
    every, known = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in bins:
        every[int(r["bin"])] += r["count"]
    np.add.at(known, np.floor(model.score(held) * BINS).astype(int), 1)
    above_u, above_p = np.cumsum(every[::-1]) / max(every.sum(), 1), np.cumsum(known[::-1]) / known.sum()
    slack = np.sqrt(above_p * (1 - above_p) / known.sum())
    usable = above_p >= 0.25
    return float(np.clip(np.min((above_u / np.maximum(above_p - slack, 1e-9))[usable]), 0.05, 0.99))


def train(
    docs: DataFrame,
    positives: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model | None:
    """The model for ``docs``, with trusted ``positives`` given as a table of distinct ids; None without positives."""
    ids = bounded(positives.select(id_col), id_col, max_positives, seed=1)
    half = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(4)) == 0
    known, is_held = _matrix(feature_rows(chosen_texts(docs, ids, id_col), text_col, id_col).withColumn("held", half), "held")
    if not len(known):
        return None
    unlabelled, _ = _matrix(feature_rows(bounded(docs.select(id_col, text_col), id_col, max_unlabelled, seed=2), text_col, id_col))
    if not len(unlabelled):
        return None
    n = int((~is_held).sum())
    positive, held = known[:n] if n else known, known[n:] if n < len(known) else known
    prior = estimated_prior(docs, held, fit(positive, unlabelled, None, steps=100), id_col, text_col)
    return fit(known, unlabelled, prior)
