"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits and the beginnings of longer ones, known by 64-bit hashes. The score is the logistic of
bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j  over the terms present in a text, so two terms that are harmless
alone can weigh together. x_i falls with how common the term is.

Terms are counted over all labelled training texts of a bounded sample (``max_labelled``); the model has every term that
tells the classes apart (``MIN_GAIN``), and every common one (``MIN_SHARE``) as a partner of interactions. A text's mean number of
terms over ``MIN_SHARE`` bounds the common ones; there is no other limit to their number.
Null and empty texts score the bias alone. Without labels of both classes every score is the share of toxic labels, or 0.
Repeated rows are scored each. Only the id, text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.arrow_text import Powers, letter_bytes, lower_bytes, mixed, texts_of
from twinframe.llm.labels import bounded, chosen_texts
from twinframe.session import stage

MAX_LABELLED = 20_000
FACTORS = 8
MIN_TEXTS = 3
#: Bytes of the beginnings of longer words that count as terms too, so that inflected words share some.
STEMS = (4, 5)
#: Least chi-squared of a term that tells the classes apart (one in a thousand by chance), least share of texts of a partner.
MIN_GAIN = 10.8
MIN_SHARE = 0.2
#: How much more the factors of pairs are held back than the weights of single terms.
PAIR_DECAY = 5


def term_lists(column: pa.Array, powers: Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of texts: its first number, and text number and hash of each distinct term of a text."""
    letters, low = letter_bytes(), lower_bytes()
    for texts in texts_of(column):
        words = texts.words(powers, lower=True, member=letters)
        sums = texts.prefix_hash(powers, low)
        of, terms = [words.text], [words.hash]
        for size in STEMS:
            long = words.end - words.start > size
            start = words.start[long]
            of.append(words.text[long])
            terms.append(mixed(texts.span_hash(sums, start, start + size, powers) + np.uint64(size)))
        of, terms = np.concatenate(of), np.concatenate(terms)
        first = np.unique(mixed(terms ^ mixed(of.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
        yield texts.first, len(texts), of[first], terms[first]


@dataclass
class Model:
    """``terms`` sorted hashes; ``x`` input value, ``w`` weight and ``v`` factors of each."""

    bias: float
    terms: np.ndarray
    x: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def score(self, n: int, of: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Scores of ``n`` texts from the known terms (text number, place in ``terms``) that stand in them."""
        x = self.x[term]
        total = np.bincount(of, self.w[term] * x, minlength=n) + self.bias
        for f in range(self.v.shape[1]):
            part = self.v[term, f] * x
            total += 0.5 * (np.bincount(of, part, minlength=n) ** 2 - np.bincount(of, part**2, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms of the model, and the places of these."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), dtype=bool)
        return hit, at[hit]


def term_counts(texts: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """Texts and toxic texts that hold each term; added up inside each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            found = [(terms, label[first + of]) for first, _, of, terms in term_lists(batch.column(1), powers)]
            if found:
                terms, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
                toxic = np.bincount(at, np.concatenate([y for _, y in found]), minlength=len(terms))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms.view(np.int64)), pa.array(np.bincount(at, minlength=len(terms))), pa.array(toxic.astype(np.int64))],
                    names=["term", "texts", "toxic"],
                )

    picked = texts.select(F.col(label_col).cast("long"), F.col(text_col).cast("string"))
    counts = picked.mapInArrow(run, "term long, texts long, toxic long")
    return counts.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))


def chosen_terms(counts: DataFrame, n: int, n_toxic: int) -> list:
    """Terms that surely tell the classes apart (chi-squared) or are common."""
    a, t = F.col("toxic").cast("double"), F.col("texts").cast("double")
    expected = t * n_toxic / n
    spread = expected * (1 - F.lit(n_toxic / n)) * (1 - t / n) + 1e-9
    telling = (a - expected) ** 2 / spread >= MIN_GAIN
    return counts.where((F.col("texts") >= MIN_TEXTS) & (telling | (F.col("texts") >= MIN_SHARE * n))).collect()


def indexed(texts: DataFrame, label_col: str, text_col: str, model: Model) -> DataFrame:
    """Label and places of the model's terms of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, n, of, hashes in term_lists(batch.column(1), powers):
                hit, at = model.known(hashes)
                order = np.argsort(of[hit], kind="stable")
                ends = np.searchsorted(of[hit][order], np.arange(n + 1))
                at = at[order].astype(np.int32)
                rows = [at[ends[i] : ends[i + 1]].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(rows, pa.binary())], names=["label", "terms"])

    return texts.select(F.col(label_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "label long, terms binary")


def fit(rows: list, model: Model, epochs: int = 15, batch: int = 256, rate: float = 0.02) -> Model:
    """Logistic loss by Adam over shuffled batches, each made dense over the model's terms."""
    random = np.random.default_rng(7)
    width, factors = model.v.shape
    lists = [np.frombuffer(r["terms"], dtype=np.int32) for r in rows]
    label = np.array([r["label"] for r in rows], dtype=np.float32)
    state = [np.float32(model.bias) * np.ones(1, np.float32), model.w, random.normal(0, 0.1, (width, factors)).astype(np.float32)]
    moments = [(np.zeros_like(s), np.zeros_like(s)) for s in state]
    step, decay = 0, 1 / max(len(lists), 1)  # a normal prior of unit variance on weights
    epochs = max(epochs, -(-600 * batch // max(len(lists), 1)))  # small samples need as many steps
    for _ in range(epochs):
        order = random.permutation(len(lists))
        for begin in range(0, len(order), batch):
            part = order[begin : begin + batch]
            x = np.zeros((len(part), width), dtype=np.float32)
            for i, k in enumerate(part):
                x[i, lists[k]] = model.x[lists[k]]
            sums = x @ state[2]
            total = state[0] + x @ state[1] + 0.5 * (sums**2 - (x**2) @ (state[2] ** 2)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - label[part]) / len(part)
            weighted = x * error[:, None]
            slopes = [
                error.sum(keepdims=True),
                weighted.sum(0) + decay * state[1],
                weighted.T @ sums - state[2] * (weighted * x).sum(0)[:, None] + PAIR_DECAY * decay * state[2],
            ]
            step += 1
            for s, g, (m, q) in zip(state, slopes, moments):
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                s -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return Model(float(state[0][0]), model.terms, model.x, state[1], state[2])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """The model from ``labels`` (distinct ids with 0 or 1 in ``label_col``)."""
    ids = bounded(labels.select(id_col, F.col(label_col).alias("__label")), id_col, max_labelled, seed=4)
    texts = stage(chosen_texts(docs.select(id_col, text_col), ids, id_col).select("__label", text_col), "labelled")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("__label"), F.lit(0)).alias("toxic")).first()
    n, n_toxic = size["n"], int(size["toxic"])
    none = np.zeros(0, dtype=np.float32)
    share = (n_toxic + 0.5) / (n + 1) if n_toxic else 1e-6
    bias = float(np.log(share / (1 - share)))
    if not 0 < n_toxic < n:
        return Model(bias, np.zeros(0, dtype=np.uint64), none, none, np.zeros((0, FACTORS), np.float32))
    chosen = chosen_terms(term_counts(texts, "__label", text_col), n, n_toxic)
    terms = np.array([r["term"] for r in chosen], dtype=np.int64).view(np.uint64)
    order = np.argsort(terms)
    found = np.array([r["texts"] for r in chosen], dtype=np.float64)[order]
    x = np.sqrt(np.log((n + 1) / (found + 1)) / np.log(n + 1)).astype(np.float32)
    empty = Model(bias, terms[order], x, np.zeros(len(terms), np.float32), np.zeros((len(terms), FACTORS), np.float32))
    return fit(indexed(texts, "__label", text_col, empty).collect(), empty)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (likelihood of toxicity, 0 to 1) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            scores = []
            for _, n, of, hashes in term_lists(batch.column(1), powers):
                hit, at = model.known(hashes)
                scores.append(model.score(n, of[hit], at))
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=[id_col, "score"])

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, score double")
