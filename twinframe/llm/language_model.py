"""Log-likelihood of whole texts under a gated recurrent language model, next to a unigram base.

Tokens are runs without white space, A-Z lower-cased, and one end token for each text. Counts of all training tokens, made
by Spark, give the base and the vocabulary. The most frequent tokens that make up ``COVERED`` of all training tokens (and at
least ``HEAD`` of them) are predicted each: their class, their group in it, and the token in its group, all of like
frequency. All others belong to classes by their last two bytes, which are one more group; inside such a class a token's
share is its smoothed count:

    P(token | state) = softmax(class | state) * softmax(group | class, state) * softmax(token | group, state)
          or, for all others,  softmax(others | state) * softmax(class | state) * (c + 0.1) / (N_class + 0.1 (V_class + 1))

So any token has a probability, unknown ones that of a token never seen in their class. Frequent tokens are in small groups:
with groups per token in proportion to the root of its count, fewest outputs are worked out for a token of the text.

The network is trained in numpy by truncated backpropagation: a first time on a bounded sample (``PILOT_TEXTS``) on the
driver, then by every task on all training texts it reads, from the same start, and Spark averages the tasks' weights by
tokens. For training, texts are cut into segments of ``SEGMENT`` tokens, whose windows carry the state on. For scoring the
state is carried over the windows of the whole text. Texts are worked on side by side, longest first, so that one step of
the network serves all that are still running.

Null texts count as empty: one end token. Repeated rows are scored each. Without training texts both scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.arrow_text import Powers, Texts, lower_bytes, mixed, texts_of
from twinframe.llm.labels import bounded
from twinframe.session import stage

#: Share of the training tokens that are head tokens, so the head grows with the corpus.
COVERED = 0.75
#: Fewest head tokens, fewest of them in a group on average, and classes of all other tokens.
HEAD, CLASS_SIZE, TAIL = 2048, 64, 48
#: Tokens whose counts every task holds, and at least the head; counts of others are joined.
FREQUENT = 65_536
EMBEDDED, HIDDEN = 16, 24
WINDOW, SEGMENT, SIDE_BY_SIDE = 24, 480, 256
PILOT_TEXTS, PILOT_PASSES = 2000, 2
SMOOTH = 0.1
#: Words that one group of texts may hold while it is scored.
GROUP_TOKENS = 1 << 21
#: Words whose outputs are worked out at once while they are scored.
SCORED = 1 << 16
#: Outputs that are worked out at once and weights that are moved at once (both stay in a processor's cache), and weights that
#: are averaged as one row.
AT_ONCE, MOVED, CHUNK = 1 << 16, 1 << 14, 4096
END = np.uint64(0xE4D0E4D0E4D0E4D1)


def tokens(texts: Texts, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and last-bytes class of all tokens, text after text, and bounds (one more entry than texts)."""
    words = texts.words(powers, lower=True)
    low = lower_bytes()
    last = low[texts.data[words.end - 1]].astype(np.uint64)
    before = np.where(words.end - words.start > 1, low[texts.data[np.maximum(words.end - 2, 0)]], 0).astype(np.uint64)
    shape = (mixed(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(TAIL)).astype(np.int64)
    ends = np.searchsorted(words.text, np.arange(len(texts)), side="right")
    return np.insert(words.hash, ends, END), np.insert(shape, ends, 0), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def like_frequency(shares: np.ndarray, wanted: float) -> np.ndarray:
    """First of each of about ``wanted`` runs of ``shares`` (and their end), whose sums of roots are alike."""
    roots = np.cumsum(np.sqrt(shares))
    n = max(1, round(wanted))
    cuts = np.searchsorted(roots, roots[-1] * np.arange(1, n) / n, side="right") if len(roots) else []
    return np.unique(np.concatenate([[0], cuts, [len(shares)]]).astype(np.int64))


@dataclass
class Level:
    """One choice on the way to a token. Members stand for runs of network inputs and belong to groups, one of which the level
    before has chosen. ``edges``: first input of each member, ``starts``: first member of each group, both with an end."""

    edges: np.ndarray
    starts: np.ndarray

    @cached_property
    def member_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))

    def parts(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """For ascending inputs: places in their groups, and the members and rows of each group that has rows."""
        cuts = np.searchsorted(ids, self.edges[self.starts])
        place = self.member_of[ids[: cuts[-1]]] - np.repeat(self.starts[:-1], np.diff(cuts))
        parts, starts, used = [], self.starts.tolist(), np.flatnonzero(np.diff(cuts)).tolist()
        cuts = cuts.tolist()
        for k in used:
            rows = max(1, AT_ONCE // (starts[k + 1] - starts[k]))
            parts += [(slice(starts[k], starts[k + 1]), slice(at, min(at + rows, cuts[k + 1]))) for at in range(cuts[k], cuts[k + 1], rows)]
        return place, parts


@dataclass
class Vocabulary:
    """Counts that all tasks hold: sorted hashes of frequent tokens with counts and places in the head (-1: none)."""

    terms: np.ndarray
    counts: np.ndarray
    place: np.ndarray
    head_counts: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def head(self) -> int:
        return len(self.head_counts)

    @cached_property
    def levels(self) -> list[Level]:
        """Classes; groups of each class, and classes of all other tokens; head tokens of each group. With c groups, a token
        costs c outputs and those of its group, about r / c on average, r the squared sum of the roots of the shares."""
        shares, tail = self.head_counts / max(self.total, 1), self.head + np.arange(TAIL + 1)
        groups = like_frequency(shares, min(np.sqrt(shares).sum(), -(-self.head // CLASS_SIZE)))
        of_groups = np.add.reduceat(shares, groups[:-1]) if self.head else shares
        classes = like_frequency(of_groups, np.sqrt(of_groups).sum())
        return [
            Level(np.append(groups[classes], tail[-1]), np.array([0, len(classes)])),
            Level(np.concatenate([groups[:-1], tail]), np.append(classes, classes[-1] + TAIL)),
            Level(np.arange(self.head + 1), groups),
        ]

    @property
    def head_classes(self) -> int:
        return len(self.levels[0].edges) - 2

    @property
    def class_size(self) -> int:
        """Head tokens of the largest class."""
        return int(np.diff(self.levels[0].edges[:-1]).max(initial=0))

    def ascending(self, ids: np.ndarray) -> np.ndarray:
        """Order of network inputs; numpy sorts numbers of two bytes by digits, in their old order if equal."""
        small = self.head + TAIL <= 1 << 16
        return np.argsort(ids.astype(np.uint16 if small else np.int32), kind="stable" if small else None)

    @cached_property
    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """The frequent tokens' hashes with an end, and the first of them at or after each value of a hash's first 20 bits."""
        firsts = np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)
        return np.append(self.terms, np.uint64(2**64 - 1)), np.searchsorted(self.terms, firsts)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent tokens, -1 for others."""
        terms, first = self.buckets
        at = first[hashes >> np.uint64(44)]
        low = np.flatnonzero(terms[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[terms[at[low]] < hashes[low]]
        return np.where((terms[at] == hashes) & (at < len(self.terms)), at, -1)

    def ids(self, at: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Network inputs: head tokens first, then a class of last bytes for all others."""
        place = np.where(at >= 0, self.place[np.maximum(at, 0)], -1) if len(self.terms) else at
        return np.where(place >= 0, place, self.head + shape)


@dataclass
class Network:
    """Weights. Those of the outputs hold the bias as one more input, the last, which is 1."""

    embed: np.ndarray
    into: np.ndarray
    bias: np.ndarray
    over: np.ndarray
    to_class: np.ndarray
    to_group: np.ndarray
    to_word: np.ndarray

    NAMES = ("embed", "into", "bias", "over", "to_class", "to_group", "to_word")

    @property
    def outputs(self) -> list[np.ndarray]:
        """By level, a row for each member."""
        return [self.to_class, self.to_group, self.to_word]

    @property
    def class_bias(self) -> np.ndarray:
        """Of each class of head tokens, then of each class of other tokens."""
        return np.concatenate([self.to_class[:-1, HIDDEN], self.to_group[-TAIL:, HIDDEN]])

    @property
    def word_bias(self) -> np.ndarray:
        """Of each head token, as one row."""
        return self.to_word[None, :, HIDDEN]

    @staticmethod
    def first(words: Vocabulary) -> Network:
        """Small random weights; output biases give the unigram distribution."""
        random = np.random.default_rng(11)

        def draw(*shape: int) -> np.ndarray:
            return random.normal(0, 0.1, shape).astype(np.float32)

        net = Network(
            draw(words.head + TAIL, EMBEDDED), draw(EMBEDDED, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32), draw(HIDDEN, 3 * HIDDEN),
            *(draw(len(level.edges) - 1, HIDDEN + 1) for level in words.levels),
        )
        counts = np.concatenate([np.maximum(words.head_counts.astype(np.float64), 1e-12), words.class_total + 1.0])
        for level, weights in zip(words.levels, net.outputs):
            member = np.add.reduceat(counts, level.edges[:-1]) if len(weights) else np.zeros(0)
            group = np.add.reduceat(member, level.starts[:-1]) if len(weights) else member
            weights[:, HIDDEN] = np.log(member / np.repeat(group, np.diff(level.starts)))
        return net

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def zeros(self) -> Network:
        return Network(*(np.zeros_like(a) for a in self.arrays()))

    def copy(self) -> Network:
        return Network(*(a.copy() for a in self.arrays()))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([a.size for a in self.arrays()])[:-1]
        return Network(*(p.reshape(a.shape).astype(np.float32) for p, a in zip(np.split(flat, cuts), self.arrays())))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Written over ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """Written over ``x``; by ``exp``, which numpy has several times faster than its own ``tanh``."""
    x *= 2
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def step(net: Network, inward: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """New states from the inputs' share of the gates, and what the backward step needs. Arrays have a row for each text; in
    memory a number of all texts lies together, so that each gate is one block."""
    own, inward, state = net.over.T @ state.T, inward.T, state.T
    gates, last = own[: 2 * HIDDEN], own[2 * HIDDEN :]
    gates += inward[: 2 * HIDDEN]
    sigmoid(gates)
    keep, reset = gates[:HIDDEN], gates[HIDDEN:]
    fresh = reset * last
    fresh += inward[2 * HIDDEN :]
    tanh(fresh)
    new = state - fresh
    new *= keep
    new += fresh
    return new.T, keep.T, reset.T, fresh.T, last.T


def with_one(states: np.ndarray) -> np.ndarray:
    """One more number of each row, 1, for the bias."""
    wide = np.ones((len(states), HIDDEN + 1), states.dtype)
    wide[:, :HIDDEN] = states
    return wide


def log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the chosen entry of each row's softmax; ``x`` is written over. Weights are small and states within 1, so no row
    has to be shifted against overflow."""
    own = x[np.arange(len(x)), chosen]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


def log_likelihood(net: Network, words: Vocabulary, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of the probability of the token, or of the class of other tokens."""
    order = words.ascending(ids)
    states, ids = with_one(states[order]), ids[order]
    shares, out = np.zeros(len(ids), np.result_type(states, net.to_class)), np.empty(len(ids), np.result_type(states, net.to_class))
    for level, weights in zip(words.levels, net.outputs):
        place, parts = level.parts(ids)
        for members, part in parts:
            shares[part] += log_share(states[part] @ weights[members].T, place[part])
    out[order] = shares
    return out


def output_slopes(net: Network, words: Vocabulary, states: np.ndarray, ids: np.ndarray, slopes: Network) -> np.ndarray:
    """Adds the output layers' slopes of the mean loss to ``slopes`` and returns those of the states; ``ids`` are ascending."""
    n, states, kind = len(ids), with_one(states), net.to_class.dtype
    back, row = np.zeros((n, HIDDEN + 1), kind), np.arange(n)
    ones = np.ones(max(int(np.diff(level.starts).max(initial=0)) for level in words.levels), kind)
    for level, weights, change in zip(words.levels, net.outputs, slopes.outputs):
        place, parts = level.parts(ids)
        for members, part in parts:
            of, out = states[part], weights[members]
            x = of @ out.T
            np.exp(x, out=x)
            total = x @ ones[: x.shape[1]]
            total *= n
            x /= total[:, None]
            x.reshape(-1)[row[: len(x)] * x.shape[1] + place[part]] -= 1 / n
            change[members] += x.T @ of
            back[part] += x @ out
    return back[:, :HIDDEN]


def window_slopes(
    net: Network, words: Vocabulary, ids: np.ndarray, live: np.ndarray, state: np.ndarray, slopes: Network | None = None
) -> tuple[Network, np.ndarray]:
    """Slopes over one window (``ids``: steps by texts, ``live``: which of them are tokens), and the states after it.
    ``slopes`` are zeros to write them to."""
    (steps, side), kind = ids.shape, net.over.dtype
    slopes = slopes or net.zeros()
    inputs = net.embed[ids]
    inward = np.matmul(net.into.T, inputs.transpose(0, 2, 1))
    inward += net.bias[:, None]
    before, kept = np.empty((steps, HIDDEN, side), kind), []
    for t in range(steps):
        before[t] = state.T
        state, *rest = step(net, inward[t].T, state)
        kept.append([x.T for x in rest])
    at = np.flatnonzero(live)
    at = at[words.ascending(ids.ravel()[at])]
    sorted_ids, back = ids.ravel()[at], np.zeros((steps * side, HIDDEN), kind)
    back[at] = output_slopes(net, words, before.transpose(0, 2, 1).reshape(-1, HIDDEN)[at], sorted_ids, slopes)
    back = np.ascontiguousarray(back.reshape(steps, side, HIDDEN).transpose(0, 2, 1))
    gate_slopes, fresh_slopes = np.empty((steps, 3 * HIDDEN, side), kind), np.empty((steps, HIDDEN, side), kind)
    carry = np.zeros((HIDDEN, side), kind)
    for t in reversed(range(steps)):
        keep, reset, fresh, own = kept[t]
        of_keep, of_reset, of_own = (gate_slopes[t, k : k + HIDDEN] for k in (0, HIDDEN, 2 * HIDDEN))
        of_fresh = fresh_slopes[t]
        lose = 1 - keep
        lose *= carry
        np.multiply(fresh, fresh, out=of_fresh)
        np.subtract(1, of_fresh, out=of_fresh)
        of_fresh *= lose
        np.subtract(before[t], fresh, out=of_keep)
        of_keep *= keep
        of_keep *= lose
        np.multiply(of_fresh, reset, out=of_own)
        np.subtract(1, reset, out=of_reset)
        of_reset *= of_own
        of_reset *= own
        carry *= keep
        carry += net.over @ gate_slopes[t]
        carry += back[t]
    slopes.over += np.matmul(before, gate_slopes.transpose(0, 2, 1)).sum(0)
    gate_slopes[:, 2 * HIDDEN :] = fresh_slopes
    by_text = gate_slopes.transpose(0, 2, 1)
    slopes.into += np.matmul(inputs.transpose(0, 2, 1), by_text).sum(0)
    slopes.bias += gate_slopes.sum((0, 2))
    first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
    slopes.embed[sorted_ids[first]] = np.add.reduceat(np.matmul(by_text, net.into.T).reshape(-1, EMBEDDED)[at], first, axis=0)
    return slopes, state


@dataclass
class Trainer:
    """Adam over windows; weights of ``net`` are changed in place. ``spare`` holds slopes, moments and squares' moments."""

    net: Network
    words: Vocabulary
    rate: float
    steps: int = 0
    spare: list[Network] = field(default_factory=list)

    def learn(self, segments: list[np.ndarray]) -> None:
        """One pass over segments of token ids, those of like length side by side."""
        self.spare = self.spare or [self.net.zeros() for _ in range(3)]
        order = sorted(range(len(segments)), key=lambda k: -len(segments[k]))
        groups = [order[k : k + SIDE_BY_SIDE] for k in range(0, len(order), SIDE_BY_SIDE)]
        for g in np.random.default_rng(5).permutation(len(groups)):
            group = [segments[k] for k in groups[g]]
            sizes = np.array([len(s) for s in group])
            ids = np.zeros((sizes.max(initial=0), len(group)), dtype=np.int64)
            for k, s in enumerate(group):
                ids[: len(s), k] = s
            state = np.zeros((len(group), HIDDEN), np.float32)
            for begin in range(0, len(ids), WINDOW):
                running = int((sizes > begin).sum())
                part = ids[begin : begin + WINDOW, :running]
                live = np.arange(begin, begin + len(part))[:, None] < sizes[:running]
                _, state = window_slopes(self.net, self.words, part, live, state[:running], self.spare[0])
                self._move()

    def _move(self) -> None:
        """One step by the slopes, which become zeros again. Moments are kept as plain sums of g and g * g: their factors 0.1
        and 0.005 go into the step."""
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in self.spare[0].arrays()))
        self.steps += 1
        wide = np.sqrt(0.005 / (1 - 0.995**self.steps))
        shrink, least, ahead = min(1.0, 1.0 / (norm + 1e-9)), 1e-6 / wide, 0.1 * self.rate / (1 - 0.9**self.steps) / wide
        for whole in zip(*(n.arrays() for n in (self.net, *self.spare))):
            flat = [x.reshape(-1) for x in whole]
            for begin in range(0, len(flat[0]), MOVED):
                a, g, m, q = (x[begin : begin + MOVED] for x in flat)
                if shrink < 1:
                    g *= shrink
                m *= 0.9
                m += g
                g *= g
                q *= 0.995
                q += g
                np.sqrt(q, out=g)
                g += least
                np.divide(m, g, out=g)
                g *= ahead
                a -= g
                g.fill(0)


def segments_of(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [ids[a : min(a + SEGMENT, end)] for start, end in zip(bounds[:-1], bounds[1:]) for a in range(start, end, SEGMENT)]


def token_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``term``, ``shape`` and ``n`` of all tokens; added up inside each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts = [tokens(t, powers)[:2] for t in texts_of(batch.column(0))]
            if parts:
                hashes, shape = (np.concatenate(p) for p in zip(*parts))
                terms, first, n = np.unique(hashes, return_index=True, return_counts=True)
                columns = [pa.array(terms.view(np.int64)), pa.array(shape[first].astype(np.int32)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "shape", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, shape int, n long")
    return rows.groupBy("term").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


def covering(counts: DataFrame) -> int:
    """Fewest tokens that make up ``COVERED`` of all, from the number of tokens that occur n times."""
    rows = sorted((r["n"], r["tokens"]) for r in counts.groupBy("n").agg(F.count("*").alias("tokens")).collect())
    missing, head = COVERED * sum(n * tokens for n, tokens in rows), 0
    for n, tokens in reversed(rows):
        if missing <= n * tokens:
            return head + ceil(missing / n)
        missing, head = missing - n * tokens, head + tokens
    return head


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From written ``token_counts``: only the frequent tokens and one row per class come to the driver."""
    head = max(HEAD, covering(counts))
    top = counts.orderBy(F.desc("n"), "term").limit(max(FREQUENT, head)).collect()
    terms = np.array([r["term"] for r in top], dtype=np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], dtype=np.int64)
    head = min(head, len(top))
    class_total, class_distinct = np.zeros(TAIL, dtype=np.int64), np.zeros(TAIL, dtype=np.int64)
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_total[r["shape"]], class_distinct[r["shape"]] = r["n"], r["v"]
    total, distinct = int(class_total.sum()), int(class_distinct.sum())
    for r in top[:head]:
        class_total[r["shape"]] -= r["n"]
        class_distinct[r["shape"]] -= 1
    place = np.where(np.arange(len(top)) < head, np.arange(len(top)), -1)
    order = np.argsort(terms)
    return Vocabulary(terms[order], n[order], place[order], n[:head], total, distinct, class_total, class_distinct)


def network_ids(texts: Texts, powers: Powers, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    hashes, shape, bounds = tokens(texts, powers)
    return words.ids(words.look_up(hashes), shape), bounds


def pilot(texts: DataFrame, id_col: str, text_col: str, words: Vocabulary) -> Network:
    """A network trained on the driver on a bounded sample of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in texts_of(batch.column(0)):
                ids, bounds = network_ids(part, powers, words)
                rows = [s.astype(np.int32).tobytes() for s in segments_of(ids, bounds)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    sample = bounded(texts.select(id_col, text_col), id_col, PILOT_TEXTS, seed=6)
    rows = sample.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "ids binary").collect()
    segments = [np.frombuffer(r["ids"], dtype=np.int32).astype(np.int64) for r in rows]
    trainer = Trainer(Network.first(words), words, rate=0.01)
    for _ in range(PILOT_PASSES):
        trainer.learn(segments)
        trainer.rate /= 2
    return trainer.net


def averaged(texts: DataFrame, text_col: str, words: Vocabulary, start: Network) -> Network:
    """Every task goes on from ``start`` over all texts it reads; weights are averaged by tokens, each weight by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), 0
        trainer = Trainer(start.copy(), words, rate=0.002)
        for batch in batches:
            segments: list[np.ndarray] = []
            waiting = 0
            for part in texts_of(batch.column(0)):
                ids, bounds = network_ids(part, powers, words)
                segments += segments_of(ids, bounds)
                waiting += len(ids)
                if waiting > GROUP_TOKENS // 2:
                    trainer.learn(segments)
                    segments, seen, waiting = [], seen + waiting, 0
            trainer.learn(segments)
            seen += waiting
        if seen:
            flat = trainer.net.flat().astype(np.float32)
            chunks = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
            at = np.arange(len(chunks), dtype=np.int64) * CHUNK
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(chunks), seen)), pa.array(chunks, pa.binary())], names=["at", "tokens", "chunk"])

    def mean(table: pa.Table) -> pa.Table:
        tokens, total = table.column("tokens").to_numpy(), 0
        for n, chunk in zip(tokens, table.column("chunk").to_pylist()):
            total = total + np.frombuffer(chunk, np.float32) * float(n)
        return pa.table({"at": table.column("at").slice(0, 1), "chunk": pa.array([(total / tokens.sum()).tobytes()], pa.binary())})

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "at long, tokens long, chunk binary")
    flat = start.flat().astype(np.float64)
    for r in rows.groupBy("at").applyInArrow(mean, "at long, chunk binary").collect():
        values = np.frombuffer(r["chunk"], np.float64)
        flat[r["at"] : r["at"] + len(values)] = values
    return start.filled(flat)


def document_scores(net: Network, words: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each text (for tail tokens of their class), the state carried over all its windows."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, size = bounds[:-1][order], sizes[order]
    inward = net.embed @ net.into + net.bias
    state = np.zeros((HIDDEN, len(order)), np.float32).T
    out, shorter, waiting = np.zeros(len(order)), -size, []
    for at in range(0, int(size.max(initial=0)), WINDOW):
        times = np.arange(at, min(at + WINDOW, int(size[0])))
        live = np.searchsorted(shorter, -times, side="left")
        cuts = np.concatenate([[0], np.cumsum(live)])
        whose = np.arange(cuts[-1]) - np.repeat(cuts[:-1], live)
        found = ids[begin[whose] + np.repeat(times, live)]
        states = np.empty((len(found), HIDDEN), np.float32)
        for n, first, end in zip(live.tolist(), cuts.tolist(), cuts[1:].tolist()):
            state = state[:n]
            states[first:end] = state
            state = step(net, inward[found[first:end]], state)[0]
        waiting.append((whose, states, found))
        if sum(len(w[0]) for w in waiting) > SCORED or at + WINDOW >= size[0]:
            whose, states, found = (np.concatenate(x) for x in zip(*waiting))
            out += np.bincount(whose, log_likelihood(net, words, states, found), minlength=len(out))
            waiting = []
    scores = np.empty(len(order))
    scores[order] = out
    return scores


def scored(docs: DataFrame, words: Vocabulary, net: Network, counts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every text.

    Tasks score all that they can with the frequent tokens' counts. The other tokens of each text leave as a list, are
    joined with the counts by token, added up by text and joined to the rest.
    """
    log10 = np.log(10)

    def group(keys: pa.Array, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, shape = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        sizes = np.concatenate([np.diff(p[2]) for p in parts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = words.look_up(hashes)
        ids = words.ids(at, shape)
        n, rare = len(sizes), at < 0
        weight = np.log10(words.counts[np.maximum(at, 0)] + SMOOTH) if len(words.terms) else np.zeros(len(at))
        base = np.bincount(of, np.where(rare, 0, weight), minlength=n) - sizes * np.log10(words.total + SMOOTH * (words.distinct + 1))
        tail = ids >= words.head
        share = -np.log10(words.class_total + SMOOTH * (words.class_distinct + 1))[shape]
        share = share + np.where(rare, 0, weight)
        score = document_scores(net, words, ids, bounds) / log10 + np.bincount(of, np.where(tail, share, 0), minlength=n)
        keyed = mixed(hashes[rare] ^ mixed(of[rare].astype(np.uint64) + np.uint64(1)))
        _, first, times = np.unique(keyed, return_index=True, return_counts=True)
        who, what = of[rare][first], hashes[rare][first]
        order = np.argsort(who, kind="stable")
        cuts = pa.array(np.searchsorted(who[order], np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(v[order])) for v in (what.view(np.int64), times.astype(np.int64))]
        known = np.bincount(of, ~rare, minlength=n).astype(np.int64)
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes), pa.array(known), pa.array(base), pa.array(score), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts, first, waiting = [], 0, 0
            for texts in texts_of(batch.column(1)):
                parts.append(tokens(texts, powers))
                waiting += len(parts[-1][0])
                last = texts.first + len(texts)
                if waiting > GROUP_TOKENS or last == batch.num_rows:
                    yield group(batch.column(0).slice(first, last - first), parts)
                    parts, first, waiting = [], last, 0

    names = [id_col, "n_tokens", "known", "base", "partial", "terms", "times"]
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {picked.schema[0].dataType.simpleString()}, n_tokens long, known long, base double, partial double, terms array<long>, times array<long>"
    rows = stage(picked.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("__row", F.explode(F.arrays_zip("terms", "times")).alias("r")).select("__row", F.col("r.terms").alias("term"), F.col("r.times").alias("times"))
    joined = rare.join(counts.select("term", "n"), "term", "left")
    added = joined.groupBy("__row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"),
    )
    final = rows.drop("terms", "times").join(added, "__row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return final.select(
        id_col,
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"),
        (F.col("partial") + more).alias("score"),
    )


def likelihoods(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by a model of those where ``training`` holds, with ``train_tokens``."""
    texts = docs.where(training)
    counts = stage(token_counts(texts, text_col), "counts")
    words = vocabulary(counts)
    if not words.total:
        net = Network.first(words)
    else:
        net = averaged(texts, text_col, words, pilot(texts, id_col, text_col, words))
    rows = scored(docs, words, net, counts, id_col, text_col)
    if not words.total:
        rows = rows.withColumn("score", F.lit(0.0))
    return rows.withColumn("train_tokens", F.lit(words.total).cast("long"))
