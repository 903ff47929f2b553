"""Quality classifier, toxicity and language model."""

import collections
import math
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from twinframe.llm import language_model, quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(rows):
    """Share of pairs (label 1, label 0) in the right order."""
    ones, zeros = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def labelled(spark, frame, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return frame.join(labels, "doc_id").where("held_out").select("score", label, "predicted").collect()


def test_quality_on_held_out_labels(spark):
    frame = queries.op1_pu_quality(spark, SF)
    rows = frame.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = labelled(spark, frame, "quality")
    assert auc([(r.score, r.quality) for r in held]) > 0.95
    good = [r.predicted for r in held if r.quality == 1]
    assert sum(good) > 0.97 * len(good)


def test_toxicity_on_held_out_labels(spark):
    frame = queries.op9_toxic_pairs(spark, "/root/testdata/sf0.01")
    held = labelled(spark, frame, "toxic")
    assert auc([(r.score, r.toxic) for r in held]) > 0.75
    clean = [r.predicted for r in held if r.toxic == 0]
    assert sum(clean) < 0.05 * len(clean)


def test_factors_learn_a_pair_of_terms(spark):
    """Neither term alone is toxic, both together are: no additive model can tell."""
    random = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(1200):
        insult, group = map(int, random.random(2) < 0.5)
        words = [f"w{k}" for k in random.integers(0, 60, 12)] + ["insult"] * insult + ["group"] * group
        docs.append((i, " ".join(random.permutation(words).tolist())))
        labels.append((i, int(insult and group or not insult and not group)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels[:900], "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in toxicity.scored(frame, model).collect()}
    assert auc([(scores[i], y) for i, y in labels[900:]]) > 0.9


def test_positive_unlabelled_prior_and_scores():
    random = np.random.default_rng(1)
    draw = lambda n, at: np.hstack([np.ones((n, 1)), random.normal(at, 1, (n, 2))]).astype(np.float32)
    unlabelled = np.vstack([draw(1400, 2.0), draw(600, -2.0)])
    model = quality_classifier.fit(draw(1000, 2.0), unlabelled, 0.7)
    assert (model.score(draw(500, 2.0)) > 0.7).mean() > 0.95 and (model.score(draw(500, -2.0)) < 0.5).mean() > 0.95


def test_estimated_prior(spark):
    docs = spark.createDataFrame([(i, "good clean words here" if i % 4 else "JUNK!! *** ###") for i in range(400)], "doc_id long, text string")
    positives = docs.where("doc_id % 4 <> 0 AND doc_id % 3 = 0").select("doc_id")
    model = quality_classifier.train(docs, positives)
    assert 0.7 < model.prior < 0.85
    scores = {r.doc_id: r.score for r in quality_classifier.scored(docs, model).collect()}
    assert all((scores[i] >= 0.7) == (i % 4 != 0) for i in scores)


def test_models_on_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (6, 0), (12, 0)], "doc_id long, toxic int")
    for frame in (edges, nothing):
        model = toxicity.train(frame, labels)
        assert toxicity.scored(frame, model).count() == frame.count()
        fitted = quality_classifier.train(frame, labels.select("doc_id"))
        scores = quality_classifier.scored(frame, fitted).collect()
        assert len(scores) == frame.count() and all(0 <= r.score <= 1 for r in scores)
        assert quality_classifier.accepted(frame, fitted, 0.0).columns == edges.columns
    assert toxicity.train(edges, labels.limit(0)).score(1, np.zeros(0, int), np.zeros(0, int))[0] < 0.01
    assert quality_classifier.train(edges, labels.limit(0).select("doc_id")) is None


def plain_base(docs, training):
    tokens = {d: [*plain.WORD.findall(plain.lowered(t or "")), None] for d, t in docs}
    counts = collections.Counter(w for d, ws in tokens.items() if training(d) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    whole = math.log10(total + 0.1 * (distinct + 1))
    return total, {d: (len(ws), sum(w in counts for w in ws), sum(math.log10(counts[w] + 0.1) - whole for w in ws)) for d, ws in tokens.items()}


def test_language_model_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    total, wanted = plain_base(docs, lambda d: zlib.crc32(str(d).encode()) % 10 != 0)
    rows = queries.op2_gru_likelihood(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, base = wanted[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def small_vocabulary():
    counts = np.array([50, 40, 30, 20, 10])
    tail = np.zeros(language_model.TAIL, dtype=np.int64)
    tail[3], distinct = 60, np.zeros(language_model.TAIL, dtype=np.int64)
    distinct[3] = 12
    terms = np.array([11, 12, 13, 14, 15], dtype=np.uint64)
    return language_model.Vocabulary(terms, counts, np.arange(5), counts, 210, 17, tail, distinct)


def test_slopes_against_differences():
    words = small_vocabulary()
    net = language_model.Network.first(words)
    net = language_model.Network(*(a.astype(np.float64) for a in net.arrays()))
    random = np.random.default_rng(3)
    ids = random.choice([0, 1, 2, 3, 4, 8], (6, 4))
    live = np.arange(6)[:, None] < np.array([6, 6, 4, 2])

    def loss():
        state, before = np.zeros((4, language_model.HIDDEN)), []
        for t in range(6):
            before.append(state)
            state = language_model.step(net, net.embed[ids[t]] @ net.into + net.bias, state)[0]
        return -language_model.log_likelihood(net, words, np.stack(before)[live], ids[live]).mean()

    slopes, _ = language_model.window_slopes(net, words, ids, live, np.zeros((4, language_model.HIDDEN)))
    for array, slope in zip(net.arrays(), slopes.arrays()):
        at = np.unravel_index(np.argmax(np.abs(slope)), slope.shape)
        keep = array[at]
        array[at] = keep + 1e-4
        up = loss()
        array[at] = keep - 1e-4
        down = loss()
        array[at] = keep
        assert slope[at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=1e-6)


def test_side_by_side_scores_equal_single_ones():
    words = small_vocabulary()
    net = language_model.Network.first(words)
    random = np.random.default_rng(4)
    sizes = [1, 70, 23, 24, 25, 3, 200]
    ids = random.choice([0, 1, 2, 3, 4, 8], sum(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    every = language_model.document_scores(net, words, ids, bounds)
    for k, n in enumerate(sizes):
        alone = language_model.document_scores(net, words, ids[bounds[k] : bounds[k + 1]], np.array([0, n]))
        assert every[k] == pytest.approx(alone[0], rel=1e-5)


def test_probabilities_add_up_to_one():
    words = small_vocabulary()
    net = language_model.Network.first(words)
    state = np.random.default_rng(5).normal(0, 1, (1, language_model.HIDDEN)).astype(np.float32)
    ids = np.arange(words.head + language_model.TAIL)
    total = np.exp(language_model.log_likelihood(net, words, np.repeat(state, len(ids), 0), ids)).sum()
    padding = float(np.exp(net.word_bias[0])[words.head :].sum())
    assert total == pytest.approx(1, abs=1e-3 + padding)


def test_language_model_edges(spark, edges, nothing):
    everything = F.lit(True)
    for frame in (edges, nothing):
        rows = language_model.likelihoods(frame, everything).collect()
        assert len(rows) == frame.count() and all(r.score < 0 and r.n_known == r.n_tokens for r in rows)
    empty = language_model.likelihoods(edges, ~everything).collect()
    assert len(empty) == edges.count() and {(r.base_score, r.score, r.n_known, r.train_tokens) for r in empty} == {(0.0, 0.0, 0, 0)}


def test_language_model_keeps_its_size():
    """The state and the classes of other tokens are not cut to save time: held-out scores fall with them."""
    words = small_vocabulary()
    net = language_model.Network.first(words)
    assert net.over.shape == (24, 3 * 24) and len(net.class_bias) == words.head_classes + 48


def test_head_grows_with_the_corpus(spark):
    rows = [(k, k % language_model.TAIL, 1 + (k % 1000 == 0)) for k in range(20_000)]
    words = language_model.vocabulary(spark.createDataFrame(rows, "term long, shape int, n long"))
    head = words.head
    assert words.head_counts.sum() >= language_model.COVERED * words.total > words.head_counts[:-1].sum() and head > 2048
    assert words.class_size**2 >= head and words.head_classes <= words.class_size
    net = language_model.Network.first(words)
    assert net.to_word.shape[0] * net.to_word.shape[1] >= head and len(net.embed) == head + language_model.TAIL


def test_few_outputs_for_each_token(monkeypatch):
    """Tokens of a corpus come with unequal counts: their groups must cost less than classes of equal size."""
    counts = np.sort((1e6 / np.arange(1, 20_001)).astype(np.int64))[::-1]
    total = int(counts.sum())
    tail = np.zeros(language_model.TAIL, dtype=np.int64)
    words = language_model.Vocabulary(np.zeros(0, np.uint64), counts[:0], counts[:0], counts, total, len(counts), tail, tail)
    net = language_model.Network.first(words)
    outputs = np.zeros(words.head)
    for level in words.levels:
        size = np.repeat(np.diff(level.starts), np.diff(level.edges[level.starts]))
        outputs += size[: words.head]
    assert (outputs * counts).sum() / total < 0.6 * 2 * np.sqrt(words.head)
    ids = np.random.default_rng(1).choice(words.head, 3000, p=counts / total)
    states = np.random.default_rng(2).normal(0, 0.5, (3000, language_model.HIDDEN)).astype(np.float32)
    whole = language_model.log_likelihood(net, words, states, ids)
    monkeypatch.setattr(language_model, "AT_ONCE", 500)
    assert language_model.log_likelihood(net, words, states, ids) == pytest.approx(whole, abs=1e-4)
    inputs = np.arange(words.head + language_model.TAIL)
    every = language_model.log_likelihood(net, words, np.repeat(states[:1], len(inputs), 0), inputs)
    assert np.exp(every.astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_look_up_of_hashes_that_share_their_first_bits():
    terms = np.array([3, 5, 1 << 44, (1 << 44) + 7, (1 << 63) + 1, (1 << 64) - 2], dtype=np.uint64)
    n = np.ones(6, dtype=np.int64)
    words = language_model.Vocabulary(terms, n, np.arange(6), n, 6, 6, n, n)
    asked = np.array([0, 3, 4, 5, 6, 1 << 44, (1 << 44) + 1, (1 << 44) + 7, (1 << 44) + 8, 1 << 63, (1 << 63) + 1, (1 << 64) - 2, (1 << 64) - 1], dtype=np.uint64)
    assert words.look_up(asked).tolist() == [-1, 0, -1, 1, -1, 2, -1, 3, -1, -1, 4, 5, -1]


def test_outputs_of_many_windows_at_once_change_no_score(monkeypatch):
    words = small_vocabulary()
    net = language_model.Network.first(words)
    ids = np.random.default_rng(6).choice([0, 1, 2, 3, 4, 8], 400)
    bounds = np.array([0, 1, 130, 130, 331, 400])
    whole = language_model.document_scores(net, words, ids, bounds)
    monkeypatch.setattr(language_model, "SCORED", 0)
    assert language_model.document_scores(net, words, ids, bounds) == pytest.approx(whole, rel=1e-6)
