"""Ranked lexical search over ball trees."""

import collections
import math
import re

import numpy as np
import pytest

from twinframe.llm import ball_tree, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            found += [(doc, score)] * (score > 0)
        found.sort(key=lambda f: (-f[1], f[0] is None, f[0]))
        out += [(item, i + 1, d, s) for i, (d, s) in enumerate(found[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    frame = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical_search.search(frame, asked, k).collect()), key=str)


def random_docs(draw, n):
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    return [(i, " ".join(draw.choice(words, draw.integers(1, 60), p=share / share.sum()))) for i in range(n)]


@pytest.mark.parametrize("block", [lexical_search.BLOCK_TERMS, 40])
@pytest.mark.parametrize("leaf", [4, 128])
def test_search_against_brute_force(spark, monkeypatch, block, leaf):
    """Several trees and blocks of queries, equal scores, repeated rows and terms."""
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "TREE", 64)
    monkeypatch.setattr(ball_tree, "LEAF", leaf)
    draw = np.random.default_rng(8)
    docs = random_docs(draw, 400)
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)] + [(7, docs[7][1])] * 2
    items = [(i, text) for i, (_, text) in enumerate(random_docs(draw, 12))] + [(50, "W1 w1, w250?"), (50, "w2 nowhere"), (51, "nowhere")]
    assert searched(spark, docs, items) == plain(docs, items)
    assert searched(spark, docs, items[:3], k=3) == plain(docs, items[:3], k=3)


def test_search_edges(spark, edges, nothing):
    items = [(1, None), (2, ""), (3, "... !"), (None, "the QUICK brown"), (5, "漢字 Ünïcode word17 x"), (6, "again endoftext")]
    docs = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert searched(spark, edges, items) == plain(docs, items)
    assert searched(spark, nothing, items) == [] and searched(spark, edges, items[:3]) == []
    empty = lexical_search.search(edges, spark.createDataFrame([], "item_id long, text string"))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def clustered(draw, groups, size, width):
    """Rows of like values on a few supports, in random order."""
    rows = []
    for g in range(groups):
        support = draw.choice(width, 12, replace=False)
        for _ in range(size):
            own = np.sort(draw.choice(support, 10, replace=False))
            rows.append((own, draw.integers(9 * 10**5, 10**6, len(own)).astype(float)))
    rows = [rows[i] for i in draw.permutation(len(rows))]
    bounds = np.cumsum([0, *(len(t) for t, _ in rows)])
    return ball_tree.Sparse(bounds, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]))


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(2)
    vectors = clustered(draw, 40, 100, 500)
    root = ball_tree.tree(vectors, 500)
    for _ in range(20):
        query = np.zeros(500)
        query[draw.choice(500, 15, replace=False)] = draw.integers(1, 1000, 15)
        exact = vectors.dot(query)
        nodes = [root]
        while nodes:
            at = nodes.pop()
            assert exact[at.rows].max() <= at.bound(query)
            assert not at.children or sorted(np.concatenate([c.rows for c in at.children])) == sorted(at.rows)
            nodes += at.children
        top, seen = [], []

        def visit(rows):
            seen.extend(rows.tolist())
            top[:] = sorted([*top, *exact[rows]], reverse=True)[:10]

        visited = ball_tree.search(root, query, lambda: top[-1] if len(top) == 10 else 0, visit)
        assert visited == len(seen) and [t for t in top if t > 0] == [t for t in sorted(exact, reverse=True)[:10] if t > 0]
    term, value = vectors.row(0)
    query[:] = 0
    query[term] = value
    top.clear()
    assert ball_tree.search(root, query, lambda: top[-1] if len(top) == 10 else 0, visit) < len(vectors) // 4


def test_equal_rows_make_a_shallow_tree():
    one = np.arange(5)
    vectors = ball_tree.Sparse(np.arange(0, 5 * 4001, 5), np.tile(one, 4000), np.tile(one + 1.0, 4000))
    depth, nodes = 0, [ball_tree.tree(vectors, 5)]
    while nodes:
        nodes, depth = [c for n in nodes for c in n.children], depth + 1
    assert depth < 10


def test_impacts_stay_integers():
    got = lexical_search.impacts(np.array([1, 3]), np.array([10, 10**6]), 10**9, 10**12)
    assert got.tolist() == [10**9 // (1000 + 8 * (25 + 75 * 10 * 10**9 // 10**12)), 3 * 10**9 // (3000 + 8 * (25 + 75 * 10**6 * 10**9 // 10**12))]
