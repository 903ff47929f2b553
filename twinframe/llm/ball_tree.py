"""A ball tree over sparse non-negative vectors: largest inner products, found exactly.

A node holds the centroid of its rows and the radius of the ball around it that has them all. No row's inner product with a
query q can exceed  q . centroid + |q| radius, where q counts only on terms that some row below has. Nodes are visited by
falling bound, and a search ends when no bound reaches the k-th best score, so whole subtrees go unseen.

Bounds are floating-point numbers and scores are integers. Every computed radius and bound is raised by more than its
rounding error (``SLACK`` of the magnitudes that went into it), so a bound is never below the true one, and a node is
only left out if its bound is below the k-th score: rows of equal score are never lost.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Rows of a leaf, and splits after which halves are taken by order, so trees of any data stay shallow.
LEAF, DEEP = 128, 40
#: Times that the rows of a split are dealt to the nearer of the two parts' means.
MEANS = 3
#: Far above the rounding error of a sum of a million products, relative to the sum of their magnitudes.
SLACK = 1e-9


@dataclass
class Sparse:
    """Rows of term numbers and values, one after the other; no row is empty."""

    bounds: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.terms] * self.values, self.bounds[:-1])

    def rows(self, which: np.ndarray) -> Sparse:
        sizes = np.diff(self.bounds)[which]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(self.bounds[:-1][which], sizes)
        return Sparse(bounds, self.terms[at], self.values[at])

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[k], self.bounds[k + 1])
        return self.terms[part], self.values[part]


@dataclass
class Node:
    terms: np.ndarray
    centroid: np.ndarray
    radius: float
    rows: np.ndarray
    children: tuple[Node, ...] = ()

    def bound(self, query: np.ndarray) -> float:
        """No row below has a larger inner product with ``query``."""
        own = query[self.terms]
        return (float(own @ self.centroid) + float(np.sqrt(own @ own)) * self.radius) * (1 + SLACK)


def distances(part: Sparse, norms: np.ndarray, terms: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Upper bounds of the rows' distances from a point; ``dense`` is all zeros before and after."""
    dense[terms] = values
    square = float(values @ values)
    found = np.sqrt(np.maximum(norms - 2 * part.dot(dense) + square, 0) + SLACK * (norms + square))
    dense[terms] = 0
    return found


def tree(vectors: Sparse, width: int) -> Node:
    """The tree over all rows of ``vectors``, whose terms are below ``width``."""
    dense = np.zeros(width)
    all_norms = np.add.reduceat(vectors.values**2, vectors.bounds[:-1])

    def node(rows: np.ndarray, part: Sparse) -> Node:
        sums = np.bincount(part.terms, part.values, minlength=width)
        terms = np.flatnonzero(sums)
        values = sums[terms] / len(rows)
        return Node(terms, values, float(distances(part, all_norms[rows], terms, values, dense).max()) * (1 + SLACK), rows)

    def mean(part: Sparse, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.repeat(which, np.diff(part.bounds))
        sums = np.bincount(part.terms[inside], part.values[inside], minlength=width)
        terms = np.flatnonzero(sums)
        return terms, sums[terms] / which.sum()

    def halves(at: Node, part: Sparse, depth: int) -> np.ndarray:
        """Which rows belong to the first of two parts: nearer to one of two far rows, then to the parts' own means, which
        brings rows of like terms together that are as far from one of the two rows as from the other."""
        norms, by_order = all_norms[at.rows], np.arange(len(part)) < len(part) // 2
        if depth >= DEEP:
            return by_order
        first = part.row(int(distances(part, norms, at.terms, at.centroid, dense).argmax()))
        to_first = distances(part, norms, *first, dense)
        near = to_first < distances(part, norms, *part.row(int(to_first.argmax())), dense)
        for _ in range(MEANS):
            if not 0 < near.sum() < len(near):
                return by_order
            near = distances(part, norms, *mean(part, near), dense) < distances(part, norms, *mean(part, ~near), dense)
        return near if 0 < near.sum() < len(near) else by_order

    root = node(np.arange(len(vectors)), vectors)
    open_nodes = [(root, vectors, 0)]
    while open_nodes:
        at, part, depth = open_nodes.pop()
        if len(at.rows) <= LEAF:
            continue
        near = halves(at, part, depth)
        children = []
        for which in (np.flatnonzero(near), np.flatnonzero(~near)):
            own = part.rows(which)
            child = node(at.rows[which], own)
            children.append(child)
            open_nodes.append((child, own, depth + 1))
        at.children = tuple(children)
    return root


def search(root: Node, query: np.ndarray, least, visit) -> int:
    """Visits leaves by falling bound, as long as a bound reaches ``least()`` and is above zero; ``visit(rows)`` scores them
    and may raise ``least``. Returns the number of rows visited."""
    waiting, made, seen = [(-root.bound(query), 0, root)], 1, 0
    while waiting:
        bound, _, at = heapq.heappop(waiting)
        if -bound <= 0 or -bound < least():
            break
        if not at.children:
            visit(at.rows)
            seen += len(at.rows)
        for child in at.children:
            above = child.bound(query)
            if above > 0 and above >= least():
                heapq.heappush(waiting, (-above, made, child))
                made += 1
    return seen
