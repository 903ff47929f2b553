"""Ranked lexical search: the best documents for each query text by integer term scores, exactly.

Terms are runs of characters other than ASCII signs, white space and controls, A-Z lower-cased. A document's score is the
inner product of the query's term counts with the document's vector

    w * ((10**9 tf) div (1000 tf + 8 m)),  w = floor(1000 ln((2N + 2) / (2 df + 1))),  m = 25 + (75 n N) div L

1. Tasks that read the texts keep, of each document, its length and its counts of the queries' terms (no other term can
   score). These vectors are written once; N, L and document frequencies are sums over them.
2. Tasks that read the vectors put every ``TREE`` documents into a ball tree, in a metric that weights a term by the root of
   w, and search it best-first for each query. Leaves are scored in 64-bit integers. Each task hands on its best ``k`` for
   each query, so what is shuffled does not grow with the documents of a task.
3. The best of all tasks are ranked by score, equal scores by ascending id (null ids last).

Queries are taken in blocks of at most ``BLOCK_TERMS`` terms (one query alone may have more), so what every task holds is
bounded; each block reads the texts again. Terms are told apart by 64-bit hashes of their bytes. Null and empty texts have no
terms and are never found; a query without terms finds nothing. Repeated rows are found each, with one id. Each query row is
searched by itself, whatever its id. Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from twinframe.llm import ball_tree
from twinframe.llm.arrow_text import Powers, letter_bytes, texts_of
from twinframe.session import stage

K = 10
#: Documents of one tree, and distinct terms of one block of queries.
TREE, BLOCK_TERMS = 16_384, 65_536


def term_counts(rows: DataFrame, key_col: str, text_col: str, vocabulary: np.ndarray | None = None) -> DataFrame:
    """``key``, ``n`` (terms with repeats), ``terms`` and ``times`` of every text: all terms by hash, or those of a sorted
    ``vocabulary`` by their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, member = Powers(), letter_bytes()
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                words = texts.words(powers, lower=True, member=member)
                n = np.bincount(words.text, minlength=len(texts)).astype(np.int64)
                of, term = words.text, words.hash
                if vocabulary is not None:
                    at = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
                    known = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
                    of, term = of[known], at[known]
                order = np.lexsort((term, of))
                of, term = of[order], term[order]
                new = np.ones(len(of), dtype=bool)
                new[1:] = (of[1:] != of[:-1]) | (term[1:] != term[:-1])
                first = np.flatnonzero(new)
                cuts = pa.array(np.searchsorted(of[first], np.arange(len(texts) + 1)).astype(np.int32))
                times = np.diff(np.append(first, len(of)))
                kind = np.int32 if vocabulary is not None else np.int64
                terms = term[first].astype(kind) if vocabulary is not None else term[first].view(kind)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (terms, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(n), *lists], names=names)

    names = ["key", "n", "terms", "times"]
    picked = rows.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = "long" if vocabulary is None else "int"
    return picked.mapInArrow(run, f"key {picked.schema[0].dataType.simpleString()}, n long, terms array<{kind}>, times array<int>")


def weights(documents: int, frequencies: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * frequencies + 1))).astype(np.int64)


def impacts(times: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of a document's score, before its weight."""
    slow = 25 + (75 * length * documents) // total
    return (1_000_000_000 * times) // (1000 * times + 8 * slow)


class Best:
    """The best ``k`` documents of one query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, []

    def least(self) -> int:
        """A document needs this score to get in."""
        return self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        good = np.flatnonzero(scores >= self.least())
        if len(good):
            new = zip(scores[good].tolist(), keys.take(pa.array(good)).to_pylist())
            self.found = sorted([*self.found, *new], key=lambda f: (-f[0], f[1] is None, f[1]))[: self.k]


def best_of(vectors: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """``query``, ``key`` and ``score``: each task's best documents for each query (number, term places, repeats)."""
    root_weight = np.sqrt(weight.astype(np.float64))

    def searched(keys: pa.Array, length: np.ndarray, part: ball_tree.Sparse, best: list[Best]) -> None:
        times, sizes = part.values, np.diff(part.bounds)
        impact = impacts(times, np.repeat(length, sizes), documents, total)
        exact = ball_tree.Sparse(part.bounds, part.terms, impact * weight[part.terms])
        root = ball_tree.tree(ball_tree.Sparse(part.bounds, part.terms, impact * root_weight[part.terms]), len(weight))
        query, repeats = np.zeros(len(weight)), np.zeros(len(weight), dtype=np.int64)
        leaves: dict[int, tuple[ball_tree.Sparse, pa.Array]] = {}  # by first row
        for (_, terms, counts), top in zip(queries, best):
            query[terms], repeats[terms] = counts * root_weight[terms], counts

            def visit(rows: np.ndarray, top: Best = top) -> None:
                first = int(rows[0])
                if first not in leaves:
                    leaves[first] = exact.rows(rows), keys.take(pa.array(rows))
                part, own = leaves[first]
                top.add(part.dot(repeats), own)

            ball_tree.search(root, query, top.least, visit)
            query[terms], repeats[terms] = 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for batch in batches:
            terms, times = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            bounds = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            scoring = weight[terms] > 0  # a term of weight 0 adds nothing
            kept = np.concatenate([[0], np.cumsum(scoring)])[bounds]
            full = np.flatnonzero(np.diff(kept))
            part = ball_tree.Sparse(np.append(kept[full], kept[-1]), terms[scoring].astype(np.int64), times[scoring].astype(np.int64))
            for begin in range(0, len(full), TREE):
                which = np.arange(begin, min(begin + TREE, len(full)))
                rows = pa.array(full[which])
                searched(batch.column(0).take(rows), batch.column(1).take(rows).to_numpy(), part.rows(which), best)
        found = [(number, key, score) for (number, _, _), top in zip(queries, best) for score, key in top.found]
        numbers, keys, scores = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(keys, kind), pa.array(scores, pa.int64())], names=["query", "key", "score"])

    kind = to_arrow_type(vectors.schema["key"].dataType)
    return vectors.mapInArrow(run, f"query long, key {vectors.schema['key'].dataType.simpleString()}, score long")


def query_blocks(queries: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Queries with a number, and their terms with the number of the block that each query is searched in."""
    listed = stage(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    counted = stage(term_counts(listed, "query", text_col), "query-terms")
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # numbers alone: a row for each query
    ranges = counted.select("key", F.size("terms").alias("size"))
    block = F.floor((F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") - 1) / BLOCK_TERMS)
    return listed, counted.join(ranges.where("size > 0").select("key", block.alias("block")), "key")


def search(
    docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text"
) -> DataFrame:
    """``query_id_col``, ``rank`` (from 1), ``id_col`` and ``score`` of the best ``k`` documents of each query."""
    listed, counted = query_blocks(queries.select(query_id_col, query_text_col), query_text_col)
    counted = stage(counted, "query-blocks")
    parts = []
    for r in counted.select("block").distinct().orderBy("block").collect():
        rows = counted.where(F.col("block") == r["block"]).collect()  # bounded by BLOCK_TERMS
        hashes = [np.array(x["terms"], dtype=np.int64).view(np.uint64) for x in rows]
        vocabulary = np.unique(np.concatenate(hashes))
        asked = [(x["key"], np.searchsorted(vocabulary, h), np.array(x["times"], dtype=np.int64)) for x, h in zip(rows, hashes)]
        vectors = stage(term_counts(docs, id_col, text_col, vocabulary), "vectors")
        total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
        frequencies = np.zeros(len(vocabulary), dtype=np.int64)
        for f in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            frequencies[f["term"]] = f["count"]
        parts.append(best_of(vectors, asked, weights(total.documents, frequencies), total.documents, total.terms or 0, k))
    if not parts:
        empty = docs.sparkSession.createDataFrame([], "query long, score long")
        parts = [empty.join(docs.limit(0).select(F.col(id_col).alias("key")), F.lit(False), "left").select("query", "key", "score")]
    found = reduce(DataFrame.union, parts)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return listed.select("query", query_id_col).join(ranked, "query").select(query_id_col, "rank", F.col("key").alias(id_col), "score")
