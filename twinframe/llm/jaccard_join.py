"""Similarity join of texts on the Jaccard similarity of their word shingles.

Words are runs without white space, lower-cased and without the punctuation around them; a shingle is five words in a row
(all words of a text with fewer). Texts with equal shingle sets form a class, of which one is compared.

1. MinHash values are made in the tasks that read the texts; only band keys leave them.
2. Classes that share a band key are connected to the least class of that key. The connected components of these few
   edges hold all candidate pairs, whatever the size of a bucket.
3. Texts of a component meet in blocks of bounded size, every pair of blocks in a group of its own. There MinHash values
   are compared step by step, and a pair is dropped as soon as the posterior probability that its similarity reaches the
   threshold falls below a tolerance. Surviving pairs are verified on the exact shingle sets.
4. A group returns one row per text: its number of links and the least class linked with it, so pairs are never rows.

A pair at the threshold escapes all bands with probability (1 - t^ROWS)^BANDS, some 7 in a million, and pruning adds at
most STEPS times the tolerance. Null texts and texts without words are linked with nothing and are classes of their own.
Repeated rows are copies. Of the input only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.arrow_text import Powers, Texts, letter_bytes, lower_bytes, mixed, texts_of, word_bytes
from twinframe.llm.components import components
from twinframe.session import stage

WIDTH = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 30
STEP = 30
TOLERANCE = 1e-6
#: Texts of a component that meet in one group: two blocks at most.
BLOCK = 256
#: Small components are dealt into this many groups for each group of ``BLOCK`` texts they would fill.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ROW = "__row"


def multipliers(n: int = ROWS * BANDS) -> np.ndarray:
    """Odd factors: each makes another order of the 64-bit hashes."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


class Shingles:
    """Distinct shingle hashes of texts, text after text, with the places where each text's begin."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.powers = Powers()
        self.lower, self.letters, self.in_word = lower_bytes(), letter_bytes(), word_bytes()

    def words(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each word, without the punctuation around it (words of punctuation alone stay)."""
        start, end = texts.runs(self.in_word[texts.data])
        at = np.append(np.flatnonzero(self.letters[texts.data]), len(texts.data))
        first = np.searchsorted(at, start)
        last = np.searchsorted(at, end) - 1
        bare = last >= first
        low = np.where(bare, at[np.minimum(first, len(at) - 1)], start)
        high = np.where(bare, at[np.maximum(last, 0)] + 1, end)
        sums = texts.prefix_hash(self.powers, self.lower)
        return texts.text_of(start), texts.span_hash(sums, low, high, self.powers)

    def sets(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in rising order inside each text, and bounds (one more entry than texts)."""
        of, word = self.words(texts)
        n = len(texts)
        counts = np.bincount(of, minlength=n)
        wide = np.minimum(counts, self.width)[of]  # short texts have one shingle of all their words
        place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.flatnonzero(place + wide <= counts[of])
        value = np.full(len(starts), _GOLDEN, dtype=np.uint64)
        for k in range(self.width):
            inside = wide[starts] > k
            value[inside] = mixed(value[inside] * _GOLDEN + word[starts[inside] + k])
        of = of[starts]
        order = np.lexsort((value, of))
        of, value = of[order], value[order]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        return value[new], np.searchsorted(of[new], np.arange(n + 1))


def minhashes(values: np.ndarray, bounds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each non-empty set."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), len(factors)), dtype=np.uint32)
    for k, factor in enumerate(factors):
        out[:, k] = np.minimum.reduceat((values * factor) >> np.uint64(32), starts) if len(starts) else 0
    return out


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each non-empty set, from sums that do not depend on order."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    salts = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
    sums = [np.add.reduceat(mixed(values ^ s), starts) if len(starts) else np.zeros(0, np.uint64) for s in salts]
    return np.stack(sums, axis=1).view(np.int64)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.empty((len(signatures), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(signatures), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mixed(key * _GOLDEN + signatures[:, b * ROWS + r])
        keys[:, b] = key
    return keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, set keys and band keys of every text; nulls for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, factors = Shingles(), multipliers()
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                values, bounds = shingles.sets(texts)
                full = np.diff(bounds) > 0
                at = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
                keys = set_keys(values, bounds)
                bands = band_keys(minhashes(values, bounds, factors))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
                columns = [pa.array(keys[:, 0]).take(at), pa.array(keys[:, 1]).take(at), lists.take(at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), *columns], names=names)

    names = ["id", "key_a", "key_b", "bands"]
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema[0].dataType.simpleString()}, key_a long, key_b long, bands array<long>")


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of ``n`` equal MinHash values with which the similarity still reaches the threshold with a posterior
    probability of ``tolerance``, from a uniform prior: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def candidates(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of ``left`` and ``right``) that Bayesian pruning keeps; ``same``: both are one block, pairs count once."""
    found = []
    need = least_matches(STEP)
    rows = max(1, (1 << 22) // max(1, len(right) * STEP))
    for begin in range(0, len(left), rows):
        part = left[begin : begin + rows, None, :STEP] == right[None, :, :STEP]
        i, j = np.nonzero(part.sum(2) >= need)
        found.append((i + begin, j))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    if same:
        i, j = i[i < j], j[i < j]
    for n in range(2 * STEP, left.shape[1] + 1, STEP):
        need = least_matches(n)
        keep = np.zeros(len(i), dtype=bool)
        for begin in range(0, len(i), 1 << 15):
            a, b = i[begin : begin + (1 << 15)], j[begin : begin + (1 << 15)]
            keep[begin : begin + (1 << 15)] = (left[a, :n] == right[b, :n]).sum(1) >= need
        i, j = i[keep], j[keep]
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sets have an exact Jaccard similarity of ``threshold`` or more."""
    if not len(i):
        return np.zeros(0, dtype=bool)
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())])
    else:  # many pairs: products of 0/1 rows over the shingles, some thousand shingles at a time
        names, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for begin in range(0, len(names), 4096):
            a, b = np.searchsorted(column, (begin, begin + 4096))
            part = np.zeros((len(sets), min(4096, len(names) - begin)), dtype=np.float32)
            part[row[a:b], column[a:b] - begin] = 1
            total += part @ part.T
        shared = total[i, j].astype(np.int64)
    return shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least number connected with each of ``n`` numbers."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def links_in_block(node: np.ndarray, block: np.ndarray, pair: tuple[int, int], texts: pa.Array, expected: np.ndarray):
    """Node, links and least linked node of the texts of one pair of blocks. ``expected`` has each node's set keys, as a
    text of another row with the same id may have come along."""
    shingles, factors = Shingles(), multipliers()
    sets, signatures, keep = [], [], []
    for part in texts_of(texts):
        values, bounds = shingles.sets(part)
        keys = set_keys(values, bounds)
        of = np.flatnonzero(np.diff(bounds) > 0)
        right = (keys == expected[part.first + of]).all(1)
        signatures.append(minhashes(values, bounds, factors)[right])
        sets += [values[bounds[k] : bounds[k + 1]] for k in of[right]]
        keep.append(part.first + of[right])
    at = np.concatenate(keep) if keep else np.zeros(0, int)
    if not len(at):
        return np.zeros((0, 3), dtype=np.int64)
    _, once = np.unique(node[at], return_index=True)  # repeated rows; also puts nodes in rising order
    node, block = node[at][once], block[at][once]
    signature, sets = np.concatenate(signatures)[once], [sets[k] for k in once]
    a, b = pair
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    i, j = candidates(signature[left], signature[right], a == b)
    i, j = left[i], right[j]
    good = verified(sets, i, j)
    i, j = i[good], j[good]
    links = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
    linked = links > 0
    return np.stack([node, links, node[roots(len(node), i, j)]], axis=1)[linked]


def block_links(groups: DataFrame) -> DataFrame:
    """``node``, ``links``, ``root`` from groups of texts; one row for each linked text of a group."""

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).combine_chunks() for c in table.schema.names}
        number = {c: columns[c].to_numpy(zero_copy_only=False) for c in ("component", "a", "b", "node", "block", "key_a", "key_b")}
        expected = np.stack([number["key_a"], number["key_b"]], axis=1)
        order = np.argsort(number["component"], kind="stable")
        cuts = np.flatnonzero(np.diff(number["component"][order])) + 1
        found = []
        for rows in np.split(order, cuts):
            pair = int(number["a"][rows[0]]), int(number["b"][rows[0]])
            found.append(links_in_block(number["node"][rows], number["block"][rows], pair, columns["text"].take(pa.array(rows)), expected[rows]))
        all_found = np.concatenate(found)
        return pa.table({"node": all_found[:, 0], "links": all_found[:, 1], "root": all_found[:, 2]})

    return groups.groupBy("unit", "a", "b").applyInArrow(run, "node long, links long, root long")


def linked_classes(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame) -> DataFrame:
    """``node``, ``links`` and ``component`` of every class with a link."""
    exploded = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = exploded.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last")
    grouped = components(_joined(exploded.join(buckets, "bucket").select("node", "center")))
    sizes = grouped.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    small = F.col("blocks") == 1
    members = (
        grouped.join(sizes, "component")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        # components of one block share groups, others have a group for each pair of blocks
        .withColumn("unit", F.when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(units(grouped)))).otherwise(F.col("component")))
    )
    known = members.join(classes.select("node", "id", "key_a", "key_b"), "node")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(known, texts["id"].eqNullSafe(known["id"])).drop("id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    groups = met.withColumn("other", other).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    found = stage(block_links(groups.select("unit", "a", "b", "component", "node", "block", "key_a", "key_b", "text")), "found")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    return totals.join(final, "node")


def _joined(memberships: DataFrame) -> DataFrame:
    """Edges with the same components as those between every node and its centers: one from each node to the least of its
    centers, and one from that to each of the others, which the nodes of a group share."""
    centers = memberships.groupBy("node").agg(F.collect_set("center").alias("centers"))  # at most BANDS
    least = F.array_min("centers")
    ends = centers.select(least.alias("a"), F.explode(F.array_append("centers", F.col("node"))).alias("b"))
    return ends.where("a <> b").distinct()


def units(grouped: DataFrame) -> int:
    """Groups for small components: about ``BLOCK`` texts each."""
    return max(1, -(-grouped.count() // BLOCK))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (least id of the texts linked with it, directly or over others),
    ``copy_id`` (least id of those with the same shingles), ``n_copies`` and ``n_links`` (different texts that reach the
    threshold with it; all copies of a text count as one)."""
    rows = stage(sketches(docs, id_col, text_col), "sketches")
    by_key = rows.where(F.col("key_a").isNotNull()).groupBy("key_a", "key_b")
    classes = stage(
        by_key.agg(F.min("id").alias("id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")).withColumn(
            "node", F.monotonically_increasing_id()
        ),
        "classes",
    )
    linked = stage(linked_classes(docs, id_col, text_col, classes.select("node", "id", "key_a", "key_b", "bands")), "linked")
    named = classes.select("node", "id", "key_a", "key_b", "n_copies").join(linked, "node", "left")
    component = F.coalesce("component", "node")
    least = named.groupBy(component.alias("component")).agg(F.min("id").alias("class_id"))
    final = named.withColumn("component", component).join(least, "component")
    verdicts = final.select("key_a", "key_b", F.col("id").alias("copy_id"), "class_id", "n_copies", F.coalesce("links", F.lit(0)).alias("n_links"))
    joined = rows.drop("bands").join(verdicts, ["key_a", "key_b"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("copy_id", "id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one of each class of similar texts: that with the least id (null first), of equal ids any one. Rows
    without words all stay. Classes are found by a key of the rows, so a null or repeated id does not bring different texts
    together, nor does it part similar ones."""
    keyed = stage(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    classes = similar_texts(keyed, _ROW, text_col).select(_ROW, "class_id")
    named = keyed.select(F.col(_ROW).alias("row"), F.col(id_col).alias("id")).join(classes, F.col("row") == F.col(_ROW))
    kept = named.groupBy("class_id").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return keyed.join(kept, F.col(_ROW) == F.col("row"), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
