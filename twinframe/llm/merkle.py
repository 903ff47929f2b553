"""A Merkle manifest of a table: one digest that fixes every row, and a proof for each row.

Rows are leaves. Those of a group (a null group too) ascend by id, and of the digests of each level every two neighbours
become one, the last alone if their number is odd; the last one left is the group's root. The groups' roots, in the order of
the groups, form a tree of the same kind above.

Every tree is stored in blocks: aligned subtrees of ``1 << HEIGHT`` leaves, one row each, whose nodes lie in van Emde Boas
order: the upper half of the levels first, then the subtrees below it one after the other, each laid out alike. So a walk
from leaf to root touches few stretches of the row whatever the size of a page. ``address`` finds any node by arithmetic
alone, for building as for looking up siblings, and the root of a block is its first node. Block roots are the leaves of the
next blocks, until one block is left: its root is the tree's.

A task builds or proves one block at a time, so it holds at most ``2 << HEIGHT`` nodes, however large a group is. Proofs go
down from the top: what lies above a block is one path of siblings, handed to the block below.

Rows of equal id are ordered by their leaf; equal rows are leaves each. Null ids come first and are fit for proofs like any
other. An empty table has no leaves, and its root is None. Nothing but the named columns is read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.sharding import numbered
from twinframe.session import stage

#: Levels below the root of a block: 4,096 leaves, 256 KB of digests.
HEIGHT = 12
#: The number of the tree above the groups' trees, which have the row number of their first leaf.
TOP = -1
BYTES = 32
_NONE, _LEFT, _RIGHT = range(3)
_PATH = "tree long, block long, path binary, subroot binary"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in UTF-8 bytes, a colon and itself; lower-case hex."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` (from the left) at ``depth`` lie in the layout of a complete tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, below = levels - upper, depth - upper
    subtree = index >> below
    return (1 << upper) - 1 + subtree * ((1 << lower) - 1) + address(lower, below, index & ((1 << below) - 1))


def height_of(size: int) -> int:
    """Levels below the root of a block in a tree of ``size`` leaves."""
    return min(HEIGHT, max(0, size - 1).bit_length())


def widths(leaves: int, height: int) -> list[int]:
    """Nodes at each depth of a block, root first."""
    return [-(-leaves >> (height - depth)) for depth in range(height + 1)]


def layout(leaves: np.ndarray, height: int) -> np.ndarray:
    """Nodes of a block in van Emde Boas order (zeros where there is none) from its leaves, a row of bytes each."""
    levels, width = height + 1, widths(len(leaves), height)
    nodes = np.zeros(((1 << levels) - 1, BYTES), dtype=np.uint8)
    nodes[address(levels, height, np.arange(len(leaves)))] = leaves
    for depth in range(height - 1, -1, -1):
        below = nodes[address(levels, depth + 1, np.arange(width[depth + 1]))].tobytes().hex().encode()
        run = 4 * BYTES  # two digests in hex
        made = b"".join(sha256(below[k : k + run]).digest() for k in range(0, len(below), run))
        nodes[address(levels, depth, np.arange(width[depth]))] = np.frombuffer(made, np.uint8).reshape(-1, BYTES)
    return nodes


def siblings(nodes: np.ndarray, height: int, leaves: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Side and digest of the sibling of each ancestor of the leaves ``at``, from the leaf upwards."""
    levels, width = height + 1, widths(leaves, height)
    sides = np.full((len(at), height), _NONE, dtype=np.uint8)
    found = np.zeros((len(at), height, BYTES), dtype=np.uint8)
    for step in range(height):
        depth = height - step
        other = (at >> step) ^ 1
        there = np.flatnonzero(other < width[depth])
        sides[there, step] = np.where(other[there] & 1, _RIGHT, _LEFT)
        found[there, step] = nodes[address(levels, depth, other[there])]
    return sides, found


def path_of(sides: np.ndarray, found: np.ndarray) -> list[bytes]:
    """Sides and siblings of each row as bytes: one of side and a digest for every level."""
    return [row.tobytes() for row in np.concatenate([sides[:, :, None], found], axis=2)]


def steps_of(path: bytes) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(path), BYTES + 1):
        yield path[k], path[k + 1 : k + 1 + BYTES]


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    own = digest.hex()
    for side, other in steps_of(path):
        both = own if side == _NONE else other.hex() + own if side == _LEFT else own + other.hex()
        own = sha256(both.encode()).hexdigest()
    return bytes.fromhex(own)


def proof_digest(path: bytes) -> str:
    return sha256("".join(other.hex() for side, other in steps_of(path) if side != _NONE).encode()).hexdigest()


def rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Digests of a binary column, a row of bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BYTES)


def blocks(nodes: DataFrame) -> DataFrame:
    """``tree``, ``block``, ``size`` (leaves of the tree), ``leaves`` (of the block) and ``nodes`` from rows of ``tree``,
    ``pos``, ``size`` and ``digest``."""

    def build(table: pa.Table) -> pa.Table:
        pos = table.column("pos").to_numpy()
        size = table.column("size")[0].as_py()
        leaves = rows_of(table.column("digest"))[np.argsort(pos)]
        made = layout(leaves, height_of(size)).tobytes()
        return pa.table(
            {
                "tree": table.column("tree").slice(0, 1),
                "block": pa.array([int(pos[0]) >> HEIGHT], pa.int64()),
                "size": pa.array([size], pa.int64()),
                "leaves": pa.array([len(pos)], pa.int32()),
                "nodes": pa.array([made], pa.binary()),
            }
        )

    rows = nodes.select("tree", "pos", "size", "digest", F.shiftright("pos", HEIGHT).alias("block"))
    return rows.groupBy("tree", "block").applyInArrow(build, "tree long, block long, size long, leaves int, nodes binary")


def tree_blocks(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Blocks of each layer from the leaves up; ``most``: leaves of the largest tree."""
    layers = []
    while True:
        layers.append(stage(blocks(nodes), "merkle-blocks"))
        if most <= 1 << HEIGHT:
            return layers
        upper = layers[-1].where(F.col("size") > 1 << HEIGHT)
        nodes = upper.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / (1 << HEIGHT)).cast("long").alias("size"), root_of("nodes").alias("digest")
        )
        most = -(-most // (1 << HEIGHT))


def root_of(nodes: str) -> Column:
    return F.substring(nodes, 1, BYTES)


def below(parents: DataFrame, children: DataFrame, found, schema: str) -> DataFrame:
    """``found(block, rows)`` for every block of ``parents`` (with ``path``) and the ``children`` that are its leaves."""

    def meet(rows: pa.Table, block: pa.Table) -> pa.Table:
        return found({name: block.column(name)[0].as_py() for name in block.schema.names}, rows)

    rows = children.withColumn("parent", F.shiftright("pos", HEIGHT))
    return rows.groupBy("parent_tree", "parent").cogroup(parents.groupBy("tree", "block")).applyInArrow(meet, schema)


def paths_below(parents: DataFrame, children: DataFrame) -> DataFrame:
    """``tree``, ``block``, ``path`` and ``subroot`` of blocks (``tree``, ``block``, ``root``) that are leaves ``pos`` of the
    tree ``parent_tree``. Under the top tree a block's root is its group's root; others have that of their parent."""

    def found(block: dict, rows: pa.Table) -> pa.Table:
        at = rows.column("pos").to_numpy() & ((1 << HEIGHT) - 1)
        nodes = np.frombuffer(block["nodes"], dtype=np.uint8).reshape(-1, BYTES)
        paths = [p + block["path"] for p in path_of(*siblings(nodes, height_of(block["size"]), block["leaves"], at))]
        own = rows.column("root") if block["subroot"] is None else pa.array([block["subroot"]] * len(at), pa.binary())
        return pa.table({"tree": rows.column("tree"), "block": rows.column("block"), "path": pa.array(paths, pa.binary()), "subroot": own})

    return below(parents, children, found, _PATH)


@dataclass
class Manifest:
    """The stored trees: ``leaves`` (``id``, ``tree``, ``pos``, ``size``, ``digest``, ``changed``), the blocks of the groups'
    trees and of the top tree by layer, the groups' roots by place, and the root in hex."""

    leaves: DataFrame
    groups: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``tree`` (row number of the group's first leaf), ``pos`` in it and ``size`` of it.

    A group's facts are joined by stretches of row numbers, so a group with very many rows is spread over many keys.
    """
    listed = stage(numbered(rows, [F.col(c) for c in ("group", "id", "digest")], "number"), "leaves")
    groups = listed.groupBy("group").agg(F.min("number").alias("tree"), F.count("*").alias("size"))
    last = F.col("tree") + F.col("size") - 1
    stretches = groups.withColumn("stretch", F.explode(F.sequence(F.shiftright("tree", HEIGHT), F.shiftright(last, HEIGHT))))
    here = stretches.withColumnRenamed("group", "name")
    same = (F.shiftright(listed["number"], HEIGHT) == here["stretch"]) & listed["group"].eqNullSafe(here["name"])
    return listed.join(here, same).select("id", "tree", (F.col("number") - F.col("tree")).alias("pos"), "size", "digest", "changed")


def manifest(rows: DataFrame, id_col: str, group_col: str, digest_col: str, changed_col: str) -> Manifest:
    """The trees over ``digest_col`` (hex). ``changed_col``: the leaf (hex) that a row shows instead when it is proved, or null."""
    picked = rows.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.unhex(digest_col).alias("digest"), F.unhex(changed_col).alias("changed")
    )
    leaves = stage(placed(picked), "leaves")
    most = leaves.agg(F.max("size").alias("n")).first().n or 0
    groups = tree_blocks(leaves.select("tree", "pos", "size", "digest"), most)
    ends = [b.where(F.col("size") <= 1 << HEIGHT).select("tree", root_of("nodes").alias("digest")) for b in groups]
    united = ends[0]
    for end in ends[1:]:
        united = united.union(end)
    subroots = stage(numbered(united, [F.col("tree")], "pos"), "subroots")
    n = subroots.count()
    top = tree_blocks(subroots.select(F.lit(TOP).cast("long").alias("tree"), "pos", F.lit(n).cast("long").alias("size"), "digest"), n)
    root = top[-1].select(F.lower(F.hex(root_of("nodes"))).alias("root")).first()
    return Manifest(leaves, groups, top, subroots, root.root if root else None)


def proofs(made: Manifest) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (digest of all siblings up to the root), ``folded_root`` (from
    the changed leaf, if there is one, and the siblings) and ``verified`` (it is the root)."""
    top_end = len(made.top) - 1
    empty = F.lit(None).cast("binary")
    known = made.top[top_end].select("*", F.lit(b"").alias("path"), empty.alias("subroot"))
    for k in range(top_end, 0, -1):
        lower = made.top[k - 1]
        children = lower.select("tree", "block", root_of("nodes").alias("root"), F.col("block").alias("pos"), F.col("tree").alias("parent_tree"))
        paths = paths_below(known, children).withColumn("subroot", empty)
        known = stage(lower.join(paths, ["tree", "block"]), "merkle-paths")
    tops = made.subroots.select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("root"), "pos", F.lit(TOP).cast("long").alias("parent_tree"))
    ends = stage(paths_below(known, tops), "merkle-paths")
    for k in range(len(made.groups) - 1, -1, -1):
        layer = made.groups[k]
        last = layer.where(F.col("size") <= 1 << HEIGHT).select("tree", "block")
        paths = ends.join(last, ["tree", "block"], "left_semi").select("tree", "block", "path", "subroot")
        if k < len(made.groups) - 1:
            inner = layer.where(F.col("size") > 1 << HEIGHT)
            children = inner.select("tree", "block", root_of("nodes").alias("root"), F.col("block").alias("pos"), F.col("tree").alias("parent_tree"))
            paths = paths.union(paths_below(known, children))
        known = stage(layer.join(paths, ["tree", "block"]), "merkle-paths")
    return _leaf_proofs(known, made)


def _leaf_proofs(known: DataFrame, made: Manifest) -> DataFrame:
    root = made.root

    def found(block: dict, rows: pa.Table) -> pa.Table:
        at = rows.column("pos").to_numpy() & ((1 << HEIGHT) - 1)
        nodes = np.frombuffer(block["nodes"], dtype=np.uint8).reshape(-1, BYTES)
        sides, others = siblings(nodes, height_of(block["size"]), block["leaves"], at)
        leaves, shown = rows.column("digest").to_pylist(), rows.column("changed").to_pylist()
        paths = [p + block["path"] for p in path_of(sides, others)]
        ends = [folded(changed or leaf, path).hex() for leaf, changed, path in zip(leaves, shown, paths)]
        n = len(at)
        return pa.table(
            {
                "id": rows.column("id"),
                "leaf": pa.array([leaf.hex() for leaf in leaves], pa.string()),
                "subroot": pa.array([block["subroot"].hex()] * n, pa.string()),
                "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array([proof_digest(p) for p in paths], pa.string()),
                "folded_root": pa.array(ends, pa.string()),
                "verified": pa.array([e == root for e in ends], pa.bool_()),
            }
        )

    leaves = made.leaves.select("id", "pos", "digest", "changed", F.col("tree").alias("parent_tree"))
    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return below(known, leaves, found, schema)
