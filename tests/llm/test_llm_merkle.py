"""Merkle manifest."""

import hashlib
import zlib

import numpy as np
import pytest

from twinframe.llm import merkle, merkle_queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows):
    """One output row for each of (doc_id, source, lang, n_chars, text), in the order of the leaves."""
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    parts = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups]
    trees = [levels_of([leaf(r) for r in part]) for part in parts]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for g, (part, tree) in enumerate(zip(parts, trees)):
        for i, row in enumerate(part):
            hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            own, proof = leaf((*row[:3], row[3] + 1, row[4])) if hit else leaf(row), []
            for levels, at in ((tree, i), (top, g)):
                for level in levels[:-1]:
                    pair = level[at - at % 2 : at - at % 2 + 2]
                    proof += [x for k, x in enumerate(pair) if k != at % 2]
                    pair[at % 2] = own
                    own, at = digest("".join(pair)), at // 2
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0], digest("".join(proof)), own, own == top[-1][0]))
    return out


def through_spark(spark, rows, folder):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = merkle_queries.op11_merkle_manifest(spark, str(folder))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("levels", range(1, 15))
def test_addresses_are_a_permutation(levels):
    places = np.concatenate([merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)])
    assert places[0] == 0 and sorted(places.tolist()) == list(range((1 << levels) - 1))


def test_layout_keeps_subtrees_together():
    """The upper half of the levels comes first, then each lower subtree as one stretch, laid out alike."""
    upper, lower = 3, 4
    for s in range(1 << upper):
        stretch = np.concatenate([merkle.address(7, upper + d, (s << d) + np.arange(1 << d)) for d in range(lower)])
        assert sorted(stretch.tolist()) == list(range((1 << upper) - 1 + 15 * s, (1 << upper) - 1 + 15 * (s + 1)))
        alike = np.concatenate([merkle.address(lower, d, np.arange(1 << d)) for d in range(lower)])
        assert (stretch - stretch.min() == alike).all()


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_against_a_plain_version(spark, monkeypatch, tmp_path, height):
    """Groups of 1 to 41 leaves, so blocks recurse over several layers; null, empty and repeated values and ids."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    sizes = {None: 3, "": 1, "de": 2, "en": 41, "é": 5, "fr": 8, "zz": 9}
    rows = [(100 * g + i, "s", lang, i, f"text {i}") for g, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(7, None, "en", None, None), (7, "", "en", 0, ""), (7, "", "en", 0, ""), (None, "s", "en", 4, "no id"), (9, "s", "de", 9, "é😀 " * 50_000)]
    assert through_spark(spark, rows, tmp_path) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, "s", None, 3, "abc")], [(1, "s", "en", 3, "abc")] * 3])
def test_small_manifests(spark, tmp_path, rows):
    assert through_spark(spark, rows, tmp_path) == sorted(plain(rows), key=str)


def test_stored_blocks_hold_the_tree(spark, edges, monkeypatch):
    """Extra columns of clashing names are left alone, and the stored nodes are those of the plain tree."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = edges.withColumns({"leaf": merkle.leaf_digest([F.col("doc_id"), F.col("text")]), "changed": F.lit(None).cast("string"), "tree": F.lit("x"), "pos": F.lit(1)})
    made = merkle.manifest(rows, "doc_id", "lang", "leaf", "changed")
    leaves = [r.digest.hex() for r in made.leaves.orderBy("pos").collect()]
    wanted = levels_of(leaves)
    assert made.root == wanted[-1][0]
    for r in made.groups[0].collect():
        nodes = np.frombuffer(r.nodes, np.uint8).reshape(-1, 32)
        for depth, width in enumerate(merkle.widths(r.leaves, 2)):
            at = merkle.address(3, depth, np.arange(width))
            assert [nodes[a].tobytes().hex() for a in at] == wanted[2 - depth][(r.block << depth) : (r.block << depth) + width]
    assert merkle.proofs(made).where("verified").count() == edges.count()
