"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.session import stage

#: Rounds that share one order of the nodes. Another order after that tells nodes apart whose hashes are equal.
SAME_ORDER = 4


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node connected with it) for every node of ``edges`` (``a``, ``b``: longs).

    Each round sends every node to the first of itself and its neighbours in a hashed order and replaces the ends of all
    edges by where they went, so a round works on what the one before has left: a star is one node after two rounds, and a
    long path loses about half its nodes in each. What is connected stays so. Only minima are aggregated, so a node with
    very many neighbours is combined before the shuffle. Rounds are written to the shared folder, which cuts the lineage;
    the driver sees one emptiness test a round. At the end the moves are followed back from the last round to the first.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = stage(edges.where("a <> b").select(*ends).distinct(), "links")
    moves: list[DataFrame] = []
    while not moves or not links.isEmpty():
        moves.append(stage(_moved(links, len(moves) // SAME_ORDER), "moves"))
        first, second = (moves[-1].select(F.col("node").alias(old), F.col("to").alias(new)) for old, new in (("a", "x"), ("b", "y")))
        met = links.join(first, "a").join(second, "b").where("x <> y")
        links = stage(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    final = None
    for move in reversed(moves[1:]):
        if final is None:
            final = move
        else:
            final = move.join(_renamed(final), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    # the places where nodes stand after the first round, a small part of all, carry the least node that went there
    places = moves[0].groupBy("to").agg(F.min("node").alias("least"))
    if final is None:
        named = places.withColumn("end", F.col("to"))
    else:
        named = places.join(_renamed(final), "to", "left").withColumn("end", F.coalesce("end", "to"))
    named = stage(named, "places")
    least = named.groupBy("end").agg(F.min("least").alias("component"))
    return stage(moves[0].join(named.join(least, "end").select("to", "component"), "to").select("node", "component"), "labels")


def _renamed(move: DataFrame) -> DataFrame:
    return move.select(F.col("node").alias("to"), F.col("to").alias("end"))


def _moved(links: DataFrame, salt: int) -> DataFrame:
    """``node`` and ``to``: the first of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    order = F.xxhash64(F.lit(salt), F.col("b"))
    near = both.groupBy("a").agg(F.min_by("b", order).alias("best"), F.min(order).alias("place"))
    return near.select(F.col("a").alias("node"), F.when(F.xxhash64(F.lit(salt), F.col("a")) <= F.col("place"), F.col("a")).otherwise(F.col("best")).alias("to"))
