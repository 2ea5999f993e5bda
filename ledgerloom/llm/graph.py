"""Connected components of a table of links, as a few Spark jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

ROUNDS_BY_ID = 2


def _first_of(turn: int) -> Column:
    """Of ``a`` and its neighbours ``b``: the smallest id in the first rounds, then the smallest hash, another one each round."""
    if turn < ROUNDS_BY_ID:
        return F.least(F.min("b"), F.first("a"))
    ranked = lambda node: F.struct(F.xxhash64(F.col(node).cast("long"), F.lit(turn)).alias("rank"), F.col(node).alias("to"))
    return F.least(F.min(ranked("b")), F.first(ranked("a")))["to"]


def contract(edges: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Contraction of ``edges(a, b)`` until no edge is left: one table ``(node, to)`` per round.

    In a round each node moves to the first, by rank, of itself and its neighbours; edges are renamed, repeated ones
    dropped.  Two rounds go by id, which ends stars around small ids at once.  After that the ranks are hashes drawn
    anew each round, so the order of the ids along a chain does not matter: half the nodes of a chain stay in a
    round (a node stays if it is first in one of three overlapping windows of three), fewer of a star or a denser
    part.  The number of rounds grows with the logarithm of the longest chain.  Hub nodes cost no more than others:
    the choice is made before the shuffle, and the renaming joins read two plain tables, which adaptive execution
    can split.
    """
    edges = scratch.cut(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    moved: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(moved)
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(_first_of(turn).alias("to")), "step")
        moved.append(step)
        renamed = (
            edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        old, edges = edges, scratch.cut(renamed, "edges")
        scratch.drop(old)
    scratch.drop(edges)
    return moved


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; the component is its smallest node.

    Links of a node with itself are ignored; repeated links and either direction count once.  No links, no rows.
    """
    kinds = edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    moved = contract(edges, scratch)
    if not moved:
        return scratch.cut(kinds.filter(F.lit(False)), "ends")
    # From the last round back: where each round's nodes ended up.
    ends = moved[-1].select("node", F.col("to").alias("component"))
    for step in reversed(moved[:-1]):
        ends = scratch.cut(
            step.join(ends.select(F.col("node").alias("to"), "component"), "to", "left").select(
                "node", F.coalesce("component", "to").alias("component")
            ),
            "ends",
        )
    least = ends.groupBy("component").agg(F.min("node").alias("least"))
    return scratch.cut(ends.join(least, "component").select("node", F.col("least").alias("component")), "ends")
