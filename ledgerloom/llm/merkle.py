"""Merkle manifest of a document table: a persistent tree whose versions copy one path each.

Leaves stand in one tree per language, the language roots in one tree above them.  A
tree is cut into aligned blocks of ``2 ** bits`` leaves; a block is one Spark group,
its root is a leaf of the next upper level, and so on until one node is left.  Every
block gets the siblings above it once, as a short list, and keeps its own nodes.

A tampered leaf makes a *version*: the nodes on its way up are copied, everything else
is shared.  Copies inside the block are made from the block's nodes; the version then
continues in the same task along the siblings above the block, so versions of one
block never meet those of another, however many hang below one upper node.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.quality import held_out
from ledgerloom.session import Scratch

BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, pos long, n long, digest string"


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a document row, with some of its fields given another value."""
    return F.sha2(F.concat(*[_field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and ``height`` levels above them; pairs are hashed together, a last single node alone."""
    out = [nodes]
    for _ in range(height):
        low = out[-1]
        out.append([digest(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def siblings(rows: list[list[str]], at: int) -> list[str]:
    """What stands beside the way up from leaf ``at``: "L" or "R" and the digest, or "" for nothing."""
    out = []
    for row in rows[:-1]:
        beside = at ^ 1
        out.append("" if beside >= len(row) else ("L" if beside < at else "R") + row[beside])
        at >>= 1
    return out


def path_copies(leaf: str, way: list[str]) -> list[str]:
    """The copied nodes of a version, leaf first, root last."""
    out = [leaf]
    for beside in way:
        side, other = beside[:1], beside[1:]
        out.append(digest(other, out[-1]) if side == "L" else digest(out[-1], other))
    return out


def _height(n: int, bits: int | None = None) -> int:
    """Levels above ``n`` nodes; inside a block at most ``bits``."""
    full = (n - 1).bit_length()
    return full if bits is None else min(full, bits)


def _sorted_columns(table: pa.Table, *names: str) -> list[list]:
    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    return [table.column(name).take(order).to_pylist() for name in names]


def _positions(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Add ``pos``, the place inside ``tree`` in ``order``, and ``n``, the size of the tree.

    A range-partitioned sort that is written once; one offset per (partition, tree).
    """
    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = scratch.cut(
        nodes.repartitionByRange(count, "tree", *order)
        .sortWithinPartitions("tree", *order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "sorted",
    )
    runs = written.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(
        "part", "tree", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")
    )
    return written.join(starts, ["part", "tree"]).withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """One node per aligned block, as a node of the next level."""

    def root(table: pa.Table) -> pa.Table:
        (leaves,) = _sorted_columns(table, "digest")
        tree, pos, n = (table.column(c)[0].as_py() for c in ("tree", "pos", "n"))
        top = levels(leaves, _height(n, bits))[-1][0]
        return pa.table(
            {"tree": [tree], "pos": pa.array([pos >> bits], pa.int64()), "n": pa.array([-(-n >> bits)], pa.int64()), "digest": [top]}
        )

    blocks = nodes.select("tree", "pos", "n", "digest", F.shiftright("pos", bits).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(root, _NODE)


def _block_ways(nodes: DataFrame, bits: int) -> DataFrame:
    """For each node, its siblings inside its block: ``(tree, pos, way)``."""

    def ways(table: pa.Table) -> pa.Table:
        leaves, pos = _sorted_columns(table, "digest", "pos")
        rows = levels(leaves, _height(table.column("n")[0].as_py(), bits))
        return pa.table(
            {
                "tree": pa.array([table.column("tree")[0].as_py()] * len(pos), pa.string()),
                "pos": pa.array(pos, pa.int64()),
                "way": pa.array([siblings(rows, i) for i in range(len(pos))], pa.list_(pa.string())),
            }
        )

    blocks = nodes.select("tree", "pos", "n", "digest", F.shiftright("pos", bits).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(ways, "tree string, pos long, way array<string>")


def _upper_tree(nodes: DataFrame, bits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All levels above ``nodes(tree, pos, n, digest)``: each node's way to its root, and the roots.

    A round takes ``bits`` levels, so a trillion leaves need four rounds of rapidly shrinking tables.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds: list[DataFrame] = []
    while largest > 1:
        rounds.append(scratch.cut(_block_ways(nodes, bits), "ways"))
        nodes = scratch.cut(_block_roots(nodes, bits), "nodes")
        largest = -(-largest >> bits)
    roots = nodes.select("tree", F.col("digest").alias("root"))
    if not rounds:
        return nodes.select("tree", "pos", F.array().cast("array<string>").alias("way")), roots

    def longer(upper: DataFrame, lower: DataFrame) -> DataFrame:
        above = upper.select("tree", F.col("pos").alias("block"), F.col("way").alias("rest"))
        return (
            lower.withColumn("block", F.shiftright("pos", bits))
            .join(above, ["tree", "block"])
            .select("tree", "pos", F.concat("way", "rest").alias("way"))
        )

    return reduce(longer, reversed(rounds)), roots


def merkle_manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    bits: int = BLOCK_BITS,
    with_versions: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: its leaf, the roots above it, its proof, and the root its version gets.

    ``tampered`` marks the rows that get a version with ``n_chars`` raised by one (by default those whose id's
    crc32 is divisible by 7).  ``folded_root`` is that version's root; for other rows it is folded from the untouched
    leaf.  ``with_versions`` adds ``copied``, the version's copied nodes from the leaf to the root (null without one).

    Null fields are written as ``-`` and differ from empty ones.  Rows without a language have their own tree, the
    first; rows without an id come first in theirs and are never tampered with.  Rows with one id stand in the order of
    their digests; identical rows are leaves of their own, one after the other.  A null ``n_chars`` stays null, so its
    version equals the original and verifies.  An empty table gives no rows.  Texts of any length are hashed whole.
    Further columns are ignored, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    tampered = held_out(parts=7, part=0) if tampered is None else F.coalesce(tampered, F.lit(False))
    raised = leaf_digest(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    leaves = scratch.cut(
        docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
            leaf_digest().alias("digest"),
            F.when(tampered, raised).alias("version"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "leaves",
    )
    placed = scratch.cut(_positions(leaves, ["doc_id", "digest", "tie"], scratch).drop("tie"), "placed")
    blocks = scratch.cut(_block_roots(placed, bits), "blocks")
    ways, subroots = _upper_tree(blocks, bits, scratch)
    # The language roots, in the order of the languages, are the leaves of one last tree.
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("digest"))
    tops = scratch.cut(_positions(tops, ["lang"], scratch), "languages")
    top_ways, top_root = _upper_tree(tops, bits, scratch)
    above = (
        tops.join(top_ways, ["tree", "pos"])
        .join(top_root, "tree")
        .select(F.col("lang").alias("tree"), F.col("digest").alias("subroot"), F.col("way").alias("last"), "root")
    )
    sides = ways.join(above, "tree").select(
        "tree", F.col("pos").alias("block"), F.concat("way", "last").alias("way"), "subroot", "root"
    )

    def fold(leaf_table: pa.Table, side: pa.Table) -> pa.Table:
        ids, nodes, versions = _sorted_columns(leaf_table, "doc_id", "digest", "version")
        rows = levels(nodes, _height(leaf_table.column("n")[0].as_py(), bits))
        upper, subroot, root = (side.column(c)[0].as_py() for c in ("way", "subroot", "root"))
        proofs, folded, copied = [], [], []
        for i, version in enumerate(versions):
            way = siblings(rows, i) + upper
            proofs.append(digest(*[beside[1:] for beside in way]))
            copies = path_copies(nodes[i] if version is None else version, way)
            folded.append(copies[-1])
            copied.append(copies if with_versions and version is not None else None)
        out = {
            "doc_id": pa.array(ids, pa.int64()),
            "leaf": nodes,
            "subroot": [subroot] * len(ids),
            "root": [root] * len(ids),
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [f == root for f in folded],
        }
        if with_versions:
            out["copied"] = pa.array(copied, pa.list_(pa.string()))
        return pa.table(out)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    keyed = placed.withColumn("block", F.shiftright("pos", bits))
    return (
        keyed.groupBy("tree", "block")
        .cogroup(sides.groupBy("tree", "block"))
        .applyInArrow(fold, schema + (", copied array<string>" if with_versions else ""))
    )
