"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. Each row gets the digest of its normalised text; digests are written once.
2. A frequent-items sketch of Misra-Gries kind lists the digests that may be
   frequent (at most ``MAX_FREQUENT``).  Sketches are combined in two steps, so no
   task merges more than a few hundred of them.
3. Candidates are counted exactly; those really over the share become *winners*,
   with the row that stays.  At most ``MAX_FREQUENT`` rows, so they are broadcast and
   their copies are settled where they are read, without a shuffle.
4. All other digests go through an ordinary shuffle.  None of their groups holds
   more than about ``1 / TRACKED`` of all rows, so no task is overloaded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

TRACKED = 4096  # entries of a sketch; a digest with over 1/3072 of all rows is always listed
MAX_FREQUENT = 1024  # winners at most: the bound of the broadcast
_MERGE_FAN = 64


def normalised(text: str | Column) -> Column:
    """Text with each run of ASCII white space replaced by one space; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def frequent_digests(digests: DataFrame, column: str = "_digest") -> DataFrame:
    """At most ``MAX_FREQUENT`` digests that may be frequent, one row each (Misra-Gries sketch)."""
    sketch = lambda fn, c, *more: F.call_function(fn, F.col(c), *[F.lit(m) for m in more])
    parts = digests.select(F.hex(column).alias("_item")).groupBy(
        F.pmod(F.spark_partition_id(), F.lit(_MERGE_FAN)).alias("_fan")
    )
    # Grouped by a constant: a task without rows then adds no empty sketch, which cannot be combined.
    merged = (
        parts.agg(sketch("approx_top_k_accumulate", "_item", TRACKED).alias("_s"))
        .groupBy(F.lit("all"))
        .agg(sketch("approx_top_k_combine", "_s", TRACKED).alias("_s"))
    )
    return merged.select(F.inline(sketch("approx_top_k_estimate", "_s", MAX_FREQUENT))).select(
        F.unhex("item").alias(column)
    )


def _winners(digests: DataFrame) -> DataFrame:
    """Verified frequent digests: exact size and the row that stays."""
    least = digests.count() / TRACKED
    return (
        digests.join(F.broadcast(frequent_digests(digests)), "_digest")
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_size"), F.min(_order()).alias("_keep"))
        .filter(F.col("_size") > least)
    )


def _order() -> Column:
    """Rows in the order in which they may stay: by id, rows without id last, then by row."""
    return F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_row").alias("row"))


def _digest_table(docs: DataFrame, scratch: Scratch, text: str, doc_id: str) -> DataFrame:
    return scratch.cut(
        docs.select(
            F.col(doc_id).alias("_id"), text_digest(text).alias("_digest"), F.monotonically_increasing_id().alias("_row")
        ),
        "digests",
    )


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Columns ``doc_id, keep_id, group_size, kept, text_sha256``.  Of equal texts the
    smallest id stays (rows without an id only when no row of the group has one);
    of repeated rows with that id, one is kept.  Null texts equal empty ones.  An
    empty table gives an empty result.  Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    digests = _digest_table(docs, scratch, text, doc_id)
    winners = scratch.cut(_winners(digests), "winners")
    split = digests.join(F.broadcast(winners), "_digest", "left")
    group = Window.partitionBy("_digest")
    rare = (
        digests.join(F.broadcast(winners), "_digest", "left_anti")
        .withColumn("_size", F.count(F.lit(1)).over(group))
        .withColumn("_keep", F.min(_order()).over(group))
    )
    both = split.filter(F.col("_size").isNotNull()).unionByName(rare)
    return both.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_keep.row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one per distinct normalised text.

    The same choice as ``exact_groups``; of rows repeated with the same id, one
    stays.  Winners are picked where they are read: only the rows that carry the
    kept id of a frequent digest are shuffled, its other copies never are.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    winners = scratch.cut(_winners(_digest_table(docs, scratch, text, doc_id)), "winners")
    columns = [F.col("_doc")[c].alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).select(
        "_doc", text_digest(F.col("_doc")[text]).alias("_digest")
    )
    keep = winners.select("_digest", F.col("_keep.id").alias("_kept_id"), F.lit(True).alias("_won"))
    marked = rows.join(F.broadcast(keep), "_digest", "left").filter(
        F.col("_won").isNull() | F.col("_doc")[doc_id].eqNullSafe(F.col("_kept_id"))
    )
    first = Window.partitionBy("_digest").orderBy(F.col("_doc")[doc_id].asc_nulls_last())
    return marked.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*columns)
