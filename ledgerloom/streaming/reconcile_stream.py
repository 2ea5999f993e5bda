"""Reconcile invoices that arrive as a stream against order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.cleaning import Step
from ledgerloom.operators.duplicates import with_line_key
from ledgerloom.plans.reconcile import Reconciliation, reconcile
from ledgerloom.plans.steps import run_steps, step_name

LINE_BUCKETS = 256  # parts the memory of all lines is kept in

# Steps that look at one row at a time, so they run unchanged on a stream.
ROW_STEPS = (
    "removeNulls", "formatDates", "trimWhitespace", "renameColumn", "dropColumn", "filterRows",
    "standardizeCase", "replaceValues", "flagForReview", "keepAsIs", "custom",
)


def clean_stream(stream: DataFrame, steps: list[Step]) -> DataFrame:
    """Cleaning steps on a stream; steps that need the whole table are refused."""
    for s in steps:
        name = step_name(s.action)
        constant = name == "fillMissing" and s.parameters.get("method") in ("custom", "zero", "empty_string")
        if name not in ROW_STEPS and not constant:
            raise ValueError(f"step {s.action!r} needs the whole table")
    return run_steps(stream, steps).df


def seen_lines(spark: SparkSession, seen: str, buckets: list[int]) -> DataFrame:
    """``hash, bucket, batch`` of the lines kept in some buckets; no other bucket is listed or opened."""
    return spark.read.option("basePath", seen).parquet(*[f"{seen}/bucket={b}" for b in buckets])


def earlier_repeats(
    batch: DataFrame, batch_id: int, seen: str, row_id: str = "_row_id", buckets: int = LINE_BUCKETS
) -> DataFrame:
    """Lines of this batch that an earlier batch has brought: ``line_key, _row_id, first_batch``.

    Lines are kept as a table in the folder ``seen``, dealt into buckets by their hash, with one part per bucket and
    batch.  Only the bytes of the line key are kept: a line's content holds its number, so lines of one hash have one
    number.  A batch reads the buckets its own lines fall into, however many batches came before; a batch that is run
    again replaces its own parts, so the result is the same.
    """
    spark = batch.sparkSession
    lines = with_line_key(batch).filter(F.col("_line_key").isNotNull()).withColumn("hash", F.unhex("_line_key"))
    (
        lines.select("hash", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(batch_id).alias("batch"))
        # One shuffle, for the distinct lines and for the files.
        .repartition("bucket")
        .distinct()
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("bucket", "batch")
        .parquet(seen)
    )
    touched = _buckets_of(spark, seen, batch_id)
    key = F.concat_ws("|", "_number_key", F.lower(F.hex("hash"))).alias("line_key")
    if not touched:
        return lines.select(key, F.col(row_id).alias("_row_id"), F.lit(None).cast("int").alias("first_batch"))
    known = seen_lines(spark, seen, touched).filter(F.col("batch") < batch_id).groupBy("hash").agg(F.min("batch").alias("first_batch"))
    mine = lines.select("_number_key", "hash", F.col(row_id).alias("_row_id"))
    return mine.join(known, "hash").select(key, "_row_id", "first_batch")


def _buckets_of(spark: SparkSession, seen: str, batch_id: int) -> list[int]:
    """The buckets that hold lines of a batch, from the folder names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{seen}/bucket=*/batch={batch_id}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def reconcile_stream(
    invoices: DataFrame,
    pos: DataFrame,
    sink: Callable[[Reconciliation, int], None],
    checkpoint: str,
    receipts: DataFrame | None = None,
    contracts: DataFrame | None = None,
    fuzzy: bool = True,
) -> StreamingQuery:
    """Reconcile each micro-batch of invoices and hand the result to ``sink``.

    Matching is per invoice, so batches give the same matches as one run.  Lines
    repeated inside a batch are in ``duplicates``, lines that an earlier batch has
    brought are in ``repeats``.  ``checkpoint`` is the query's checkpoint folder,
    which must be shared on a cluster; the keys of all lines are kept beside it.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        run = reconcile(batch, pos, receipts, contracts, fuzzy=fuzzy)
        run.repeats = earlier_repeats(batch, batch_id, f"{checkpoint.rstrip('/')}-lines")
        sink(run, batch_id)

    return (
        invoices.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
