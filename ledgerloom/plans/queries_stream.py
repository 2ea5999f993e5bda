"""Queries that run a stream to its end over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import trim, with_
from ledgerloom.plans.fixtures import fx_dirty, fx_invoice_dup, fx_po
from ledgerloom.plans.queries_clean import _S3, STEPS
from ledgerloom.session import Scratch
from ledgerloom.streaming.reconcile_stream import clean_stream, reconcile_stream

BATCHES = 3


@query(
    "stream_cleaning",
    with_("dirty", f"SELECT rid, name, date, amount, segment, code AS customer_code FROM ({_S3})"),
)
def stream_cleaning(spark, sf):
    """Cleaning steps, all but the one that needs the whole table, on a stream of files."""
    scratch = Scratch(spark)
    arriving, out = scratch.path("in"), scratch.path("out")
    fx_dirty(spark, sf).write.parquet(arriving)
    stream = spark.readStream.schema(spark.read.parquet(arriving).schema).parquet(arriving)
    cleaned = clean_stream(stream, [s for s in STEPS if s.action != "dedup"])
    cleaned.writeStream.option("checkpointLocation", scratch.path("cp")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out).withColumnRenamed("_row_id", "rid")


@query(
    "stream_repeats",
    with_("hashed", "").rstrip()
    + f""", placed AS (SELECT rid, upper(invoice_number) || h AS line, (substr(rid, 1, 12)::BIGINT + right(rid, 1)::BIGINT) % {BATCHES} AS batch FROM hashed)
SELECT p.rid, min(e.batch) AS first_batch FROM placed p JOIN placed e ON e.line = p.line AND e.batch < p.batch GROUP BY p.rid""",
)
def stream_repeats(spark, sf):
    """Invoices that arrive in batches: the lines that an earlier batch has brought."""
    scratch = Scratch(spark)
    arriving, out, checkpoint = scratch.path("in"), scratch.path("out"), scratch.path("cp")
    invoices, pos = fx_invoice_dup(spark, sf), fx_po(spark, sf)
    place = (F.substring("_row_id", 1, 12).cast("long") + F.expr("right(_row_id, 1)").cast("long")) % BATCHES

    def sink(run, batch_id):
        run.repeats.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch_id}")

    for batch in range(BATCHES):
        invoices.filter(place == batch).write.mode("append").option("compression", "zstd").parquet(arriving)
        stream = spark.readStream.schema(invoices.schema).parquet(arriving)
        reconcile_stream(stream, pos, sink, checkpoint, fuzzy=False).awaitTermination()
    found = spark.read.parquet(out)
    return found.select(F.col("_row_id").alias("rid"), F.col("first_batch").cast("long").alias("first_batch"))
