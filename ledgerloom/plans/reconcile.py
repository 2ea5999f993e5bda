"""The whole reconcile run as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.blocks import dense_positions
from ledgerloom.operators.duplicates import duplicate_lines
from ledgerloom.operators.findings import (
    duplicate_findings, invoice_findings, match_status, received_quantities, with_contract,
)
from ledgerloom.operators.matching import match_invoices
from ledgerloom.session import cut_lineage


CHECKED_FIELDS = ("po_number", "currency")  # columns of ``po`` that the checks read, besides row id and amount


@dataclass
class Reconciliation:
    """``matches``: every invoice with its order and status.  ``findings``: all findings with question
    and answers.  ``queue``: the same findings without those texts, for numbering, counting and
    deciding.  ``duplicates``: groups of repeated lines.  ``repeats``: on a stream, lines
    that came in an earlier batch.  All lazy; contract prices are written first."""

    matches: DataFrame
    findings: DataFrame
    duplicates: DataFrame
    repeats: DataFrame | None = None
    queue: DataFrame | None = None

    @property
    def matched(self) -> DataFrame:
        return self.matches.filter("status = 'matched'")

    @property
    def flagged(self) -> DataFrame:
        return self.matches.filter("status != 'matched'")


def reconcile(
    invoices: DataFrame,
    pos: DataFrame,
    receipts: DataFrame | None = None,
    contracts: DataFrame | None = None,
    row_id: str = "_row_id",
    fuzzy: bool = True,
    keep: bool = False,
    fields: tuple[str, ...] | None = None,
) -> Reconciliation:
    """Match invoices to orders and raise findings.

    Receipts and contracts are optional; without them their checks do not run.
    With ``keep`` the match table is written once to the checkpoint folder; do so
    when both the matches and the findings are going to be used.  ``fields``
    limits ``po`` of the matches to these columns and those the checks need.
    """
    received = None if receipts is None else received_quantities(receipts)
    if fields is not None:
        fields = (*CHECKED_FIELDS, *fields)
    matched = match_invoices(invoices, pos, row_id, fuzzy, received=received, fields=fields)
    if contracts is not None:
        matched = with_contract(matched, contracts, row_id)
    if keep:
        matched = cut_lineage(matched)
    matches = match_status(matched)
    found = lambda texts: invoice_findings(
        matched, row_id, receipts is not None, contracts is not None, texts
    ).unionByName(duplicate_findings(invoices, row_id, texts))
    return Reconciliation(
        matches=matches,
        findings=found(True),
        duplicates=duplicate_lines(invoices, row_id),
        queue=found(False),
    )


FINDING_ORDER = ("inv_row_id", "check_order", "group_key")  # what a finding's place in the queue hangs on


def number_findings(findings: DataFrame) -> DataFrame:
    """Add ``finding_id``: the 0-based place in the queue.

    All columns given are written, sorted; give those of ``run.queue`` that are read later (``FINDING_ORDER`` among
    them) and add the texts of the rows to be shown with ``with_texts``.  Invoices in row order, inside an invoice status, tax, receipt, contract;
    duplicate groups after all invoices.
    """
    # Written before the sort, whose sampling would otherwise run the matching a second time.
    ordered = cut_lineage(findings.withColumn("_late", (F.col("check_order") == 9).cast("int")))
    order = ["_late", *FINDING_ORDER]
    return dense_positions(ordered, order, "finding_id").drop("_late")


def run_summary(run: Reconciliation) -> DataFrame:
    """One row: invoices, matched, flagged, findings, duplicate rows."""
    counts = run.matches.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") != "matched").alias("flagged"),
    )
    found = run.queue.agg(
        F.count(F.lit(1)).alias("findings"),
        F.coalesce(
            F.sum(F.when(F.col("check_order") == 9, F.col("group_rows") - 1)), F.lit(0)
        ).alias("duplicates"),
    )
    return counts.select(
        "*",
        found.select("findings").scalar().alias("findings"),
        found.select("duplicates").scalar().alias("duplicates"),
    )
