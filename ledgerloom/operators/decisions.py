"""Rules, approval items, bulk approval, payable rows, queue summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.duplicates import with_line_key
from ledgerloom.operators.findings import offered
from ledgerloom.plans.reconcile import Reconciliation

# What each kind of rule may approve.  Duplicates are in no list.
RULE_TARGETS = {
    "amount_under": (
        "amount_mismatch", "quantity_mismatch", "contract_price_variance", "tax_discrepancy",
    ),
    "variance_under_pct": (
        "amount_mismatch", "quantity_mismatch", "contract_price_variance", "tax_discrepancy",
    ),
    "vendor_in": (
        "amount_mismatch", "quantity_mismatch", "contract_price_variance", "tax_discrepancy",
        "no_po_match",
    ),
}


@dataclass
class Rule:
    rule_id: str
    cond_type: str
    number: float | None = None
    vendors: list[str] = field(default_factory=list)
    applies_to: list[str] = field(default_factory=list)
    enabled: bool = True

    def __post_init__(self) -> None:
        allowed = RULE_TARGETS.get(self.cond_type)
        if allowed is None:
            raise ValueError(f"rule condition must be one of {sorted(RULE_TARGETS)}")
        if self.cond_type != "vendor_in" and not (self.number and self.number > 0):
            raise ValueError(f"{self.cond_type} needs a positive number")
        if self.cond_type == "vendor_in" and not all(v.strip() for v in self.vendors):
            raise ValueError("vendor_in needs vendor names")
        bad = [t for t in self.applies_to if t not in allowed]
        if bad or not self.applies_to:
            raise ValueError(f"{self.cond_type} cannot apply to {bad or 'nothing'}")


def matching_rule(rules: list[Rule], strict_reference: bool = False) -> Column:
    """Id of the first enabled rule that fits a finding row, NULL when none does.

    The rules travel as one array literal and are tested with a higher-order
    filter, in their order.  ``strict_reference`` lets only amount mismatches
    carry a variance.
    """
    active = [r for r in rules if r.enabled]
    if not active:
        return F.lit(None).cast("string")
    table = F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.cond_type).alias("cond_type"),
                F.lit(r.number).cast("double").alias("number"),
                F.array(*[F.lit(v.strip().lower()) for v in r.vendors]).cast("array<string>").alias("vendors"),
                F.array(*[F.lit(t) for t in r.applies_to]).alias("applies_to"),
            )
            for r in active
        ]
    )
    variance = F.col("diff_pct")
    if strict_reference:
        variance = F.when(F.col("finding_type") == "amount_mismatch", variance)
    vendor = F.lower(F.trim("vendor_name"))

    def fits(r: Column) -> Column:
        ok = (
            F.when(r["cond_type"] == "amount_under", F.col("amount").cast("double") < r["number"])
            .when(r["cond_type"] == "variance_under_pct", variance * 100 < r["number"])
            .otherwise((vendor != "") & F.array_contains(r["vendors"], vendor))
        )
        return F.coalesce(F.array_contains(r["applies_to"], F.col("finding_type")) & ok, F.lit(False))

    first = F.get(F.filter(table, fits), F.lit(0))["rule_id"]
    return F.when(F.col("finding_type") != "duplicate_invoice", first)


def approval_items(findings: DataFrame, rules: list[Rule] | None = None, strict_reference: bool = False) -> DataFrame:
    """One approval per finding: risk, and already approved where a rule fits.

    A rule answers with the first option of the finding.
    """
    rule = matching_rule(rules or [], strict_reference)
    hit = F.col("rule_id").isNotNull()
    return findings.withColumn("rule_id", rule).select(
        "finding_id",
        "finding_type",
        F.when(F.col("severity") == "High", "High").otherwise("Medium").alias("risk"),
        "rule_id",
        F.when(hit, "approved").otherwise("pending").alias("status"),
        F.when(hit, F.coalesce(F.get(offered(F.col("finding_type")), F.lit(0)), F.lit("Approved"))).alias("response"),
        F.when(hit, "auto_rule").alias("responded_via"),
    )


def bulk_approve(ids: DataFrame, approvals: DataFrame, user: str, now: Column) -> DataFrame:
    """Verdict per requested id: apply, not_found, already_resolved or locked_by_other.

    ``approvals`` has ``finding_id``, ``status`` and optionally ``locked_by`` and
    ``locked_until``.  There is no limit on the number of ids.
    """
    state = approvals
    for name, kind in (("locked_by", "string"), ("locked_until", "timestamp")):
        if name not in state.columns:
            state = state.withColumn(name, F.lit(None).cast(kind))
    state = state.select("finding_id", "status", "locked_by", "locked_until")
    held = (
        (F.col("status") == "locked")
        & (F.coalesce("locked_by", F.lit("")) != user)
        & F.col("locked_until").isNotNull()
        & (F.col("locked_until") >= now)
    )
    return ids.join(state, "finding_id", "left").select(
        "finding_id",
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status").isin("approved", "rejected"), "already_resolved")
        .when(held, "locked_by_other")
        .otherwise("apply")
        .alias("verdict"),
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("ids"))


# --- payable rows -----------------------------------------------------------


def _says(response: Column, word: str) -> Column:
    return F.contains(F.lower(response), F.lit(word))


def apply_decisions(
    run: Reconciliation,
    findings: DataFrame,
    approvals: DataFrame,
    invoices: DataFrame,
    row_id: str = "_row_id",
    strict_reference: bool = False,
    include_unanswered: bool = True,
) -> DataFrame:
    """The payable rows: matched invoices, resolved findings, resolved duplicate groups.

    ``findings`` carry ``finding_id``; ``approvals`` has finding_id, status,
    response, responded_via.  An invoice with several findings gives several
    rows.  A response with "reject" or "hold" drops the row; with
    ``strict_reference`` False so does the status ``rejected``, and a duplicate
    group answered with "hold" is dropped even when the answer also says "all".
    """
    data = [c for c in invoices.columns if not c.startswith("_row") or c == row_id]
    keep = [c for c in data if c != row_id]
    null = F.lit(None).cast("string")
    marks = ("_reconciliation_status", "_po_match_type", "_flag_type", "_approval_response",
             "_responded_via", "_approved_by")

    def rows(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(F.col(row_id), *keep, *[values.get(m, null).alias(m) for m in marks])

    matched = rows(
        run.matched,
        _reconciliation_status=F.lit("matched"),
        _po_match_type=F.col("match_type"),
        _approved_by=F.lit("auto"),
    )

    answered = findings.select("finding_id", "finding_type", "inv_row_id", "group_key").join(
        approvals.select("finding_id", "status", "response", "responded_via"), "finding_id", "left"
    ).withColumns(
        {
            "response": F.coalesce(F.nullif("response", F.lit("")), F.lit("no_response")),
            "status": F.coalesce("status", F.lit("pending")),
            "responded_via": F.coalesce("responded_via", F.lit("unknown")),
        }
    )
    if not include_unanswered:
        answered = answered.filter("response != 'no_response'")
    if not strict_reference:
        answered = answered.filter("status != 'rejected'")

    single = answered.filter(
        (F.col("finding_type") != "duplicate_invoice")
        & ~(_says(F.col("response"), "reject") | _says(F.col("response"), "hold"))
    )
    flagged = rows(
        single.withColumnRenamed("inv_row_id", row_id).join(invoices.select(*data), row_id),
        _reconciliation_status=F.when(F.col("status") == "approved", "approved_with_flag").otherwise("held"),
        _flag_type=F.col("finding_type"),
        _approval_response=F.col("response"),
        _responded_via=F.col("responded_via"),
    )

    hold, every = _says(F.col("response"), "hold"), _says(F.col("response"), "all")
    outcome = (
        F.when(every, "all").when(hold, "none").otherwise("first")
        if strict_reference
        else F.when(hold, "none").when(every, "all").otherwise("first")
    )
    groups = (
        answered.filter("finding_type = 'duplicate_invoice'")
        .withColumn("_outcome", outcome)
        .filter("_outcome != 'none'")
        .select(F.col("group_key").alias("_line_key"), F.col("inv_row_id").alias("_first"), "_outcome", "response")
    )
    members = (
        with_line_key(invoices.select(*data))
        .join(groups, "_line_key")
        .filter((F.col("_outcome") == "all") | (F.col(row_id) == F.col("_first")))
    )
    kept = rows(
        members,
        _reconciliation_status=F.when(F.col("_outcome") == "all", "duplicate_kept").otherwise("duplicate_first_kept"),
        _approval_response=F.col("response"),
    )
    return matched.unionByName(flagged).unionByName(kept)


def execution_report(output: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row: rows written and invoices minus rows written."""
    total = invoices.agg(F.count(F.lit(1)).alias("n")).scalar()
    return output.agg(F.count(F.lit(1)).alias("output_rows")).select(
        "output_rows", (total - F.col("output_rows")).alias("excluded_rows")
    )


# --- queue views ------------------------------------------------------------


def queue_progress(approvals: DataFrame) -> DataFrame:
    done = F.col("status").isin("approved", "rejected")
    return approvals.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("answered"),
        F.count_if(~done).alias("pending"),
    )


def queue_summary(queue: DataFrame, top: int = 10) -> DataFrame:
    """Counts by type, by severity and by vendor (the ``top`` largest), and overall.

    Four groupings in one aggregation.  ``queue`` has finding_type, severity,
    vendor_name, amount and ``answered``.
    """
    q = queue.select(
        "finding_type",
        "severity",
        F.coalesce("vendor_name", F.lit("Unknown Vendor")).alias("vendor_name"),
        F.coalesce("amount", F.lit(0).cast("decimal(18,2)")).alias("amount"),
        F.coalesce("answered", F.lit(False)).alias("answered"),
    )
    counted = q.groupingSets(
        [["finding_type"], ["severity"], ["vendor_name"], []],
        "finding_type", "severity", "vendor_name",
    ).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("items"),
        F.count_if("answered").alias("answered_items"),
        F.sum("amount").cast("double").alias("amount"),
    )
    name = {3: "type", 5: "severity", 6: "vendor", 7: "total"}
    view = F.lit(None).cast("string")
    for gid, word in name.items():
        view = F.when(F.col("gid") == gid, F.lit(word)).otherwise(view)
    labelled = counted.select(
        view.alias("view"),
        F.coalesce("finding_type", "severity", "vendor_name", F.lit("all")).alias("label"),
        "items",
        "answered_items",
        "amount",
    )
    vendors = labelled.filter("view = 'vendor'").orderBy(F.col("items").desc(), "label").limit(top)
    return labelled.filter("view != 'vendor'").unionByName(vendors)


def top_vendors(queue: DataFrame, top: int = 10) -> DataFrame:
    return (
        queue.groupBy(F.coalesce("vendor_name", F.lit("Unknown Vendor")).alias("vendor_name"))
        .agg(F.count(F.lit(1)).alias("items"))
        .orderBy(F.col("items").desc(), "vendor_name")
        .limit(top)
    )


PAGE_RANGES = 4096  # ranges counted in one pass
PAGE_ROWS = 100_000  # rows sorted for a page, about; a page of more rows is sorted whole


def _whole_number(df: DataFrame, column: str) -> Column | None:
    """An order-preserving whole number of a column; None for kinds without one."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "date":
        return F.unix_date(column).cast("long")
    return F.col(column).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else None


def _narrowed(df: DataFrame, key: Column, offset: int, limit: int) -> tuple[Column, int, bool]:
    """The range of ``key`` (falling) that holds the page, the rows before it, and whether one value fills the page's range.

    The rows per range are counted, the ranges of the page are cut again, until they hold few rows or one value.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    before = 0
    while True:
        width = (high - low) // PAGE_RANGES + 1
        inside = df.filter(key.between(low, high))
        counts = inside.groupBy(F.floor((key - low) / F.lit(width)).cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n"))
        rows, first, last, held = 0, None, None, 0
        for r, n in sorted(counts.collect(), reverse=True):
            if first is None and before + rows + n > offset:
                first, skipped = r, rows
            rows += n
            if first is not None:
                last, held = r, rows - skipped
                if before + rows >= offset + limit:
                    break
        if first is None:  # the page begins behind all values
            return key < low, before + rows, False
        before += skipped
        low, high, old = low + last * width, min(high, low + (first + 1) * width - 1), (low, high)
        if low == high or held <= max(PAGE_ROWS, 2 * limit) or (low, high) == old:
            return key.between(low, high), before, low == high


def newest_page(df: DataFrame, by: str, tie: str, offset: int, limit: int) -> DataFrame:
    """One page of the newest rows first; a deep page sorts no more than its own neighbourhood.

    Whole numbers, dates and times are narrowed down by counting rows per range, so the rows before the page are
    counted but never sorted; where one value of ``by`` holds the page, ``tie`` is narrowed as well.  Rows without
    ``by`` come last.  Other kinds are sorted as a whole.
    """
    page = df.orderBy(F.col(by).desc(), F.col(tie).desc())
    key = _whole_number(df, by)
    if key is None or limit <= 0 or df.filter(key.isNotNull()).isEmpty():
        return page.offset(offset).limit(limit)
    inside, before, single = _narrowed(df.filter(key.isNotNull()), key, offset, limit)
    second = _whole_number(df, tie)
    if single and second is not None:
        same = df.filter(inside & second.isNotNull())
        # The page may end behind this value; then the rest of it is looked up as a page of its own.
        if before + df.filter(inside).count() >= offset + limit and not same.isEmpty():
            within, skipped, _ = _narrowed(same, second, offset - before, limit)
            inside, before = inside & (within | second.isNull()), before + skipped
    return page.filter(inside | key.isNull()).offset(offset - before).limit(limit)


def message_counts(warnings: DataFrame, column: str = "message") -> DataFrame:
    """Distinct warning texts and how often each occurs."""
    return warnings.groupBy(column).agg(F.count(F.lit(1)).alias("times"))
