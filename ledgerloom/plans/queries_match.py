"""Queries on matching, duplicates and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import match_key
from ledgerloom.operators import duplicates as D
from ledgerloom.operators import findings as R
from ledgerloom.operators import matching as M
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import date, half_up, key, key_a, key_b, key_c, with_
from ledgerloom.plans.fixtures import (
    fx_contract, fx_invoice, fx_invoice_dup, fx_po, fx_receipt, typed_dup,
)
from ledgerloom.plans.reconcile import CHECKED_FIELDS, FINDING_ORDER, number_findings, reconcile, run_summary


def matched(spark, sf) -> DataFrame:
    """Invoices with orders by number, receipts and contracts attached."""
    received = R.received_quantities(fx_receipt(spark, sf))
    invoices = R.with_items_total(fx_invoice(spark, sf))
    m = M.match_invoices(invoices, fx_po(spark, sf), fuzzy=False, received=received, fields=CHECKED_FIELDS)
    return R.with_contract(m, fx_contract(spark, sf))


def simple_match(spark, sf) -> DataFrame:
    return R.match_status(M.match_invoices(fx_invoice(spark, sf), fx_po(spark, sf), fuzzy=False, fields=("currency",)))


def dup_run(spark, sf, keep=False):
    """The whole run over invoices with repeats, without fuzzy names."""
    return reconcile(
        fx_invoice_dup(spark, sf), fx_po(spark, sf), fx_receipt(spark, sf), fx_contract(spark, sf), fuzzy=False, keep=keep, fields=()
    )


def _d(c: str):
    return F.col(c).cast("double").alias(c)


# --- matching ---------------------------------------------------------------


@query(
    "po_exact_match",
    with_(
        ("keyed", "po"),
        """SELECT k.rid, k.pokey AS po_key, p.n AS candidates FROM keyed k
 JOIN (SELECT po_number, count(*) AS n FROM po GROUP BY 1) p ON k.pokey = p.po_number""",
    ),
)
def po_exact_match(spark, sf):
    sizes = fx_po(spark, sf).groupBy(match_key("po_number").alias("po_key")).agg(F.count(F.lit(1)).alias("candidates"))
    return (
        fx_invoice(spark, sf)
        .select(F.col("_row_id").alias("rid"), match_key("po_number").alias("po_key"))
        .join(sizes, "po_key")
        .select("rid", "po_key", "candidates")
    )


@query(
    "po_best_line",
    with_("num", "SELECT rid, po_rid, po_amt::DOUBLE AS po_amount FROM num WHERE po_rid IS NOT NULL"),
)
def po_best_line(spark, sf):
    m = M.match_by_number(fx_invoice(spark, sf), fx_po(spark, sf), fields=()).filter("po is not null")
    return m.select(
        F.col("_row_id").alias("rid"), F.col("po.row_id").alias("po_rid"), F.col("po.amount").cast("double").alias("po_amount")
    )


@query(
    "po_best_line_hot",
    with_(
        ("keyed", "po"),
        """, lines AS MATERIALIZED (SELECT amount, min(rid) AS rid FROM po WHERE ok % 3 = 0 GROUP BY amount),
asked AS MATERIALIZED (SELECT rid, amt FROM keyed WHERE split_part(invoice_number, '-', 2)::BIGINT % 3 = 0),
near AS (SELECT a.rid, a.amt, d.amount AS down, d.rid AS drid, u.amount AS up, u.rid AS urid FROM asked a
 ASOF LEFT JOIN lines d ON a.amt >= d.amount ASOF LEFT JOIN lines u ON a.amt <= u.amount)
SELECT rid, CASE WHEN amt IS NULL THEN (SELECT min(rid) FROM lines) WHEN down IS NULL THEN urid WHEN up IS NULL THEN drid
 WHEN amt - down < up - amt OR (amt - down = up - amt AND drid <= urid) THEN drid ELSE urid END AS po_rid FROM near""",
    ).replace("\n, lines", ",\nlines"),
)
def po_best_line_hot(spark, sf):
    """One order number that holds a third of all lines."""
    hot = lambda df, k: df.withColumn("po_number", F.when(k % 3 == 0, F.lit("HOT")).otherwise(F.col("po_number")))
    pos = hot(fx_po(spark, sf), F.split("po_number", "-")[1].cast("long"))
    invoices = hot(fx_invoice(spark, sf, items=False), F.split("invoice_number", "-")[1].cast("long"))
    m = M.match_by_number(invoices, pos, fields=()).filter("_po_key = 'HOT'")
    return m.select(F.col("_row_id").alias("rid"), F.col("po.row_id").alias("po_rid"))


@query(
    "match_metrics",
    with_(
        "matched",
        """SELECT rid, gap::DOUBLE AS amount_diff, pct AS amount_diff_pct, unknown AS amount_unknown, cstat AS currency_status
 FROM matched WHERE po_rid IS NOT NULL""",
    ),
)
def match_metrics(spark, sf):
    return simple_match(spark, sf).filter("po is not null").select(
        F.col("_row_id").alias("rid"), _d("amount_diff"), "amount_diff_pct", "amount_unknown", "currency_status"
    )


@query("match_summary", with_("matched", "SELECT status, count(*) AS invoices, sum(amt)::DOUBLE AS amount FROM matched GROUP BY 1"))
def match_summary(spark, sf):
    return simple_match(spark, sf).groupBy("status").agg(
        F.count(F.lit(1)).alias("invoices"), F.sum("_amount").cast("double").alias("amount")
    )


def _status(name: str):
    def run(spark, sf):
        return simple_match(spark, sf).filter(F.col("status") == name).select(
            F.col("_row_id").alias("rid"), F.col("po.row_id").alias("po_rid"), _d("amount_diff"), "currency_status"
        )

    return run


for _name in ("currency_mismatch", "amount_mismatch", "matched"):
    query(
        f"status_{_name}" if _name == "matched" else _name,
        with_(
            "matched",
            f"SELECT rid, po_rid, gap::DOUBLE AS amount_diff, cstat AS currency_status FROM matched WHERE status = '{_name}'",
        ),
    )(_status(_name))


@query("no_po_match", with_("matched", "SELECT rid, invoice_number, po_number FROM matched WHERE status = 'no_po_match'"))
def no_po_match(spark, sf):
    return M.unmatched(simple_match(spark, sf)).select(F.col("_row_id").alias("rid"), "invoice_number", "po_number")


_VA = f"""
firsts AS (SELECT po_number, min(rid) AS frid FROM poc GROUP BY 1),
va AS (SELECT k.rid AS irid, p.rid AS prid, row_number() OVER (PARTITION BY k.rid
  ORDER BY (abs(k.amt - p.amount) * 100)::DOUBLE / (p.amount * 100)::DOUBLE, p.rid) AS rn
 FROM (SELECT *, {key_c('vendor_name')} AS vk FROM keyed) k
 JOIN poc p ON p.vk = k.vk AND p.amount <> 0 AND abs(k.amt - p.amount) * 100 <= p.amount * 2
  AND (k.curr IS NULL OR nullif(p.currency, '') IS NULL OR k.curr = p.currency)
 WHERE k.amt <> 0 AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.po_number = k.pokey)),
alt AS (SELECT k.*, coalesce(f.frid, v.prid) AS best,
  CASE WHEN f.frid IS NOT NULL THEN 'po_number' ELSE 'vendor_amount' END AS match_type
 FROM keyed k LEFT JOIN firsts f ON f.po_number = k.pokey LEFT JOIN va v ON v.irid = k.rid AND v.rn = 1
 WHERE f.frid IS NOT NULL OR v.prid IS NOT NULL)
"""


def _alternative(select: str) -> str:
    poc = f"poc AS MATERIALIZED (SELECT po.*, o_orderdate::DATE AS odate, {key_c('vendor_name')} AS vk FROM po JOIN orders ON o_orderkey = po.ok)"
    return with_(("keyed", "po"), "").rstrip() + f",\n{poc},{_VA} {select}"


def _alt_match(spark, sf):
    return M.match_vendor_amount(fx_invoice(spark, sf), fx_po(spark, sf, dates=True), fields=()).filter("po is not null")


@query(
    "vendor_amount_match",
    _alternative(
        """SELECT a.rid, a.best AS po_rid, a.match_type, abs(coalesce(a.amt, 0) - coalesce(p.amount, 0))::DOUBLE AS amount_diff,
 a.match_type = 'vendor_amount' AND (a.curr IS NULL OR nullif(p.currency, '') IS NULL) AS currency_warning
 FROM alt a JOIN poc p ON p.rid = a.best"""
    ),
)
def vendor_amount_match(spark, sf):
    return _alt_match(spark, sf).select(
        F.col("_row_id").alias("rid"), F.col("po.row_id").alias("po_rid"), "match_type", _d("amount_diff"), "currency_warning"
    )


@query(
    "stale_po",
    _alternative(
        """SELECT a.rid, p.rid AS po_rid, a.invoice_date - p.odate AS age_days FROM alt a JOIN poc p ON p.rid = a.best
 WHERE a.invoice_date - p.odate > 730"""
    ),
)
def stale_po(spark, sf):
    return _alt_match(spark, sf).filter("stale_po").select(
        F.col("_row_id").alias("rid"),
        F.col("po.row_id").alias("po_rid"),
        F.datediff("invoice_date", F.col("po.date")).cast("long").alias("age_days"),
    )


# Vendor names by longest common subsequence.  A bit row per name is folded over the other name's
# characters: bit i of a character's mask is set where the first name has it at place i.
_WORDS = "array_to_string(list_sort(string_split(trim(vendor_name), ' ')), ' ')"
_PREFIXED = f"""
fknown AS MATERIALIZED (SELECT substr({key_a('vendor_name')}, 1, 3) AS block, {_WORDS} AS name, min(rid) AS rid FROM po GROUP BY ALL),
fopen AS MATERIALIZED (SELECT rid, vendor_name, substr({key_a('vendor_name')}, 1, 3) AS block, {_WORDS} AS name FROM keyed k
 WHERE trim(vendor_name) <> '' AND NOT EXISTS (SELECT 1 FROM po p WHERE p.po_number = k.pokey)),
fasked AS MATERIALIZED (SELECT DISTINCT block, name, EXISTS (SELECT 1 FROM fknown f WHERE f.block = o.block) AS known FROM fopen o WHERE block <> '' AND name <> ''),
fcand AS MATERIALIZED (SELECT a.block, a.name, f.name AS other, f.rid FROM fasked a JOIN fknown f ON f.block = a.block WHERE known
 UNION ALL SELECT a.block, a.name, f.name, f.rid FROM fasked a CROSS JOIN fknown f WHERE NOT known)"""
# Every name with all orders' names.
_COMPLETE = f"""
fknown AS MATERIALIZED (SELECT {_WORDS} AS name, min(rid) AS rid FROM po GROUP BY ALL),
fopen AS MATERIALIZED (SELECT rid, vendor_name, '' AS block, {_WORDS} AS name FROM keyed k
 WHERE trim(vendor_name) <> '' AND NOT EXISTS (SELECT 1 FROM po p WHERE p.po_number = k.pokey)),
fasked AS MATERIALIZED (SELECT DISTINCT block, name FROM fopen o WHERE name <> ''),
fcand AS MATERIALIZED (SELECT a.block, a.name, f.name AS other, f.rid FROM fasked a CROSS JOIN fknown f)"""
_FUZZY = """
fmask AS MATERIALIZED (SELECT name, length(name) AS n, (1::HUGEINT << length(name)) - 1 AS ones, map(list(c), list(m)) AS masks FROM (
  SELECT name, c, sum(1::HUGEINT << i::INT)::HUGEINT AS m FROM (SELECT name, unnest(string_split(name, '')) AS c, generate_subscripts(string_split(name, ''), 1) - 1 AS i
   FROM (SELECT DISTINCT name FROM fasked)) GROUP BY name, c) GROUP BY name),
fpair AS MATERIALIZED (SELECT DISTINCT name, other FROM fcand),
fscore AS MATERIALIZED (SELECT p.name, p.other, n + length(other) AS total, n - bit_count(list_reduce(list_prepend(ones,
  list_transform(string_split(other, ''), lambda c: coalesce(masks[c], 0::HUGEINT))), lambda v, m: ((v + (v & m)) | (v & xor(m, ones))) & ones)) AS common
 FROM fpair p JOIN fmask USING (name)),
fbest AS MATERIALIZED (SELECT block, name, rid AS po_rid FROM (SELECT c.block, c.name, c.rid, row_number() OVER (PARTITION BY c.block, c.name ORDER BY common::DOUBLE / total DESC, c.rid) AS rn
 FROM fcand c JOIN fscore s ON s.name = c.name AND s.other = c.other WHERE common * 200 >= total * 85) WHERE rn = 1),
fhit AS MATERIALIZED (SELECT o.rid, b.po_rid FROM fopen o JOIN fbest b USING (block, name))"""


def _with_fuzzy(names, select: str, candidates: str = _COMPLETE) -> str:
    return with_(names, "").rstrip() + f",\n{candidates},\n{_FUZZY}\n{select}"


_FUZZY_ROWS = """SELECT k.rid, h.po_rid, k.vendor_name, p.vendor_name AS po_vendor_name FROM fhit h JOIN keyed k ON k.rid = h.rid JOIN po p ON p.rid = h.po_rid"""


def _fuzzy_rows(spark, sf, strict_reference: bool):
    fields = ("vendor_name", "currency")
    m = M.match_invoices(fx_invoice(spark, sf), fx_po(spark, sf), fuzzy=True, strict_reference=strict_reference, fields=fields)
    return m.filter("match_type = 'fuzzy_vendor_name'").select(
        F.col("_row_id").alias("rid"), F.col("po.row_id").alias("po_rid"), "vendor_name",
        F.col("po.vendor_name").alias("po_vendor_name"),
    )


@query("fuzzy_vendor_match", _with_fuzzy(("keyed", "po"), _FUZZY_ROWS))
def fuzzy_vendor_match(spark, sf):
    return _fuzzy_rows(spark, sf, strict_reference=False)


@query("fuzzy_vendor_match_prefix", _with_fuzzy(("keyed", "po"), _FUZZY_ROWS, _PREFIXED))
def fuzzy_vendor_match_prefix(spark, sf):
    return _fuzzy_rows(spark, sf, strict_reference=True)


# --- side tables and checks -------------------------------------------------


@query("received_by_po", with_("received", "SELECT pokey AS po_key, received AS received_quantity FROM received"))
def received_by_po(spark, sf):
    return R.received_quantities(fx_receipt(spark, sf))


@query("contract_index", with_("price", "SELECT vkey AS vendor_key, price AS contract_price FROM price"))
def contract_index(spark, sf):
    return R.contract_prices(fx_contract(spark, sf))


@query("line_item_totals", with_("inv", "SELECT rid, coalesce(items, 0.0) AS items_total FROM inv WHERE items IS NOT NULL"))
def line_item_totals(spark, sf):
    inv = fx_invoice(spark, sf).filter("line_items is not null")
    return inv.select(F.col("_row_id").alias("rid"), R.items_total(F.col("line_items")).alias("items_total"))


def _findings(kind: str, **columns: str):
    def run(spark, sf):
        f = R.invoice_findings(matched(spark, sf), receipts=True, contracts=True, texts=False).filter(F.col("finding_type") == kind)
        return f.select(F.col("inv_row_id").alias("rid"), "severity", *[F.col(v).alias(k) for k, v in columns.items()])

    return run


_SEV = "CASE WHEN amt >= 10000 THEN 'High' ELSE 'Medium' END AS severity"
query(
    "tax_discrepancy",
    with_(
        "wide",
        f"""SELECT rid, {_SEV}, expected, actual FROM (SELECT *, items + taxn AS expected, amt::DOUBLE AS actual FROM wide)
 WHERE items > 0 AND expected > 0 AND abs(actual - expected) * 100 > expected * 2""",
    ),
)(_findings("tax_discrepancy", expected="expected", actual="actual"))
query(
    "goods_receipt",
    with_(
        "wide",
        f"SELECT rid, {_SEV}, qty AS actual FROM wide WHERE po_rid IS NOT NULL AND qty IS NOT NULL AND received IS NULL",
    ),
)(_findings("no_goods_receipt", actual="actual"))
query(
    "quantity_mismatch",
    with_(
        "wide",
        f"""SELECT rid, {_SEV}, received AS expected, qty AS actual FROM wide
 WHERE po_rid IS NOT NULL AND received > 0 AND abs(qty - received) * 100 > received * 5""",
    ),
)(_findings("quantity_mismatch", expected="expected", actual="actual"))
query(
    "contract_variance",
    with_(
        "wide",
        f"""SELECT rid, {_SEV}, price AS expected, amt::DOUBLE / qty AS actual FROM wide
 WHERE qty <> 0 AND amt <> 0 AND price > 0 AND abs(amt::DOUBLE - price * qty) * 100 > price * abs(qty) * 3""",
    ),
)(_findings("contract_price_variance", expected="expected", actual="actual"))


_PRIORITY = "CASE WHEN amt >= 10000 THEN 'High-value — ' WHEN amt >= 1000 THEN 'Medium-value — ' ELSE '' END"
_CUR = "coalesce(nullif(trim(currency), ''), 'USD')"
_TWO = "format('{{:,}}', (({0}) * 100)::BIGINT // 100) || '.' || lpad(((({0}) * 100)::BIGINT % 100)::VARCHAR, 2, '0')"


@query(
    "finding_questions",
    with_(
        "matched",
        f"""SELECT rid, status AS finding_type, CASE WHEN status = 'amount_mismatch' AND amt < 10000 THEN 'Medium' ELSE 'High' END AS severity,
 coalesce({_PRIORITY}, '') || CASE status
 WHEN 'no_po_match' THEN 'Invoice "' || invoice_number || '" from "' || vendor_name || '" for ' || coalesce({_CUR} || ' ' || {_TWO.format('amt')}, 'N/A')
  || ' has no matching PO. How should this be handled?'
 WHEN 'currency_mismatch' THEN 'Invoice "' || invoice_number || '" is in ' || curr || ' but the matched PO is in ' || po_cur
  || '. Amounts cannot be reliably compared across currencies. How should this be resolved?'
 ELSE 'Invoice "' || invoice_number || '" amount is ' || {_CUR} || ' ' || {_TWO.format('amt')} || ' but PO amount is ' || coalesce(po_cur, 'USD') || ' '
  || {_TWO.format('po_amt')} || ' — a difference of ' || {_TWO.format('gap')} || ' (' || ((round(pct * 10000)::INT + 5) // 10 // 10) || '.' || ((round(pct * 10000)::INT + 5) // 10 % 10)
  || '%). How should this be resolved?' END AS question,
 CASE status WHEN 'no_po_match' THEN 'Approve for payment|Request PO number from vendor|Hold for review|Reject invoice'
  WHEN 'currency_mismatch' THEN 'Approve — currencies confirmed correct|Hold for currency verification|Reject invoice'
  ELSE 'Approve invoice amount|Use PO amount|Hold for clarification|Reject invoice' END AS options
 FROM matched WHERE status <> 'matched'""",
    ),
)
def finding_questions(spark, sf):
    m = M.match_invoices(fx_invoice(spark, sf, items=False), fx_po(spark, sf), fuzzy=False, fields=CHECKED_FIELDS)
    return R.invoice_findings(m).select(
        F.col("inv_row_id").alias("rid"), "finding_type", "severity", "question", F.array_join("options", "|").alias("options")
    )


@query(
    "reconcile_summary",
    with_(
        ("finding",),
        """SELECT (SELECT count(*) FROM dmatched) AS total, (SELECT count(*) FROM dmatched WHERE status = 'matched') AS matched,
 (SELECT count(*) FROM dmatched WHERE status <> 'matched') AS flagged, (SELECT count(*) FROM finding) AS findings,
 (SELECT sum(copies - 1)::BIGINT FROM duplines) AS duplicates""",
    ),
)
def reconcile_summary(spark, sf):
    return run_summary(dup_run(spark, sf, keep=True))


@query(
    "finding_queue",
    with_(
        "finding",
        "SELECT finding_id, inv_rid, finding_type, severity, group_key, group_rows::BIGINT AS group_rows FROM finding",
    ),
)
def finding_queue(spark, sf):
    queue = dup_run(spark, sf).queue.select(*FINDING_ORDER, "finding_type", "severity", "group_rows")
    return number_findings(queue).select(
        "finding_id", F.col("inv_row_id").alias("inv_rid"), "finding_type", "severity", "group_key", "group_rows"
    )


@query(
    "reconcile_fuzzy_summary",
    _with_fuzzy(
        ("num", "po"),
        f"""SELECT status, match_type, count(*) AS invoices FROM (
 SELECT CASE WHEN po IS NULL THEN 'no_po_match' WHEN curr <> cur THEN 'currency_mismatch'
  WHEN amt <> 0 AND pa <> 0 AND {half_up('(abs(amt - pa) * 100)', '(pa * 100)', 4)} > 0.02 THEN 'amount_mismatch' ELSE 'matched' END AS status, match_type
 FROM (SELECT n.amt, n.curr, coalesce(n.po_rid, h.po_rid) AS po, p.amount AS pa, nullif(p.currency, '') AS cur,
  CASE WHEN n.po_rid IS NOT NULL THEN 'po_number' WHEN h.po_rid IS NOT NULL THEN 'fuzzy_vendor_name' END AS match_type
  FROM num n LEFT JOIN fhit h ON h.rid = n.rid AND n.po_rid IS NULL LEFT JOIN po p ON p.rid = coalesce(n.po_rid, h.po_rid))) GROUP BY ALL""",
    ),
)
def reconcile_fuzzy_summary(spark, sf):
    run = reconcile(
        fx_invoice(spark, sf), fx_po(spark, sf), fx_receipt(spark, sf), fx_contract(spark, sf), fuzzy=True
    )
    return run.matches.groupBy("status", "match_type").agg(F.count(F.lit(1)).alias("invoices"))


# --- duplicates -------------------------------------------------------------


@query("duplicate_lines", with_("duplines", "SELECT invoice_key, line_key, copies, first_row_id FROM duplines"))
def duplicate_lines(spark, sf):
    return D.duplicate_lines(fx_invoice_dup(spark, sf))


@query(
    "duplicate_line_members",
    with_(
        "duplines",
        "SELECT invoice_key, line_key, h.rid, copies, h.rid = first_row_id AS is_first FROM hashed h JOIN duplines ON line_key = h.h",
    ),
)
def duplicate_line_members(spark, sf):
    return D.duplicate_line_members(fx_invoice_dup(spark, sf)).withColumnRenamed("_row_id", "rid")


@query(
    "duplicate_findings",
    with_(
        "duplines",
        """SELECT first_row_id AS rid, 'High' AS severity, 'Invoice number ''' || invoice_key || ''' has the same line submitted ' || copies
 || ' times. Which occurrence should be kept for payment?' AS question FROM duplines""",
    ),
)
def duplicate_findings(spark, sf):
    return R.duplicate_findings(fx_invoice_dup(spark, sf)).select(F.col("inv_row_id").alias("rid"), "severity", "question")


@query(
    "duplicate_rows",
    with_("hashed", "SELECT h AS row_hash, count(*) AS copies, min(rid) AS first_row_id FROM hashed GROUP BY 1 HAVING count(*) > 1"),
)
def duplicate_rows(spark, sf):
    return D.exact_duplicate_groups(fx_invoice_dup(spark, sf))


@query(
    "duplicate_row_members",
    with_(
        "hashed",
        """SELECT h AS row_hash, rid, copies, is_first FROM (SELECT h, rid, count(*) OVER (PARTITION BY h) AS copies,
 row_number() OVER (PARTITION BY h ORDER BY rid) = 1 AS is_first FROM hashed) WHERE copies > 1""",
    ),
)
def duplicate_row_members(spark, sf):
    return D.exact_duplicate_members(fx_invoice_dup(spark, sf)).withColumnRenamed("_row_id", "rid")


@query(
    "duplicate_row_count",
    with_(
        "hashed",
        """SELECT sum(n)::BIGINT AS total_rows, count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS excess_rows
 FROM (SELECT count(*) AS n FROM hashed GROUP BY h)""",
    ),
)
def duplicate_row_count(spark, sf):
    return D.exact_duplicate_count(fx_invoice_dup(spark, sf))


@query(
    "duplicate_numbers",
    with_(
        "dup",
        "SELECT lower(invoice_number) AS invoice_key, count(*) AS copies, min(rid) AS first_row_id FROM dup GROUP BY 1 HAVING count(*) > 1",
    ),
)
def duplicate_numbers(spark, sf):
    return D.duplicate_numbers(fx_invoice_dup(spark, sf))


@query(
    "duplicate_numbers_given",
    with_(
        "dup",
        """SELECT lower(invoice_number) AS invoice_key, count(*) AS copies, min(rid) AS first_row_id FROM dup
 WHERE NOT starts_with(upper(invoice_number), 'INV-') GROUP BY 1 HAVING count(*) > 1""",
    ),
)
def duplicate_numbers_given(spark, sf):
    return D.duplicate_numbers(fx_invoice_dup(spark, sf), skip_generated=True)


@query(
    "near_duplicates",
    with_(
        "pairs",
        """, anchors AS (SELECT vendor_key, bucket_amount, bucket_currency, day, min(rid) AS arid FROM near GROUP BY ALL)
SELECT n.rid, n.vendor_key, n.bucket_amount::DOUBLE AS bucket_amount, n.bucket_currency, p.n AS partners,
 CASE WHEN n.rid <> a.arid THEN a.arid ELSE (SELECT arg_max(b.arid, b.day) FROM anchors b WHERE b.vendor_key = n.vendor_key
  AND b.bucket_amount = n.bucket_amount AND b.bucket_currency = n.bucket_currency AND b.day < n.day AND b.day >= n.day - 7) END AS linked_row_id
FROM near n JOIN (SELECT rid, count(*) AS n FROM (SELECT a_rid AS rid FROM pairs UNION ALL SELECT b_rid FROM pairs) GROUP BY 1) p ON p.rid = n.rid
JOIN anchors a ON a.vendor_key = n.vendor_key AND a.bucket_amount = n.bucket_amount AND a.bucket_currency = n.bucket_currency AND a.day = n.day""",
    ).replace("\n, anchors", ",\nanchors"),
)
def near_duplicates(spark, sf):
    return D.near_duplicates(typed_dup(spark, sf)).select(
        F.col("_row_id").alias("rid"), "vendor_key", _d("bucket_amount"), "bucket_currency", "partners", "linked_row_id"
    )


@query(
    "near_dup_buckets",
    with_(
        "pairs",
        """SELECT vendor_key, bucket_amount::DOUBLE AS bucket_amount, bucket_currency, count(*) AS pairs,
 len(list_distinct(flatten(list([a_rid, b_rid]))))::BIGINT AS invoices FROM pairs GROUP BY ALL""",
    ),
)
def near_dup_buckets(spark, sf):
    return D.near_duplicate_buckets(typed_dup(spark, sf)).withColumn("bucket_amount", F.col("bucket_amount").cast("double"))


@query(
    "near_dup_window_count",
    with_(
        "near",
        """SELECT rid, n AS neighbours FROM (SELECT rid, count(*) OVER (PARTITION BY vendor_key, bucket_amount, bucket_currency
 ORDER BY day RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) - 1 AS n,
 count(*) OVER (PARTITION BY vendor_key, bucket_amount, bucket_currency ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS w FROM near) WHERE w > 1""",
    ),
)
def near_dup_window_count(spark, sf):
    return D.near_duplicates(typed_dup(spark, sf)).select(
        F.col("_row_id").alias("rid"), F.col("partners_up_to_day").alias("neighbours")
    )


@query(
    "near_dup_findings",
    with_(
        "pairs",
        """SELECT rid, n AS partners FROM (SELECT rid, count(*) AS n FROM (SELECT a_rid AS rid FROM pairs UNION ALL SELECT b_rid FROM pairs) GROUP BY 1)
 WHERE rid IN (SELECT b_rid FROM pairs)""",
    ),
)
def near_dup_findings(spark, sf):
    inv = typed_dup(spark, sf)
    return R.near_duplicate_findings(D.near_duplicates(inv), inv).select(F.col("inv_row_id").alias("rid"), "partners")


@query(
    "affected_invoices",
    with_(
        "pairs",
        """SELECT count(DISTINCT rid) AS affected_invoices FROM (SELECT a_rid AS rid FROM pairs UNION ALL SELECT b_rid FROM pairs
 UNION ALL SELECT rid FROM dup WHERE lower(invoice_number) IN (SELECT lower(invoice_number) FROM dup GROUP BY 1 HAVING count(*) > 1))""",
    ),
)
def affected_invoices(spark, sf):
    return D.affected_invoices(typed_dup(spark, sf))
