"""Business tables derived from the given TPC-H-like tables.

The given tables have no blanks, currencies or free-form dates, so every defect
is derived from the keys.  ``fixture_sql`` states the same rules for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Invented firm names: one word of each list by supplier key, then a legal form.
FIRST = ("Acme", "Borealis", "Cobalt", "Delta", "Evergreen", "Falcon", "Granite", "Harbor", "Indigo", "Juniper")
SECOND = ("Trading", "Metals", "Foods", "Logistics", "Textiles", "Energy", "Paper", "Glass", "Tools", "Marine")
THIRD = ("North", "South", "East", "West", "Central", "Upper", "Lower", "Inner", "Outer", "Grand")
LEGAL = ("Ltd", "Pvt Ltd", "GmbH", "Inc", "LLC", "Private Limited")
CURRENCIES = ("USD", "EUR", "", "INR")
COMMANDS = (
    "approve items {a} to {b}", "Please reject rows {a} - {b}", "request PO for items {a} to {b}",
    "approve {a} items for payment", "decline next {a} records", "request purchase order for {a} invoices",
    "confirm row number {a}", "deny invoice {a}", "accept all the remaining",
    "reject the rest of the", "hold items {a} to {b}", "make it so {a}",
)
SUBSCRIPTION_KINDS = {
    "signup": "subscription.activated", "purchase": "subscription.updated", "error": "subscription.past_due",
    "click": "subscription.canceled", "view": "transaction.completed",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _word(words: tuple[str, ...], index: str) -> str:
    return f"element_at(array({', '.join(repr(w) for w in words)}), int({index}) + 1)"


NAME_WORDS = (
    f"{_word(FIRST, 'sk % 10')} w1", f"{_word(SECOND, '(sk div 10) % 10')} w2",
    f"{_word(THIRD, '(sk div 100) % 10')} w3", f"{_word(LEGAL, 'sk % 6')} lf",
)  # of a supplier's name


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all cores, unless the files already come in parts for half of them; large tables are not shuffled for it."""
    enough = 2 * df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism
    return df if enough else df.repartition(*columns)


def lines(spark: SparkSession, sf: str, dates: bool = False) -> DataFrame:
    """Line items with whole-number money and a sortable row id; with ``dates`` the day of their order (``date``) as well."""
    items = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey ok", "l_partkey pk", "l_suppkey sk", "l_linenumber ln",
        "cast(l_quantity as bigint) q", "cast(round(l_extendedprice * 100) as bigint) pc",
        "cast(round(l_discount * 100) as bigint) disc", "to_date(l_shipdate) ship",
    )
    if dates:  # joined before texts are made, so that numbers are shuffled
        days = table(spark, sf, "orders").selectExpr("o_orderkey as ok", "to_date(o_orderdate) as date")
        items = items.join(days, "ok")
    else:
        items = dealt(items, "ok", "ln", "pk", "sk")
    return (
        items.selectExpr(
            "*",
            "concat_ws('-', lpad(ok, 12, '0'), lpad(ln, 2, '0'), lpad(pk, 10, '0'), lpad(sk, 8, '0'),"
            " lpad(q, 4, '0'), lpad(pc, 12, '0')) rid",
            "(pc * (100 - disc) + 50) div 100 base",
            *NAME_WORDS, f"{_word(LEGAL, '(sk + 1) % 6')} lf2",
            f"{_word(CURRENCIES, 'ok % 4')} cur",
        )
    )


def orders_of(lines_df: DataFrame, *more: str) -> DataFrame:
    """Purchase orders: one row per line item (no date, but for ``more`` columns)."""
    return lines_df.selectExpr(
        "rid as _row_id", "concat('PO-', ok) as po_number", "concat_ws(' ', w1, w2, w3, lf) as vendor_name",
        "cast(base / 100 as decimal(18,2)) as amount", "cast(q as double) as quantity", "cur as currency", *more,
    )


def fx_po(spark: SparkSession, sf: str, dates: bool = False) -> DataFrame:
    if not dates:
        return orders_of(lines(spark, sf))
    return orders_of(lines(spark, sf, dates=True), "date")


_PLAIN = "concat({c} div 100, '.', lpad({c} % 100, 2, '0'))"
_COMMAS = "concat(format_number({c} div 100, 0), '.', lpad({c} % 100, 2, '0'))"


def _invoice_base(spark: SparkSession, sf: str) -> DataFrame:
    return (
        lines(spark, sf)
        .selectExpr("*", "(ok + pk + ln) % 10 m")
        .selectExpr(
            "*",
            "case when m = 9 then null when m in (6, 7) then (base * 1015 + 500) div 1000"
            " when m = 8 then (base * 105 + 50) div 100 else base end as c",
        )
        .selectExpr("*", "c * 8 div 100 as tc")
        .selectExpr("*", "(c - tc) * 6 div 10 as i1")
        .selectExpr("*", "c - tc - i1 + case when pk % 9 = 0 then c * 5 div 100 else 0 end as i2")
    )


def fx_invoice(spark: SparkSession, sf: str, items: bool = True) -> DataFrame:
    """Invoices as they come from a file: texts in several layouts, blanks, other currencies."""
    plain, commas = _PLAIN.format(c="c"), _COMMAS.format(c="c")
    df = _invoice_base(spark, sf).selectExpr(
        "rid as _row_id",
        "concat('INV-', ok, '-', sk) as invoice_number",
        "case pk % 5 when 1 then upper(concat_ws(' ', w1, w2, w3, lf)) when 2 then concat_ws(' ', w2, w1, w3, lf)"
        " when 3 then concat_ws(' ', w1, w2, w3, lf2)"
        " when 4 then concat_ws(' ', concat(substr(w1, 1, 1), substr(w1, 3)), w2, w3, lf)"
        " else concat_ws(' ', w1, w2, w3, lf) end as vendor_name",
        "case when ok % 11 = 0 then '' when ok % 23 = 0 then concat('PX-', ok)"
        " when ok % 3 = 1 then concat(' po-', ok, ' ') when ok % 3 = 2 then concat('Po-', ok)"
        " else concat('PO-', ok) end as po_number",
        f"case pk % 4 when 1 then concat('$', {commas}) when 2 then {commas}"
        f" when 3 then concat('USD ', {commas}) else {plain} end as amount",
        f"case when pk % 7 = 0 then null else {_PLAIN.format(c='tc')} end as tax",
        "case when pk % 17 = 0 then '' else cast(q as string) end as quantity",
        "case when ok % 13 = 0 then 'GBP' when pk % 8 = 0 then concat(' ', lower(cur), ' ') else cur end as currency",
        "case ok % 3 when 1 then date_format(ship, 'dd/MM/yyyy') when 2 then date_format(ship, 'MM/dd/yyyy')"
        " else date_format(ship, 'yyyy-MM-dd') end as date",
        "ship as invoice_date",
        "case when pk % 5 = 0 or c is null then null else array("
        " named_struct('quantity', cast(q as double), 'unit_price', cast(null as double), 'total', i1 / 100, 'description', 'part one'),"
        " named_struct('quantity', cast(q as double), 'unit_price', cast(null as double), 'total', i2 / 100, 'description', 'part two')"
        ") end as line_items",
    )
    return df if items else df.drop("line_items")


def fx_invoice_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices plus exact repeats, near repeats 3 days later and far ones 8 days later."""
    base = fx_invoice(spark, sf, items=False)
    a, b, c = (F.col("_ok") % n == 0 for n in (17, 19, 29))
    kind = (
        F.when(a & ~b & ~c, F.array(F.lit(0), F.lit(1)))
        .when(b & ~a & ~c, F.array(F.lit(0), F.lit(2)))
        .when(c & ~a & ~b, F.array(F.lit(0), F.lit(3)))
        .otherwise(F.array(F.lit(0)))
    )
    # The number is cut out once a row; an inner explode would come with a filter that tests all again.
    numbered = base.withColumn("_ok", F.split("invoice_number", "-")[1].cast("long"))
    copies = numbered.withColumn("_kind", F.explode_outer(kind))
    days = F.when(F.col("_kind") == 2, 3).when(F.col("_kind") == 3, 8).otherwise(0)
    return copies.select(
        F.concat("_row_id", F.lit("-"), F.col("_kind").cast("string")).alias("_row_id"),
        F.when(F.col("_kind") >= 2, F.concat(F.lit("R"), F.col("_kind").cast("string"), F.lit("-"), F.col("invoice_number")))
        .otherwise(F.col("invoice_number")).alias("invoice_number"),
        *[c for c in base.columns if c not in ("_row_id", "invoice_number", "invoice_date")],
        F.date_add("invoice_date", days).alias("invoice_date"),
    )


def typed_dup(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a parsed amount, as the near-duplicate operators expect."""
    from ledgerloom.functions.numbers import parse_money

    return fx_invoice_dup(spark, sf).withColumn("amount", parse_money("amount"))


def fx_receipt(spark: SparkSession, sf: str) -> DataFrame:
    """Goods receipts: two per line item, some orders without, some short."""
    h = "case when ok % 9 = 0 then q * 90 else q * 100 end"
    return (
        lines(spark, sf)
        .filter("ok % 7 != 0")
        .selectExpr("rid", "ok", f"{h} as h")
        .selectExpr("rid", "ok", "explode(array(h * 6 div 10, h - h * 6 div 10)) as part")
        .selectExpr("concat('po-', ok) as po_number", f"{_PLAIN.format(c='part')} as quantity")
    )


def fx_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Contract prices per supplier, with a later, higher row for every fourth."""
    # The name hangs on the supplier key alone, so it is put together once per supplier.
    per = lines(spark, sf).groupBy("sk").agg(F.sum("pc").alias("p"), F.sum("q").alias("n"))
    return (
        per.selectExpr("*", *NAME_WORDS, "(p + n div 2) div n as u")
        .selectExpr("*", "explode(case when sk % 4 = 0 then array(0, 1) else array(0) end) as k")
        .selectExpr("*", "case when k = 1 then u * 110 div 100 else u end as v")
        .selectExpr(
            "concat(lpad(sk, 8, '0'), '-', k) as _row_id", "concat_ws(' ', w1, w2, w3, lf) as vendor_name",
            f"{_PLAIN.format(c='v')} as unit_price",
        )
    )


def fx_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with spoilt cells: blanks, spaces, mixed case, odd dates and amounts, repeats."""
    names = ("o'connor trading", "  smith-jones  ", "McDONALD", "ibm llc", "macleod & sons", "élan  vital", "PLAIN name", "")
    dates = (
        "2024-02-29", "31/02/2025", "29/02/2023", "29/02/2024", "05/06/2024", "13/02/2024", "02/13/2024",
        "1-2-2023", "not a date", "", "2024/01/05",
    )
    amounts = ("c", "12abc", "abc", "c", "-", "", "c")
    return (
        table(spark, sf, "customer")
        .selectExpr("c_custkey k", "c_mktsegment segment", "cast(round(c_acctbal * 100) as bigint) c")
        .selectExpr("k", "segment", "c", "explode(case when k % 10 = 3 then array(0, 1) else array(0) end) as copy")
        .selectExpr(
            "concat(lpad(k, 10, '0'), '-', copy) as _row_id",
            f"{_word(tuple(n.replace(chr(39), '§') for n in names), 'k % 8')} as n0",
            f"{_word(dates, 'k % 11')} as date",
            f"{_word(amounts, 'k % 7')} as a0",
            "c", "case when k % 6 = 0 then null when k % 6 = 1 then '  ' else segment end as segment",
            "cast(k as string) as code",
        )
        .selectExpr(
            "_row_id", "replace(n0, '§', chr(39)) as name", "date",
            "case when a0 = 'c' then cast(cast(c / 100 as decimal(18,2)) as string) else a0 end as amount",
            "segment", "code",
        )
    )


def fx_text(spark: SparkSession, sf: str) -> DataFrame:
    """One plain-text invoice per line item."""
    c, t = _COMMAS.format(c="c"), _PLAIN.format(c="tc")
    return _invoice_base(spark, sf).selectExpr(
        "rid as doc_id",
        "concat("
        " case when pk % 6 = 5 then 'Scan page 1' else concat('Invoice No: INV-', ok, '/', sk) end, chr(10),"
        " 'Vendor: ', concat_ws(' ', w1, w2, w3, lf), chr(10),"
        " case ok % 4 when 0 then concat('Invoice Date: ', date_format(ship, 'dd/MM/yyyy'))"
        "  when 1 then concat('Date: ', date_format(ship, 'yyyy-MM-dd'))"
        "  when 2 then concat('Date: ', date_format(ship, 'd MMMM yyyy')) else 'Terms: net 30' end, chr(10),"
        " case when ok % 11 = 0 then 'Remarks: none' else concat('PO No: PO-', ok) end, chr(10),"
        f" case when c is null then 'Paid in full' else concat('Sub-items $', {t}, chr(10), 'VAT: ', {t}, chr(10),"
        f"  case when pk % 3 = 0 then 'Total: $' else 'Grand Total: $' end, {c}) end, chr(10),"
        " case when ok % 5 = 0 then 'Currency: AUD' else 'Thank you' end) as text",
    )


def fx_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Review commands written by users, one per event."""
    pattern = _word(tuple(COMMANDS), "event_id % 12")
    return table(spark, sf, "events").selectExpr(
        "event_id as command_id", "user_id",
        f"replace(replace({pattern}, '{{a}}', cast(user_id + 1 as string)), '{{b}}',"
        " cast(user_id + 1 + event_id % 40 as string)) as command",
        "event_id % 90 as resolved",
        "case when event_id % 25 = 0 then 0 else 120 end as total",
    )


def fx_webhook(spark: SparkSession, sf: str) -> DataFrame:
    """Billing events, some delivered again an hour or four days later."""
    kind = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in SUBSCRIPTION_KINDS.items()) + " end"
    return (
        table(spark, sf, "events")
        .selectExpr(
            "event_id", "user_id", "ts", f"{kind} as event_type", "event_type as raw_type",
            "explode(case when event_id % 50 = 0 then array(0, 1, 96) when event_id % 10 = 0 then array(0, 1) else array(0) end) as h",
        )
        .selectExpr(
            "event_id", "user_id", "ts + make_interval(0, 0, 0, 0, h) as ts", "event_type",
            "case when event_id % 3 = 0 then null else concat('plan-', event_id % 4) end as plan",
            "case when event_id % 2 = 0 then 'active' else 'trialing' end as status",
            "date_format(ts, 'yyyy-MM-dd') as renews_at",
            "concat('sub-', user_id, '-', event_id) as subscription_id",
            "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as canceled_at",
            "h",
        )
    )


def fx_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Security log entries: one per event, a log per day and user."""
    return table(spark, sf, "events").selectExpr(
        "date_format(ts, 'yyyy-MM-dd') as log_date", "user_id", "event_id",
        "concat('{\"time\":\"', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '\",\"event\":\"', upper(event_type),"
        " '\",\"userId\":', user_id, '}') as body",
    )
