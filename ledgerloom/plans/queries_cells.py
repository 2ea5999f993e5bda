"""Queries on single-cell functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates as DT
from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import (
    SP, blank, key, key_a, key_b, key_c, money, number, severity, trim, with_,
)
from ledgerloom.plans.fixtures import fx_dirty, fx_invoice, table
from ledgerloom.sources.roles import canonicalise, second_layout

def _rid():
    return F.col("_row_id").alias("rid")



@query("cell_blanks", with_("dirty", f"SELECT rid, {blank('segment')} AS segment_blank, {blank('name')} AS name_blank, {blank('amount')} OR amount = '-' AS amount_missing FROM dirty"))
def cell_blanks(spark, sf):
    return fx_dirty(spark, sf).select(
        _rid(), T.is_blank("segment").alias("segment_blank"), T.is_blank("name").alias("name_blank"),
        T.is_blank("amount", T.BLANK_WORDS).alias("amount_missing"),
    )


@query("cell_numbers", with_("inv", f"SELECT rid, {money('amount')}::DOUBLE AS amount, {number('tax')} AS tax, {number('quantity')} AS quantity FROM inv"))
def cell_numbers(spark, sf):
    return fx_invoice(spark, sf).select(
        _rid(), N.parse_money("amount").cast("double").alias("amount"), N.parse_number("tax").alias("tax"), N.parse_number("quantity").alias("quantity")
    )


@query(
    "vendor_keys",
    with_("inv", f"SELECT vendor_name, {key_a('vendor_name')} AS key_a, {key_b('vendor_name')} AS key_b, {key_c('vendor_name')} AS key_c, count(*) AS invoices FROM inv GROUP BY ALL"),
)
def vendor_keys(spark, sf):
    names = fx_invoice(spark, sf).groupBy("vendor_name").agg(F.count(F.lit(1)).alias("invoices"))
    return names.select(
        "vendor_name", T.vendor_key_a("vendor_name").alias("key_a"), T.vendor_key_b("vendor_name").alias("key_b"),
        T.vendor_key_c("vendor_name").alias("key_c"), "invoices",
    )


@query("currency_codes", with_("inv", f"SELECT coalesce({key('currency')}, '__NOCURRENCY__') AS currency, count(*) AS invoices FROM inv GROUP BY 1"))
def currency_codes(spark, sf):
    return fx_invoice(spark, sf).groupBy(T.currency_code("currency", "__NOCURRENCY__").alias("currency")).agg(F.count(F.lit(1)).alias("invoices"))


@query(
    "amount_keys",
    with_("dirty", r"SELECT rid, TRY_CAST(nullif(regexp_extract(trim(replace(amount, ',', '')), '\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)'), '') AS DECIMAL(18,2))::DOUBLE AS amount_key FROM dirty"),
)
def amount_keys(spark, sf):
    return fx_dirty(spark, sf).select(_rid(), N.amount_key("amount").cast("double").alias("amount_key"))


@query(
    "money_texts",
    with_("inv", f"SELECT rid, coalesce(coalesce(nullif({trim('currency')}, ''), 'USD') || ' ' || format('{{:,}}', c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0'), 'N/A') AS shown FROM inv"),
)
def money_texts(spark, sf):
    return fx_invoice(spark, sf).select(_rid(), N.money_text(N.parse_money("amount"), "currency").alias("shown"))


@query(
    "priority_words",
    with_(
        "keyed",
        f"SELECT CASE WHEN amt >= 10000 THEN 'High-value — ' WHEN amt >= 1000 THEN 'Medium-value — ' ELSE '' END AS words, {severity('Medium', 'amt')} AS severity, count(*) AS invoices FROM keyed GROUP BY ALL",
    ),
)
def priority_words(spark, sf):
    amount = N.parse_money("amount")
    return fx_invoice(spark, sf).groupBy(N.priority_words(amount).alias("words"), N.severity("Medium", amount).alias("severity")).agg(F.count(F.lit(1)).alias("invoices"))


_D = r"'^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})$'"


@query(
    "type_tests",
    with_(
        "dirty",
        rf"""SELECT rid, regexp_matches(replace(amount, ',', ''), '^\s*[+-]?[0-9]+\s*$') AS is_integer,
 regexp_matches(regexp_replace(amount, '[,$₹€£]', '', 'g'), '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$') AS is_float,
 regexp_matches({trim('date')}, {_D}) AS is_date,
 coalesce(CASE WHEN regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'YYYY-MM-DD' WHEN regexp_matches(date, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN 'DD/MM/YYYY' END, '') AS layout FROM dirty""",
    ),
)
def type_tests(spark, sf):
    return fx_dirty(spark, sf).select(
        _rid(), N.is_integer_text("amount").alias("is_integer"), N.is_float_text("amount").alias("is_float"),
        DT.is_date_text("date").alias("is_date"), F.coalesce(DT.date_layout("date"), F.lit("")).alias("layout"),
    )


def _free(order: str) -> str:
    t = trim("date")
    iso = f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}$') THEN try_strptime(replace({t}, '/', '-'), '%Y-%m-%d') END"
    dash = f"try_strptime({t}, '%d-%m-%Y')"
    dmy, mdy = f"try_strptime({t}, '%d/%m/%Y')", f"try_strptime({t}, '%m/%d/%Y')"
    tail = f"{dmy}, {mdy}" if order == "DMY" else f"{mdy}, {dmy}"
    return f"coalesce(strftime(coalesce({iso}, {dash}, {tail}), '%Y-%m-%d'), {t})"


@query("free_text_dates", with_("dirty", f"SELECT rid, {_free('DMY')} AS day_first, {_free('MDY')} AS month_first FROM dirty"))
def free_text_dates(spark, sf):
    return fx_dirty(spark, sf).select(
        _rid(), DT.free_text_date("date").alias("day_first"), DT.free_text_date("date", "MDY").alias("month_first")
    )


@query("row_fingerprints", with_("dirty", "SELECT rid, md5(to_json(struct_pack(amount := amount, code := code, date := date, name := name, segment := segment))::VARCHAR) AS row_hash FROM dirty"))
def row_fingerprints(spark, sf):
    df = fx_dirty(spark, sf)
    return df.select(_rid(), T.row_fingerprint(T.business_columns(df)).alias("row_hash"))


@query(
    "text_quality",
    rf"""SELECT doc_id, CASE WHEN {blank('text')} THEN 0.0 ELSE least(1000, (good * 1200 + total) // (total * 2)
 + CASE WHEN regexp_matches(text, '\p{{Nd}}{{3}}') THEN 200 ELSE 0 END
 + CASE WHEN regexp_matches(text, '[$£€₹¥₩]|(?:^|[^\p{{L}}\p{{N}}_])(?:USD|EUR|GBP|INR|NPR|AED|SAR|CNY)(?:$|[^\p{{L}}\p{{N}}_])') THEN 200 ELSE 0 END) / 1000.0 END AS quality
 FROM (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '\A[\p{{L}}\p{{N}}_.,\-/:]{{2,}}\z'))) AS good, len(w) AS total
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SP}+'), lambda x: x <> '') AS w FROM documents))""",
)
def text_quality(spark, sf):
    # A file of few row groups would leave most cores without texts.
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id", "text")
    return docs.select("doc_id", T.text_quality("text").alias("quality"))


@query(
    "short_payloads",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…[truncated ' || length(text) || ' chars]' ELSE text END AS text,
 array_to_string(CASE WHEN len(w) > 10 THEN list_append(w[1:10], '...and ' || (len(w) - 10) || ' more') ELSE w END, '|') AS words
 FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)""",
)
def short_payloads(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.short_text("text").alias("text"), F.array_join(T.short_list(F.split("text", " ")), "|").alias("words"))


@query("redacted_columns", "SELECT event_id, '[REDACTED]' AS question, '[REDACTED]' AS response FROM events")
def redacted_columns(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("question"), F.col("props").alias("response"))
    return T.redact_columns(ev)


@query("redacted_json", """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","token":"[REDACTED]"}' AS props FROM events""")
def redacted_json(spark, sf):
    ev = table(spark, sf, "events")
    with_token = F.concat(F.regexp_replace("props", r"\}\s*\z", ""), F.lit(', "token": "t'), F.col("user_id").cast("string"), F.lit('"}'))
    return ev.select("event_id", T.redact_json(with_token).alias("props"))


@query("clean_cells", rf"SELECT conv_id, turn, {trim("regexp_replace(text, '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")} AS text FROM conversations")
def clean_cells(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.clean_cell("text").alias("text"))


@query("canonical_columns", "SELECT o_orderkey AS order_number, o_orderkey AS po_number, o_totalprice AS grand_total, o_totalprice AS amount, o_orderpriority AS priority FROM orders")
def canonical_columns(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order Number"), F.col("o_totalprice").alias("Grand Total"), F.col("o_orderpriority").alias("Priority ")
    )
    return canonicalise(raw)


@query(
    "second_layout",
    """SELECT c_custkey::VARCHAR AS rid, 'INV-' || c_custkey AS invoice_number, lower(c_name) AS vendor_name, c_acctbal AS amount, NULL AS date, NULL AS po_number, NULL AS due_date,
 c_mktsegment AS status, NULL AS currency, NULL AS tax FROM customer""",
)
def second_layout_(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("_row_id"), F.col("c_name").alias("Supplier"), F.col("c_acctbal").alias("Total"), F.col("c_mktsegment").alias("Payment_Status")
    )
    return second_layout(raw).withColumnRenamed("_row_id", "rid")
