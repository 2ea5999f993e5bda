"""Queries on text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import text_fields as X
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import SP, plain, trim, with_
from ledgerloom.plans.fixtures import fx_text, lines, table

_F = {
    "invoice_number": "CASE WHEN pk % 6 = 5 THEN NULL ELSE 'INV-' || ok || '/' || sk END",
    "date": "CASE WHEN ok % 4 = 3 THEN NULL ELSE strftime(ship, '%Y-%m-%d') END",
    "po_number": "CASE WHEN ok % 11 = 0 THEN NULL ELSE 'PO-' || ok END",
    "amount": "c / 100.0",
    "tax": "tc / 100.0",
    "currency": "CASE WHEN ok % 5 = 0 THEN 'AUD' WHEN c IS NOT NULL THEN 'USD' END",
}


def _sql_patterns(field: str) -> str:
    tries = [f"nullif(regexp_extract(text, '(?im){p}', 1), '')" for p in X.PATTERNS[field]]
    return f"coalesce({', '.join(tries)})"


_VENDOR = "coalesce(" + ", ".join(
    f"(SELECT CASE WHEN length(v) >= 3 AND NOT regexp_matches(v, '^[0-9 ./-]+$') THEN v END FROM (SELECT trim(regexp_extract(text, '(?im){p}', 1), ' ' || chr(10) || chr(9) || chr(13)) AS v))"
    for p in X.PATTERNS["vendor_name"]
) + ")"
_NUM = lambda f: f"TRY_CAST(replace({_sql_patterns(f)}, ',', '') AS DOUBLE)"
_RAWDATE = _sql_patterns("date")
_DATE = f"""coalesce(strftime(coalesce(try_strptime({_RAWDATE}, '%Y-%m-%d'), try_strptime({_RAWDATE}, '%d %B %Y'), try_strptime({_RAWDATE}, '%d/%m/%Y'), try_strptime({_RAWDATE}, '%m/%d/%Y')), '%Y-%m-%d'), {_RAWDATE})"""
_CUR = f"coalesce(upper({_sql_patterns('currency_code')}), CASE regexp_extract(text, '([$£€₹¥₩])', 1) WHEN '$' THEN 'USD' END)"
_FIELDS = f"""fields AS MATERIALIZED (SELECT doc_id, {_sql_patterns('invoice_number')} AS invoice_number, {_VENDOR} AS vendor_name, {_DATE} AS date,
 {_sql_patterns('po_number')} AS po_number, {_NUM('amount')} AS amount, {_NUM('tax')} AS tax, {_CUR} AS currency FROM doc_text)"""


@query("invoice_text_fields", with_("doc_text", "").rstrip() + f",\n{_FIELDS} SELECT * FROM fields")
def invoice_text_fields(spark, sf):
    return X.extract_fields(fx_text(spark, sf), "text").drop("text")


_CONF = """(CASE WHEN invoice_number IS NOT NULL THEN 200 ELSE 0 END + CASE WHEN vendor_name IS NOT NULL THEN 200 ELSE 0 END
 + CASE WHEN amount IS NOT NULL THEN 200 ELSE 0 END + CASE WHEN date IS NOT NULL THEN 80 ELSE 0 END + CASE WHEN currency IS NOT NULL THEN 40 ELSE 0 END
 + CASE WHEN po_number IS NOT NULL THEN 80 ELSE 0 END + CASE WHEN amount > 0 THEN 50 ELSE 0 END
 + CASE WHEN regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 40 ELSE 0 END + 70)"""


@query(
    "text_confidence",
    with_("doc_text", "").rstrip()
    + f""",\n{_FIELDS} SELECT doc_id, least(1000, c) / 1000.0 AS confidence,
 CASE WHEN c >= 800 THEN 'high' WHEN c >= 600 THEN 'medium' WHEN c >= 450 THEN 'low' ELSE 'very_low' END AS label, c < 450 AS review,
 ((least(1000, c) * 70 + 800 * 30 + 50) // 100) / 1000.0 AS blended FROM (SELECT *, {_CONF} AS c FROM fields)""",
)
def text_confidence(spark, sf):
    df = X.extract_fields(fx_text(spark, sf), "text").withColumn("confidence", X.confidence())
    return df.select(
        "doc_id", "confidence", X.confidence_label("confidence").alias("label"), X.needs_review("confidence").alias("review"),
        X.blended("confidence", F.lit(0.8)).alias("blended"),
    )


_LINES = f"""ln AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (
 SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS l FROM doc_text))"""


_KV = r"'^([A-Za-z\s#/.]+)[\s:]+(.+)$'"


@query(
    "key_value_lines",
    with_("doc_text", "").rstrip()
    + f""",
{_LINES} SELECT doc_id, line_no, {trim(f'regexp_extract(line, {_KV}, 1)')} AS key, {trim(f'regexp_extract(line, {_KV}, 2)')} AS value
 FROM ln WHERE length(line) >= 5 AND regexp_matches(line, {_KV})""",
)
def key_value_lines(spark, sf):
    return X.key_values(fx_text(spark, sf), "text").withColumn("line_no", F.col("line_no").cast("long"))


def _tag(group: bool) -> str:
    out = " ".join(
        f"WHEN regexp_matches(line, '(?i){p}') THEN " + (trim(f"regexp_extract(line, '(?i){p}', 1)") if group else f"'{name}'")
        for name, p in X.LINE_TAGS
    )
    return f"CASE {out} END"


@query(
    "tagged_lines",
    with_("doc_text", "").rstrip() + f",\n{_LINES} SELECT doc_id, line_no, {_tag(False)} AS tag, {_tag(True)} AS tag_value FROM ln",
)
def tagged_lines(spark, sf):
    return X.tag_lines(fx_text(spark, sf), "text").drop("line").withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "table_line_items",
    "SELECT l_orderkey AS doc, count(*) AS items, sum(l_quantity) AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total_cents FROM lineitem GROUP BY 1",
)
def table_line_items(spark, sf):
    from ledgerloom.plans.fixtures import lines as _lines

    raw = _lines(spark, sf).selectExpr(
        "ok as doc", "rid as _row_id", "cast(q as string) as `Qty Billed`", "concat('$', format_number(pc / 100, 2)) as `Line Total`", "w1 as `Item Desc`"
    )
    docs = X.collect_items(X.line_items(raw, ["doc"]), ["doc"])
    zero = F.lit(0.0)
    return docs.select(
        "doc",
        F.size("line_items").cast("long").alias("items"),
        F.aggregate("line_items", zero, lambda a, x: a + x["quantity"]).alias("quantity"),
        F.aggregate("line_items", F.lit(0).cast("long"), lambda a, x: a + F.round(x["total"] * 100).cast("long")).alias("total_cents"),
    )


@query(
    "best_attempt",
    with_(
        "line",
        """SELECT ok AS doc, conf, attempt FROM (SELECT ok, (pk % 100) / 100.0 AS conf, rid AS attempt, row_number() OVER (PARTITION BY ok ORDER BY pk % 100 DESC, pc) AS rn FROM line) WHERE rn = 1""",
    ),
)
def best_attempt(spark, sf):
    attempts = lines(spark, sf).selectExpr("ok as doc", "(pk % 100) / 100 as conf", "pc", "rid as attempt")
    return X.best_attempt(attempts, "doc", "conf", "pc").select("doc", "conf", "attempt")


@query(
    "document_lines",
    f"""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE {trim('l')} <> '' GROUP BY 1""",
)
def document_lines(spark, sf):
    return X.text_lines(table(spark, sf, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
