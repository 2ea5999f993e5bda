"""The derived tables and the operators' answers, stated in DuckDB SQL.

``with_(...)`` puts the named common table expressions, with what they need, in
front of a query.
"""

from __future__ import annotations

from ledgerloom.plans.fixtures import (
    COMMANDS, CURRENCIES, FIRST, LEGAL, SECOND, SUBSCRIPTION_KINDS, THIRD,
)


def _list(words) -> str:
    return "([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "])"


def _word(words, index: str) -> str:
    return f"{_list(words)}[CAST({index} AS INT) + 1]"


def plain(c: str) -> str:
    return f"(({c}) // 100)::VARCHAR || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0')"


def commas(c: str) -> str:
    return f"format('{{:,}}', ({c}) // 100) || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0')"


SP = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NSP = SP.replace("[", "[^", 1)


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '\A{SP}+|{SP}+\z', '', 'g')"


def blank(c: str) -> str:
    return f"(NOT coalesce(regexp_matches({c}, '{NSP}'), false))"


def key(c: str) -> str:
    return f"upper(nullif({trim(c)}, ''))"


def money(c: str) -> str:
    return rf"TRY_CAST(nullif(regexp_replace({c}, '[^0-9.\-]', '', 'g'), '') AS DECIMAL(18,2))"


def number(c: str) -> str:
    return rf"TRY_CAST(nullif(regexp_replace({c}, '[^0-9.\-]', '', 'g'), '') AS DOUBLE)"


def prefix(c: str) -> str:
    return (
        f"TRY_CAST(nullif(regexp_extract({trim(c)}, "
        r"'\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?'), '') AS DOUBLE)"
    )


def half_up(n: str, d: str, scale: int) -> str:
    return f"(((({n})::HUGEINT * {2 * 10**scale} + ({d})::HUGEINT) // (({d})::HUGEINT * 2))::DOUBLE / {10**scale}.0)"


def percent(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN 0.0 ELSE {half_up(f'({n}) * 100', d, 1)} END"


def key_a(c: str) -> str:
    out = trim(f"lower({c})")
    for w in ("pvt", "ltd", "llc", "inc", "corp", "co", "gmbh", "plc", "ag", "limited", "private", "incorporated"):
        out = rf"regexp_replace({out}, '\s* {w}\z', '')"
    return trim(rf"regexp_replace(regexp_replace({out}, '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')")


def key_b(c: str) -> str:
    words = "pvt|private|limited|ltd|inc|corp|llc|llp|co|pty|gmbh|srl|bv|ag|sa|incorporated"
    out = rf"regexp_replace(lower({c}), '\b(\w+)\.', '\1', 'g')"
    out = rf"regexp_replace({out}, '\b({words})\b', '', 'g')"
    return trim(rf"regexp_replace(regexp_replace({out}, '[.,]', '', 'g'), '{SP}+', ' ', 'g')")


def key_c(c: str) -> str:
    out = rf"regexp_replace(lower({c}), '\bpvt\b|\blimited\b|\bltd\b|\binc\b|\bcorp\b|\bllc\b', '', 'g')"
    return trim(rf"regexp_replace(regexp_replace({out}, '[.,]', '', 'g'), '{SP}+', ' ', 'g')")


def severity(base: str, amount: str) -> str:
    return f"CASE WHEN {amount} >= 10000 THEN 'High' ELSE '{base}' END"


def date(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


_HIT = "po_rid IS NOT NULL"
_BOTH = "(amt <> 0 AND po_amt <> 0)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "line": (
        (),
        f"""SELECT *, lpad(ok::VARCHAR, 12, '0') || '-' || lpad(ln::VARCHAR, 2, '0') || '-' || lpad(pk::VARCHAR, 10, '0')
 || '-' || lpad(sk::VARCHAR, 8, '0') || '-' || lpad(q::VARCHAR, 4, '0') || '-' || lpad(pc::VARCHAR, 12, '0') AS rid,
 (pc * (100 - disc) + 50) // 100 AS base,
 {_word(FIRST, 'sk % 10')} AS w1, {_word(SECOND, '(sk // 10) % 10')} AS w2, {_word(THIRD, '(sk // 100) % 10')} AS w3,
 {_word(LEGAL, 'sk % 6')} AS lf, {_word(LEGAL, '(sk + 1) % 6')} AS lf2, {_word(CURRENCIES, 'ok % 4')} AS cur
FROM (SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, l_quantity::BIGINT AS q,
 round(l_extendedprice * 100)::BIGINT AS pc, round(l_discount * 100)::BIGINT AS disc, l_shipdate::DATE AS ship FROM lineitem)""",
    ),
    "po": (
        ("line",),
        """SELECT rid, 'PO-' || ok AS po_number, concat_ws(' ', w1, w2, w3, lf) AS vendor_name,
 (base / 100.0)::DECIMAL(18,2) AS amount, q::DOUBLE AS quantity, cur AS currency, ok FROM line""",
    ),
    "base": (
        ("line",),
        """SELECT *, c - tc - i1 + CASE WHEN pk % 9 = 0 THEN c * 5 // 100 ELSE 0 END AS i2 FROM (
 SELECT *, (c - tc) * 6 // 10 AS i1 FROM (
 SELECT *, c * 8 // 100 AS tc FROM (
 SELECT *, CASE WHEN m = 9 THEN NULL WHEN m IN (6, 7) THEN (base * 1015 + 500) // 1000
  WHEN m = 8 THEN (base * 105 + 50) // 100 ELSE base END AS c FROM (
 SELECT *, (ok + pk + ln) % 10 AS m FROM line))))""",
    ),
    "inv": (
        ("base",),
        f"""SELECT rid, ok, pk, 'INV-' || ok || '-' || sk AS invoice_number,
 CASE pk % 5 WHEN 1 THEN upper(concat_ws(' ', w1, w2, w3, lf)) WHEN 2 THEN concat_ws(' ', w2, w1, w3, lf)
  WHEN 3 THEN concat_ws(' ', w1, w2, w3, lf2) WHEN 4 THEN concat_ws(' ', substr(w1, 1, 1) || substr(w1, 3), w2, w3, lf)
  ELSE concat_ws(' ', w1, w2, w3, lf) END AS vendor_name,
 CASE WHEN ok % 11 = 0 THEN '' WHEN ok % 23 = 0 THEN 'PX-' || ok WHEN ok % 3 = 1 THEN ' po-' || ok || ' '
  WHEN ok % 3 = 2 THEN 'Po-' || ok ELSE 'PO-' || ok END AS po_number,
 CASE pk % 4 WHEN 1 THEN '$' || {commas('c')} WHEN 2 THEN {commas('c')} WHEN 3 THEN 'USD ' || {commas('c')}
  ELSE {plain('c')} END AS amount,
 CASE WHEN pk % 7 = 0 THEN NULL ELSE {plain('tc')} END AS tax,
 CASE WHEN pk % 17 = 0 THEN '' ELSE q::VARCHAR END AS quantity,
 CASE WHEN ok % 13 = 0 THEN 'GBP' WHEN pk % 8 = 0 THEN ' ' || lower(cur) || ' ' ELSE cur END AS currency,
 CASE ok % 3 WHEN 1 THEN strftime(ship, '%d/%m/%Y') WHEN 2 THEN strftime(ship, '%m/%d/%Y')
  ELSE strftime(ship, '%Y-%m-%d') END AS date,
 ship AS invoice_date,
 CASE WHEN pk % 5 = 0 OR c IS NULL THEN NULL ELSE i1 / 100.0 + i2 / 100.0 END AS items,
 i1, i2, c FROM base""",
    ),
    "keyed": (
        ("inv",),
        f"""SELECT *, {key('po_number')} AS pokey, {money('amount')} AS amt, {key('currency')} AS curr,
 {number('tax')} AS taxn, {number('quantity')} AS qty FROM inv""",
    ),
    # Best order line per invoice: smallest gap, then the earlier row.
    "num": (
        ("keyed", "po"),
        """SELECT k.*, p.rid AS po_rid, p.po_number AS po_no, p.amount AS po_amt, nullif(p.currency, '') AS po_cur,
 p.quantity AS po_qty FROM keyed k LEFT JOIN (
 SELECT k2.rid AS irid, p2.*, row_number() OVER (PARTITION BY k2.rid
  ORDER BY abs(k2.amt - p2.amount) ASC NULLS LAST, p2.rid) AS rn
 FROM keyed k2 JOIN po p2 ON k2.pokey = p2.po_number) p ON p.irid = k.rid AND p.rn = 1""",
    ),
    "matched": (
        ("num",),
        f"""SELECT *, CASE WHEN po_rid IS NULL THEN 'no_po_match' WHEN cstat = 'mismatch' THEN 'currency_mismatch'
 WHEN pct > 0.02 THEN 'amount_mismatch' ELSE 'matched' END AS status FROM (
 SELECT *, CASE WHEN {_HIT} THEN CASE WHEN {_BOTH} THEN abs(amt - po_amt) ELSE 0 END END AS gap,
 CASE WHEN {_HIT} THEN CASE WHEN {_BOTH} THEN {half_up('(abs(amt - po_amt) * 100)', '(po_amt * 100)', 4)} ELSE 0.0 END END AS pct,
 CASE WHEN {_HIT} THEN NOT coalesce({_BOTH}, false) END AS unknown,
 CASE WHEN po_rid IS NULL THEN NULL WHEN curr IS NULL OR po_cur IS NULL THEN 'unknown'
  WHEN curr = po_cur THEN 'ok' ELSE 'mismatch' END AS cstat FROM num)""",
    ),
    "receipt": (
        ("line",),
        f"""SELECT 'po-' || ok AS po_number, {plain('part')} AS quantity FROM (
 SELECT ok, unnest([h * 6 // 10, h - h * 6 // 10]) AS part FROM (
 SELECT ok, CASE WHEN ok % 9 = 0 THEN q * 90 ELSE q * 100 END AS h FROM line WHERE ok % 7 <> 0))""",
    ),
    "received": (
        ("receipt",),
        f"""SELECT {key('po_number')} AS pokey, sum({number('quantity')}::DECIMAL(18,4))::DOUBLE AS received
 FROM receipt GROUP BY 1""",
    ),
    "contract": (
        ("line",),
        f"""SELECT lpad(sk::VARCHAR, 8, '0') || '-' || k AS rid, vendor_name, {plain('v')} AS unit_price FROM (
 SELECT *, CASE WHEN k = 1 THEN u * 110 // 100 ELSE u END AS v FROM (
 SELECT *, unnest(CASE WHEN sk % 4 = 0 THEN [0, 1] ELSE [0] END) AS k FROM (
 SELECT sk, concat_ws(' ', w1, w2, w3, lf) AS vendor_name, ((sum(pc) + sum(q) // 2) // sum(q))::BIGINT AS u
 FROM line GROUP BY ALL)))""",
    ),
    "price": (
        ("contract",),
        f"""SELECT {key_a('vendor_name')} AS vkey, arg_max({number('unit_price')}, rid) AS price FROM contract GROUP BY 1""",
    ),
    "wide": (
        ("matched", "received", "price"),
        f"""SELECT m.*, r.received, c.price FROM matched m LEFT JOIN received r ON r.pokey = m.po_no
 LEFT JOIN price c ON c.vkey = {key_a('m.vendor_name')}""",
    ),
    "dup": (
        ("inv",),
        """SELECT rid || '-' || k AS rid, CASE WHEN k >= 2 THEN 'R' || k || '-' || invoice_number ELSE invoice_number END AS invoice_number,
 vendor_name, po_number, amount, tax, quantity, currency, date, invoice_date + (CASE k WHEN 2 THEN 3 WHEN 3 THEN 8 ELSE 0 END)::INT AS invoice_date
 FROM (SELECT *, unnest(CASE WHEN ok % 17 = 0 AND ok % 19 <> 0 AND ok % 29 <> 0 THEN [0, 1]
  WHEN ok % 19 = 0 AND ok % 17 <> 0 AND ok % 29 <> 0 THEN [0, 2]
  WHEN ok % 29 = 0 AND ok % 17 <> 0 AND ok % 19 <> 0 THEN [0, 3] ELSE [0] END) AS k FROM inv)""",
    ),
    "hashed": (
        ("dup",),
        f"""SELECT *, md5(to_json(struct_pack(amount := amount, currency := currency, date := date,
 invoice_date := {date('invoice_date')}, invoice_number := invoice_number, po_number := po_number, quantity := quantity,
 tax := tax, vendor_name := vendor_name))::VARCHAR) AS h FROM dup""",
    ),
    "duplines": (
        ("hashed",),
        """SELECT upper(invoice_number) AS invoice_key, h AS line_key, count(*) AS copies, min(rid) AS first_row_id
 FROM hashed GROUP BY ALL HAVING count(*) > 1""",
    ),
    "near": (
        ("dup",),
        f"""SELECT rid, {key_b('vendor_name')} AS vendor_key, {money('amount')} AS bucket_amount,
 coalesce({key('currency')}, '__NOCURRENCY__') AS bucket_currency, (invoice_date - DATE '1970-01-01')::INT AS day
 FROM dup WHERE {money('amount')} IS NOT NULL""",
    ),
    "pairs": (
        ("near",),
        """SELECT a.rid AS a_rid, b.rid AS b_rid, a.vendor_key, a.bucket_amount, a.bucket_currency, b.day - a.day AS days
 FROM near a JOIN near b USING (vendor_key, bucket_amount, bucket_currency)
 WHERE (a.day, a.rid) < (b.day, b.rid) AND b.day - a.day <= 7""",
    ),
    # Findings of the repeated-line invoices against orders, receipts and contracts.
    "dkeyed": (
        ("hashed",),
        f"""SELECT *, {key('po_number')} AS pokey, {money('amount')} AS amt, {key('currency')} AS curr,
 {number('quantity')} AS qty FROM hashed""",
    ),
    "dnum": (
        ("dkeyed", "po"),
        """SELECT k.*, p.rid AS po_rid, p.po_number AS po_no, p.amount AS po_amt, nullif(p.currency, '') AS po_cur
 FROM dkeyed k LEFT JOIN (
 SELECT k2.rid AS irid, p2.*, row_number() OVER (PARTITION BY k2.rid
  ORDER BY abs(k2.amt - p2.amount) ASC NULLS LAST, p2.rid) AS rn
 FROM dkeyed k2 JOIN po p2 ON k2.pokey = p2.po_number) p ON p.irid = k.rid AND p.rn = 1""",
    ),
    "dmatched": (
        ("dnum", "received", "price"),
        f"""SELECT m.*, r.received, c.price, CASE WHEN po_rid IS NULL THEN 'no_po_match' WHEN cstat = 'mismatch' THEN 'currency_mismatch'
 WHEN pct > 0.02 THEN 'amount_mismatch' ELSE 'matched' END AS status FROM (
 SELECT *, CASE WHEN {_HIT} THEN CASE WHEN {_BOTH} THEN abs(amt - po_amt) ELSE 0 END END AS gap,
 CASE WHEN {_HIT} THEN CASE WHEN {_BOTH} THEN {half_up('(abs(amt - po_amt) * 100)', '(po_amt * 100)', 4)} ELSE 0.0 END END AS pct,
 CASE WHEN po_rid IS NULL THEN NULL WHEN curr IS NULL OR po_cur IS NULL THEN 'unknown'
  WHEN curr = po_cur THEN 'ok' ELSE 'mismatch' END AS cstat FROM dnum) m
 LEFT JOIN received r ON r.pokey = m.po_no LEFT JOIN price c ON c.vkey = {key_a('m.vendor_name')}""",
    ),
    "finding": (
        ("dmatched", "duplines"),
        f"""SELECT row_number() OVER (ORDER BY check_order = 9, inv_rid, check_order, group_key) - 1 AS finding_id, * FROM (
 SELECT rid AS inv_rid, invoice_number, vendor_name, amt, curr, status AS finding_type, 0 AS check_order,
  CASE WHEN amt >= 10000 OR status <> 'amount_mismatch' THEN 'High' ELSE 'Medium' END AS severity,
  CASE WHEN status = 'amount_mismatch' THEN pct END AS diff_pct, NULL AS group_key, 1 AS group_rows FROM dmatched WHERE status <> 'matched'
 UNION ALL SELECT rid, invoice_number, vendor_name, amt, curr, 'no_goods_receipt', 2, {severity('Medium', 'amt')}, NULL, NULL, 1
  FROM dmatched WHERE po_rid IS NOT NULL AND qty IS NOT NULL AND received IS NULL
 UNION ALL SELECT rid, invoice_number, vendor_name, amt, curr, 'quantity_mismatch', 2, {severity('Medium', 'amt')}, abs(qty - received) / received, NULL, 1
  FROM dmatched WHERE po_rid IS NOT NULL AND qty IS NOT NULL AND received > 0 AND abs(qty - received) * 100 > received * 5
 UNION ALL SELECT rid, invoice_number, vendor_name, amt, curr, 'contract_price_variance', 3, {severity('Medium', 'amt')},
  abs(amt::DOUBLE / qty - price) / price, NULL, 1
  FROM dmatched WHERE qty <> 0 AND amt <> 0 AND price > 0 AND abs(amt::DOUBLE - price * qty) * 100 > price * abs(qty) * 3
 UNION ALL SELECT first_row_id, invoice_key, NULL, NULL, NULL, 'duplicate_invoice', 9, 'High', NULL, line_key, copies FROM duplines)""",
    ),
    "queue": (
        ("finding",),
        "SELECT *, finding_id % 5 = 0 AS answered FROM finding",
    ),
    "dirty": (
        (),
        f"""SELECT lpad(k::VARCHAR, 10, '0') || '-' || copy AS rid,
 {_word(("o'connor trading", "  smith-jones  ", "McDONALD", "ibm llc", "macleod & sons", "élan  vital", "PLAIN name", ""), 'k % 8')} AS name,
 {_word(("2024-02-29", "31/02/2025", "29/02/2023", "29/02/2024", "05/06/2024", "13/02/2024", "02/13/2024", "1-2-2023", "not a date", "", "2024/01/05"), 'k % 11')} AS date,
 CASE k % 7 WHEN 1 THEN '12abc' WHEN 2 THEN 'abc' WHEN 4 THEN '-' WHEN 5 THEN '' ELSE ((c / 100.0)::DECIMAL(18,2))::VARCHAR END AS amount,
 CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '  ' ELSE segment END AS segment, k::VARCHAR AS code, k
 FROM (SELECT *, unnest(CASE WHEN k % 10 = 3 THEN [0, 1] ELSE [0] END) AS copy FROM (
 SELECT c_custkey AS k, c_mktsegment AS segment, round(c_acctbal * 100)::BIGINT AS c FROM customer))""",
    ),
    "doc_text": (
        ("base",),
        f"""SELECT rid AS doc_id, ok, pk, sk, c, tc, ship, w1, w2, w3, lf,
 (CASE WHEN pk % 6 = 5 THEN 'Scan page 1' ELSE 'Invoice No: INV-' || ok || '/' || sk END) || chr(10) ||
 'Vendor: ' || concat_ws(' ', w1, w2, w3, lf) || chr(10) ||
 (CASE ok % 4 WHEN 0 THEN 'Invoice Date: ' || strftime(ship, '%d/%m/%Y') WHEN 1 THEN 'Date: ' || strftime(ship, '%Y-%m-%d')
  WHEN 2 THEN 'Date: ' || day(ship) || strftime(ship, ' %B %Y') ELSE 'Terms: net 30' END) || chr(10) ||
 (CASE WHEN ok % 11 = 0 THEN 'Remarks: none' ELSE 'PO No: PO-' || ok END) || chr(10) ||
 (CASE WHEN c IS NULL THEN 'Paid in full' ELSE 'Sub-items $' || {plain('tc')} || chr(10) || 'VAT: ' || {plain('tc')} || chr(10) ||
  (CASE WHEN pk % 3 = 0 THEN 'Total: $' ELSE 'Grand Total: $' END) || {commas('c')} END) || chr(10) ||
 (CASE WHEN ok % 5 = 0 THEN 'Currency: AUD' ELSE 'Thank you' END) AS text FROM base""",
    ),
    "command": (
        (),
        f"""SELECT event_id AS command_id, user_id,
 replace(replace({_word(COMMANDS, 'event_id % 12')}, '{{a}}', (user_id + 1)::VARCHAR), '{{b}}', (user_id + 1 + event_id % 40)::VARCHAR) AS command,
 event_id % 90 AS resolved, CASE WHEN event_id % 25 = 0 THEN 0 ELSE 120 END AS total FROM events""",
    ),
    "webhook": (
        (),
        f"""SELECT event_id, user_id, ts + h * INTERVAL 1 HOUR AS ts, CASE raw {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in SUBSCRIPTION_KINDS.items())} END AS event_type,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'plan-' || (event_id % 4) END AS plan,
 CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'trialing' END AS status,
 strftime(ts, '%Y-%m-%d') AS renews_at, 'sub-' || user_id || '-' || event_id AS subscription_id,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS canceled_at, h
 FROM (SELECT event_id, user_id, ts, event_type AS raw, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1, 96] WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS h FROM events)""",
    ),
    "logbody": (
        (),
        """SELECT strftime(ts, '%Y-%m-%d') AS log_date, user_id, event_id,
 row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY event_id) AS line_no,
 '{"time":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","event":"' || upper(event_type) || '","userId":' || user_id || '}' AS body FROM events""",
    ),
}


def with_(names: str | tuple[str, ...], query: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in (names,) if isinstance(names, str) else names:
        visit(n)
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {body}\n{query}"
