"""Queries on rules, decisions, payable rows and selections over the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import decisions as X
from ledgerloom.operators import selections as L
from ledgerloom.operators.decisions import Rule
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import with_
from ledgerloom.plans.fixtures import fx_commands, fx_invoice_dup, table
from ledgerloom.plans.queries_match import dup_run
from ledgerloom.plans.reconcile import FINDING_ORDER, number_findings

RULES = [
    Rule("r1", "amount_under", 2000, applies_to=["amount_mismatch", "quantity_mismatch"]),
    Rule("r2", "amount_under", 90000, applies_to=["amount_mismatch"], enabled=False),
    Rule("r3", "variance_under_pct", 4, applies_to=["amount_mismatch", "contract_price_variance"]),
    Rule("r4", "vendor_in", vendors=["Acme Trading North Ltd", " falcon metals north inc "], applies_to=["no_po_match", "amount_mismatch"]),
    Rule("r5", "variance_under_pct", 40, applies_to=["quantity_mismatch", "contract_price_variance"]),
]
_RULE = """CASE WHEN finding_type = 'duplicate_invoice' THEN NULL
 WHEN finding_type IN ('amount_mismatch', 'quantity_mismatch') AND amt < 2000 THEN 'r1'
 WHEN finding_type IN ('amount_mismatch', 'contract_price_variance') AND diff_pct * 100 < 4 THEN 'r3'
 WHEN finding_type IN ('no_po_match', 'amount_mismatch') AND lower(trim(vendor_name)) IN ('acme trading north ltd', 'falcon metals north inc') THEN 'r4'
 WHEN finding_type IN ('quantity_mismatch', 'contract_price_variance') AND diff_pct * 100 < 40 THEN 'r5' END"""


def findings(spark, sf, *columns):
    """The numbered queue; with ``columns`` only these besides the ones of its order."""
    queued = dup_run(spark, sf).queue
    return number_findings(queued.select(*FINDING_ORDER, *columns) if columns else queued)


def queue(spark, sf, *columns):
    return findings(spark, sf, *columns).withColumn("answered", F.col("finding_id") % 5 == 0)


@query("auto_rules", with_("finding", f"SELECT * FROM (SELECT inv_rid, finding_type, {_RULE} AS rule_id FROM finding) WHERE rule_id IS NOT NULL"))
def auto_rules(spark, sf):
    return (
        dup_run(spark, sf).queue.withColumn("rule_id", X.matching_rule(RULES))
        .filter("rule_id is not null")
        .select(F.col("inv_row_id").alias("inv_rid"), "finding_type", "rule_id")
    )


@query(
    "auto_rules_strict",
    with_(
        "finding",
        f"""SELECT rule_id, count(*) AS findings FROM (SELECT {_RULE.replace('diff_pct', "(CASE WHEN finding_type = 'amount_mismatch' THEN diff_pct END)")} AS rule_id FROM finding)
 WHERE rule_id IS NOT NULL GROUP BY 1""",
    ),
)
def auto_rules_strict(spark, sf):
    rule = X.matching_rule(RULES, strict_reference=True)
    return dup_run(spark, sf).queue.groupBy(rule.alias("rule_id")).agg(F.count(F.lit(1)).alias("findings")).filter("rule_id is not null")


_FIRST = """CASE finding_type WHEN 'no_po_match' THEN 'Approve for payment' WHEN 'amount_mismatch' THEN 'Approve invoice amount'
 WHEN 'quantity_mismatch' THEN 'Approve as billed' WHEN 'contract_price_variance' THEN 'Approve at invoiced price' END"""


@query(
    "approval_items",
    with_(
        "finding",
        f"""SELECT finding_id, finding_type, CASE WHEN severity = 'High' THEN 'High' ELSE 'Medium' END AS risk, rule_id,
 CASE WHEN rule_id IS NULL THEN 'pending' ELSE 'approved' END AS status, CASE WHEN rule_id IS NOT NULL THEN {_FIRST} END AS response,
 CASE WHEN rule_id IS NOT NULL THEN 'auto_rule' END AS responded_via FROM (SELECT *, {_RULE} AS rule_id FROM finding)""",
    ),
)
def approval_items(spark, sf):
    return X.approval_items(findings(spark, sf, "finding_type", "severity", "vendor_name", "amount", "diff_pct"), RULES)


# --- decisions --------------------------------------------------------------

_STATUS = "CASE finding_id % 6 WHEN 1 THEN 'rejected' WHEN 5 THEN 'pending' ELSE 'approved' END"
_RESPONSE = """CASE finding_id % 6 WHEN 0 THEN 'Approve for payment' WHEN 1 THEN 'Not ours' WHEN 2 THEN 'Hold for review'
 WHEN 3 THEN 'Hold all for manual review' WHEN 4 THEN 'Keep all (each is a separate transaction)' END"""


def answers(found):
    return found.select(
        "finding_id", F.expr(_STATUS).alias("status"), F.expr(_RESPONSE).alias("response"),
        F.expr("case when finding_id % 6 = 5 then null else 'dashboard' end").alias("responded_via"),
    )


_OUT = """SELECT rid, 'matched' AS status, 'po_number' AS match_type, NULL AS flag, NULL AS response, NULL AS via FROM dmatched WHERE status = 'matched'
 UNION ALL SELECT inv_rid, CASE WHEN status = 'approved' THEN 'approved_with_flag' ELSE 'held' END, NULL, finding_type, response, via FROM ans
  WHERE finding_type <> 'duplicate_invoice' AND NOT (contains(lower(response), 'reject') OR contains(lower(response), 'hold')) {drop}
 UNION ALL SELECT h.rid, CASE WHEN outcome = 'all' THEN 'duplicate_kept' ELSE 'duplicate_first_kept' END, NULL, NULL, response, NULL
  FROM (SELECT *, {outcome} AS outcome FROM ans WHERE finding_type = 'duplicate_invoice' {drop}) a JOIN hashed h ON h.h = a.group_key
  WHERE outcome = 'all' OR (outcome = 'first' AND h.rid = a.inv_rid)"""
_HOLD = "CASE WHEN contains(lower(response), 'hold') THEN 'none' WHEN contains(lower(response), 'all') THEN 'all' ELSE 'first' END"
_ALLFIRST = "CASE WHEN contains(lower(response), 'all') THEN 'all' WHEN contains(lower(response), 'hold') THEN 'none' ELSE 'first' END"
_ANS = f""",
ans AS (SELECT finding_id, inv_rid, finding_type, group_key, {_STATUS} AS status, coalesce({_RESPONSE}, 'no_response') AS response,
 CASE WHEN finding_id % 6 = 5 THEN 'unknown' ELSE 'dashboard' END AS via FROM finding)
"""


def _decided(query_text: str) -> str:
    return with_("finding", "").rstrip() + _ANS + query_text


def _payable(spark, sf, strict=False):
    run = dup_run(spark, sf, keep=True)
    found = number_findings(run.queue.select(*FINDING_ORDER, "finding_type"))
    return X.apply_decisions(run, found, answers(found), fx_invoice_dup(spark, sf), strict_reference=strict)


def _shown(df):
    return df.select(
        F.col("_row_id").alias("rid"), F.col("_reconciliation_status").alias("status"), F.col("_po_match_type").alias("match_type"),
        F.col("_flag_type").alias("flag"), F.col("_approval_response").alias("response"), F.col("_responded_via").alias("via"),
    )


@query("apply_decisions", _decided(_OUT.format(outcome=_HOLD, drop="AND status <> 'rejected'")))
def apply_decisions(spark, sf):
    return _shown(_payable(spark, sf))


@query("apply_decisions_strict", _decided(_OUT.format(outcome=_ALLFIRST, drop="")))
def apply_decisions_strict(spark, sf):
    return _shown(_payable(spark, sf, strict=True))


@query(
    "execution_report",
    _decided(
        f"SELECT count(*) AS output_rows, (SELECT count(*) FROM dmatched) - count(*) AS excluded_rows FROM ({_OUT.format(outcome=_HOLD, drop=chr(65) + 'ND status <> ' + chr(39) + 'rejected' + chr(39))})"
    ),
)
def execution_report(spark, sf):
    return X.execution_report(_payable(spark, sf), fx_invoice_dup(spark, sf))


@query(
    "bulk_approve",
    with_(
        "finding",
        """SELECT verdict, count(*) AS ids FROM (SELECT CASE WHEN f.finding_id IS NULL THEN 'not_found' WHEN f.finding_id % 4 = 1 THEN 'already_resolved'
 WHEN f.finding_id % 4 = 2 AND f.finding_id % 3 = 0 THEN 'locked_by_other' ELSE 'apply' END AS verdict
 FROM (SELECT DISTINCT l_orderkey * 7 AS id FROM lineitem) i LEFT JOIN finding f ON f.finding_id = i.id) GROUP BY 1""",
    ),
)
def bulk_approve(spark, sf):
    found = findings(spark, sf, "finding_type")
    state = found.select(
        "finding_id",
        F.expr("case finding_id % 4 when 1 then 'approved' when 2 then 'locked' else 'pending' end").alias("status"),
        F.expr("case when finding_id % 3 = 2 then 'ann' else 'bob' end").alias("locked_by"),
        F.expr("case when finding_id % 3 = 1 then timestamp'2024-01-01 00:00:00' else timestamp'2024-01-03 00:00:00' end").alias("locked_until"),
    )
    ids = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 7).alias("finding_id")).distinct()
    return X.verdict_counts(X.bulk_approve(ids, state, "ann", F.to_timestamp(F.lit("2024-01-02 00:00:00"))))


@query(
    "queue_progress",
    with_("finding", "SELECT count(*) AS total, count(*) FILTER (finding_id % 6 <> 5) AS answered, count(*) FILTER (finding_id % 6 = 5) AS pending FROM finding"),
)
def queue_progress(spark, sf):
    return X.queue_progress(answers(findings(spark, sf, "finding_type")))


@query(
    "queue_summary",
    with_(
        "queue",
        """SELECT 'type' AS view, finding_type AS label, count(*) AS items, count(*) FILTER (answered) AS answered_items, coalesce(sum(amt), 0)::DOUBLE AS amount FROM queue GROUP BY 2
 UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (answered), coalesce(sum(amt), 0)::DOUBLE FROM queue GROUP BY 2
 UNION ALL SELECT 'total', 'all', count(*), count(*) FILTER (answered), coalesce(sum(amt), 0)::DOUBLE FROM queue
 UNION ALL SELECT * FROM (SELECT 'vendor', coalesce(vendor_name, 'Unknown Vendor') AS v, count(*) AS n, count(*) FILTER (answered), coalesce(sum(amt), 0)::DOUBLE FROM queue GROUP BY 2 ORDER BY n DESC, v LIMIT 10)""",
    ),
)
def queue_summary(spark, sf):
    return X.queue_summary(queue(spark, sf, "finding_type", "severity", "vendor_name", "amount"))


@query(
    "top_vendors",
    with_("finding", "SELECT coalesce(vendor_name, 'Unknown Vendor') AS vendor_name, count(*) AS items FROM finding GROUP BY 1 ORDER BY items DESC, vendor_name LIMIT 10"),
)
def top_vendors(spark, sf):
    return X.top_vendors(dup_run(spark, sf).queue)


@query("newest_page", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def newest_page(spark, sf):
    return X.newest_page(table(spark, sf, "events"), "ts", "event_id", 50, 25).select("event_id", "user_id")


@query("deep_page", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 40 OFFSET (SELECT count(*) * 7 // 10 FROM events)")
def deep_page(spark, sf):
    events = table(spark, sf, "events")
    return X.newest_page(events, "ts", "event_id", events.count() * 7 // 10, 40).select("event_id", "user_id")


@query("warning_counts", "SELECT event_type AS message, count(*) AS times FROM events GROUP BY 1")
def warning_counts(spark, sf):
    return X.message_counts(table(spark, sf, "events").select(F.col("event_type").alias("message")))


# --- selections -------------------------------------------------------------


@query(
    "command_parse",
    with_(
        "command",
        """SELECT command_id, verb, scope, s AS start, e AS "end", CASE scope WHEN 'remaining' THEN greatest(0, e - s + 1) WHEN 'single' THEN 1 ELSE coalesce(e - s + 1, 0) END AS picked FROM (
 SELECT *, CASE WHEN scope IN ('range', 'single') THEN greatest(0, a - 1) WHEN scope IN ('count', 'remaining') THEN resolved END AS s,
 CASE scope WHEN 'range' THEN CASE WHEN total > 0 THEN least(total - 1, b - 1) ELSE b - 1 END WHEN 'single' THEN a - 1
  WHEN 'count' THEN CASE WHEN total > 0 THEN least(total - 1, resolved + a - 1) ELSE resolved + a - 1 END
  WHEN 'remaining' THEN CASE WHEN total > 0 THEN total - 1 ELSE 0 END END AS e FROM (
 SELECT command_id, resolved, total, user_id + 1 AS a, user_id + 1 + command_id % 40 AS b,
 CASE command_id % 12 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'request_po' WHEN 3 THEN 'approve' WHEN 4 THEN 'reject' WHEN 5 THEN 'request_po'
  WHEN 6 THEN 'approve' WHEN 7 THEN 'reject' WHEN 8 THEN 'approve' WHEN 9 THEN 'reject' WHEN 10 THEN 'hold' END AS verb,
 CASE command_id % 12 WHEN 0 THEN 'range' WHEN 1 THEN 'range' WHEN 2 THEN 'range' WHEN 3 THEN 'count' WHEN 4 THEN 'count' WHEN 5 THEN 'count'
  WHEN 6 THEN 'single' WHEN 7 THEN 'single' WHEN 8 THEN 'remaining' WHEN 9 THEN 'remaining' WHEN 10 THEN 'range' END AS scope FROM command))""",
    ),
)
def command_parse(spark, sf):
    parsed = L.parse_commands(fx_commands(spark, sf), "command", F.col("total").cast("long"), F.col("resolved").cast("long"))
    return parsed.select("command_id", "verb", "scope", "start", "end", "picked")


def _selections(spark, sf):
    """One selection per user, of every kind; spread over the queue."""
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.selectExpr(
        "user_id as selection_id",
        "element_at(array('range', 'indices', 'count', 'range', 'empty', 'range', 'count'), cast(user_id % 7 as int) + 1) as kind",
        "user_id * 31 as start", "user_id * 31 + user_id % 50 as end", "user_id * 3 + 1 as n",
        "array(user_id, user_id * 2 + 1, user_id * 5 + 2, user_id) as positions",
    )


_SEL = """, sel AS (SELECT DISTINCT user_id AS id, (['range', 'indices', 'count', 'range', 'empty', 'range', 'count'])[(user_id % 7 + 1)::INT] AS kind FROM events),
openq AS MATERIALIZED (SELECT finding_id, row_number() OVER (ORDER BY finding_id) AS k FROM queue WHERE NOT answered),
picked AS MATERIALIZED (SELECT id AS selection_id, finding_id FROM (SELECT id, unnest(range(id * 31, id * 31 + id % 50 + 1)) AS p FROM sel WHERE kind = 'range') JOIN openq ON finding_id = p
 UNION ALL SELECT id, finding_id FROM (SELECT id, unnest(range(1, id * 3 + 2)) AS p FROM sel WHERE kind = 'count') JOIN openq ON k = p
 UNION ALL SELECT DISTINCT id, finding_id FROM (SELECT id, unnest([id, id * 2 + 1, id * 5 + 2]) AS p FROM sel WHERE kind = 'indices') JOIN queue ON finding_id = p)
"""


@query("selection_resolve", with_("queue", "").rstrip() + _SEL + "SELECT * FROM picked")
def selection_resolve(spark, sf):
    return L.resolve_selections(queue(spark, sf), _selections(spark, sf))


@query(
    "selection_remaining",
    with_("queue", "").rstrip() + _SEL + "SELECT finding_id FROM queue ANTI JOIN (SELECT DISTINCT finding_id FROM picked) USING (finding_id) WHERE NOT answered",
)
def selection_remaining(spark, sf):
    return L.unclaimed_items(queue(spark, sf), _selections(spark, sf))


_KINDS = "'range', 'count', 'indices', 'remaining', 'range', 'empty', 'remaining'"


def _wide_selections(spark, sf):
    """One selection per user, of the kinds that may take much of the queue as well; every 500th takes all."""
    return _selections(spark, sf).selectExpr(
        "selection_id",
        f"if(selection_id % 500 = 5, 'all', element_at(array({_KINDS}), cast(selection_id % 7 as int) + 1)) as kind",
        "selection_id * 100 as start", "selection_id * 100 + 900 as end", "1200 as n", "positions",
    )


_WIDE = f""", sel AS (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 500 = 5 THEN 'all' ELSE ([{_KINDS}])[(user_id % 7 + 1)::INT] END AS kind FROM events),
openq AS MATERIALIZED (SELECT finding_id, row_number() OVER (ORDER BY finding_id) AS k FROM queue WHERE NOT answered),
picked AS MATERIALIZED (SELECT id AS selection_id, finding_id FROM (SELECT id, unnest(range(id * 100, id * 100 + 901)) AS p FROM sel WHERE kind = 'range') JOIN openq ON finding_id = p
 UNION ALL SELECT id, finding_id FROM (SELECT id, unnest(range(1, 1201)) AS p FROM sel WHERE kind = 'count') JOIN openq ON k = p
 UNION ALL SELECT id, finding_id FROM sel JOIN openq ON kind = 'all'
 UNION ALL SELECT DISTINCT id, finding_id FROM (SELECT id, unnest([id, id * 2 + 1, id * 5 + 2]) AS p FROM sel WHERE kind = 'indices') JOIN queue ON finding_id = p),
first AS (SELECT min(id) AS m FROM sel WHERE kind = 'remaining'),
taken AS (SELECT DISTINCT finding_id FROM picked, first WHERE selection_id < m)
"""


@query(
    "selection_kinds",
    with_("queue", "").rstrip()
    + _WIDE
    + """SELECT selection_id, finding_id FROM picked
 UNION ALL SELECT m, finding_id FROM openq ANTI JOIN taken USING (finding_id), first WHERE m IS NOT NULL""",
)
def selection_kinds(spark, sf):
    return L.resolve_selections(queue(spark, sf), _wide_selections(spark, sf))


@query(
    "selection_except",
    with_("queue", "SELECT finding_id FROM queue WHERE NOT answered AND finding_id NOT IN (SELECT event_id FROM events)"),
)
def selection_except(spark, sf):
    return L.everything_except(queue(spark, sf), table(spark, sf, "events").select(F.col("event_id").alias("finding_id"))).select("finding_id")


@query(
    "selection_positions",
    """SELECT event_id, s AS start, e AS "end" FROM (SELECT event_id, t, CASE f WHEN 'last' THEN greatest(0, t - a) WHEN 'next' THEN c + 1
 WHEN 'from_to' THEN least(greatest(0, a - 1), least(t - 1, b - 1)) ELSE 0 END AS s,
 CASE f WHEN 'first' THEN least(t, a) - 1 WHEN 'up_to' THEN least(t, a) - 1 WHEN 'last' THEN t - 1 WHEN 'next' THEN least(t, c + 1 + a) - 1
 ELSE greatest(greatest(0, a - 1), least(t - 1, b - 1)) END AS e FROM (
 SELECT event_id, (['first', 'last', 'up_to', 'next', 'from_to'])[(event_id % 5 + 1)::INT] AS f, user_id AS a, event_id % 131 AS b, 100 AS t,
  coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 97 END, -1) AS c FROM events)) WHERE s <= e AND s < t""",
)
def selection_positions(spark, sf):
    ev = table(spark, sf, "events").selectExpr(
        "event_id", "element_at(array('first', 'last', 'up_to', 'next', 'from_to'), cast(event_id % 5 as int) + 1) as f",
        "user_id as a", "event_id % 131 as b", "100L as t", "case when event_id % 3 = 0 then event_id % 97 end as c",
    )
    bounds = L.position_bounds(F.col("f"), F.col("a"), F.col("b"), F.col("t"), F.col("c"))
    return ev.select("event_id", bounds.alias("p")).filter("p is not null").select("event_id", "p.start", "p.end")


@query(
    "selection_filters",
    with_(
        "queue",
        r"""SELECT finding_id FROM queue WHERE NOT answered AND coalesce(amt, 0) <= 30000 AND coalesce(amt, 0) >= 500
 AND regexp_matches(lower(vendor_name), '\b(falcon|paper)\b') AND lower(curr) = 'usd' AND finding_type IN ('amount_mismatch', 'no_po_match')""",
    ),
)
def selection_filters(spark, sf):
    return L.filter_queue(
        queue(spark, sf), max_amount=30000, min_amount=500, vendor_words=["Falcon", "paper", "co"], currency="usd", mismatch=True
    ).select("finding_id")


@query("selection_duplicates", with_("queue", "SELECT finding_id FROM queue WHERE NOT answered AND finding_type = 'duplicate_invoice'"))
def selection_duplicates(spark, sf):
    return L.filter_queue(queue(spark, sf), duplicate=True).select("finding_id")


def _actions(spark, sf):
    """Several actions per command: the users' ranges of one day."""
    return table(spark, sf, "events").selectExpr(
        "user_id as command_id",
        "element_at(array('approve', 'hold', 'reject', 'request_po'), cast(event_id % 4 as int) + 1) as verb",
        "event_id % 400 as start", "event_id % 400 + event_id % 7 as end",
    )


@query(
    "selection_conflicts",
    """WITH act AS (SELECT user_id AS command_id, event_id, (['approve', 'hold', 'reject', 'request_po'])[(event_id % 4 + 1)::INT] AS verb,
 unnest(range(event_id % 400, event_id % 400 + event_id % 7 + 1)) AS p FROM events),
per AS (SELECT command_id, p, verb, count(*) AS n FROM act GROUP BY ALL),
hit AS (SELECT a.command_id, a.verb AS verb_a, b.verb AS verb_b, a.p FROM per a JOIN per b ON a.command_id = b.command_id AND a.p = b.p
 AND (a.verb < b.verb OR (a.verb = b.verb AND a.n >= 2)))
SELECT command_id, verb_a, verb_b, count(*) AS overlap, array_to_string(list_sort(list(p))[1:5], ',') AS sample_positions FROM hit GROUP BY ALL""",
)
def selection_conflicts(spark, sf):
    found = L.conflicts(_actions(spark, sf))
    return found.withColumn("sample_positions", F.array_join(F.col("sample_positions").cast("array<string>"), ","))
