"""Queries on event streams (batch form), audit tables, hash chains and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import audit as A
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import with_
from ledgerloom.plans.fixtures import fx_audit, fx_webhook, table
from ledgerloom.session import Scratch
from ledgerloom.sources import files
from ledgerloom.streaming import approvals, events as E

_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("event_dedup", with_("webhook", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM webhook WHERE h <> 1"))
def event_dedup(spark, sf):
    return E.first_sightings(fx_webhook(spark, sf)).select("event_id", F.date_format("ts", _TS).alias("ts"))


@query(
    "event_age",
    """SELECT verdict, count(*) AS events FROM (SELECT CASE WHEN event_id % 500 - 60 > 300 THEN 'too_old' WHEN event_id % 500 - 60 < -30 THEN 'in_future' ELSE 'ok' END AS verdict FROM events) GROUP BY 1""",
)
def event_age(spark, sf):
    seen = F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 500 - 60)")
    verdict = E.age_verdict(F.col("ts"), seen).alias("verdict")
    return table(spark, sf, "events").groupBy(verdict).agg(F.count(F.lit(1)).alias("events"))


for _name, (_window, _limit) in {"request_limits": ("1 hour", 2), "request_limits_short": ("15 minutes", 1)}.items():
    query(
        _name,
        f"""SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) - {_limit} AS refused
 FROM (SELECT user_id, time_bucket(INTERVAL '{_window}', ts) AS w FROM events) GROUP BY user_id, w HAVING count(*) > {_limit}""",
    )(
        lambda spark, sf, w=_window, n=_limit: E.over_limit(table(spark, sf, "events"), "user_id", "ts", w, n).withColumn(
            "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
        )
    )


# All events inside one hour, so that the stated limits are passed.
for _kind in ("auth", "upload"):
    _window, _limit = {"auth": ("15 minutes", 10), "upload": ("1 hour", 50)}[_kind]
    query(
        f"request_limit_{_kind}",
        f"""SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) - {_limit} AS refused
 FROM (SELECT user_id, time_bucket(INTERVAL '{_window}', make_timestamp((1704067200 + event_id % 3600) * 1000000)) AS w FROM events)
 GROUP BY user_id, w HAVING count(*) > {_limit}""",
    )(
        lambda spark, sf, k=_kind: E.over_request_limit(
            table(spark, sf, "events").selectExpr("user_id", "timestamp_seconds(1704067200 + event_id % 3600) as ts"), k
        ).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    )


@query(
    "subscription_state",
    with_(
        "webhook",
        """, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM webhook WHERE event_type <> 'transaction.completed'),
v AS (SELECT user_id, max(k) FILTER (event_type IN ('subscription.activated', 'subscription.canceled')) AS ka,
 max(k) FILTER (event_type = 'subscription.activated' OR (event_type = 'subscription.updated' AND plan IS NOT NULL)) AS kp, max(k) AS ks,
 max(k) FILTER (event_type IN ('subscription.activated', 'subscription.updated')) AS kr, max(k) FILTER (event_type = 'subscription.activated') AS ki FROM e GROUP BY 1)
SELECT v.user_id, a.event_type <> 'subscription.canceled' AS active, p.plan, CASE s.event_type WHEN 'subscription.canceled' THEN 'canceled' WHEN 'subscription.past_due' THEN 'past_due' ELSE s.status END AS status,
 r.renews_at, i.subscription_id, CASE WHEN a.event_type = 'subscription.canceled' THEN a.canceled_at END AS canceled_at
FROM v LEFT JOIN e a ON a.user_id = v.user_id AND a.k = ka LEFT JOIN e p ON p.user_id = v.user_id AND p.k = kp LEFT JOIN e s ON s.user_id = v.user_id AND s.k = ks
LEFT JOIN e r ON r.user_id = v.user_id AND r.k = kr LEFT JOIN e i ON i.user_id = v.user_id AND i.k = ki""",
    ).replace("\n, e AS", ",\ne AS"),
)
def subscription_state(spark, sf):
    return E.subscription_state(fx_webhook(spark, sf), order=["ts", "event_id"])


@query(
    "approval_outcomes",
    """WITH RECURSIVE acts AS MATERIALIZED (SELECT event_id // 6 AS item, event_id AS action_id, event_id * 9 AS t, 'u' || (user_id % 2) AS actor,
 (['lock', 'lock', 'renew', 'release', 'approve', 'reject', 'lock'])[(event_id % 7 + 1)::INT] AS action,
 row_number() OVER (PARTITION BY event_id // 6 ORDER BY event_id) AS k FROM events),
walk AS (SELECT DISTINCT item, 0::BIGINT AS k, NULL::BIGINT AS action_id, NULL::VARCHAR AS action, NULL::VARCHAR AS actor, NULL::VARCHAR AS outcome,
  'pending' AS status, NULL::VARCHAR AS owner, NULL::BIGINT AS until FROM acts
 UNION ALL SELECT item, k, action_id, action, actor, outcome,
  CASE outcome WHEN 'locked' THEN 'locked' WHEN 'released' THEN 'pending' WHEN 'approved' THEN 'approved' WHEN 'rejected' THEN 'rejected' ELSE status END,
  CASE WHEN outcome IN ('locked', 'renewed') THEN actor WHEN outcome IN ('released', 'approved', 'rejected') THEN NULL ELSE owner END,
  CASE WHEN outcome IN ('locked', 'renewed') THEN t + 30 WHEN outcome IN ('released', 'approved', 'rejected') THEN NULL ELSE until END
 FROM (SELECT a.*, w.status, w.owner, w.until, CASE
  WHEN a.action = 'lock' AND w.status IN ('approved', 'rejected') THEN 'already_resolved'
  WHEN a.action IN ('lock', 'approve') AND w.status = 'locked' AND w.owner <> a.actor AND w.until >= a.t THEN 'locked_by_other'
  WHEN a.action = 'lock' THEN 'locked'
  WHEN a.action IN ('renew', 'release') AND w.status = 'locked' AND w.owner = a.actor THEN CASE a.action WHEN 'renew' THEN 'renewed' ELSE 'released' END
  WHEN a.action = 'renew' THEN 'not_held' WHEN a.action = 'release' THEN 'ignored'
  WHEN w.status IN ('approved', 'rejected') THEN 'already_resolved'
  WHEN a.action = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome
  FROM walk w JOIN acts a ON a.item = w.item AND a.k = w.k + 1))
SELECT item AS approval_id, action_id, action, actor, outcome, status FROM walk WHERE k > 0""",
)
def approval_outcomes(spark, sf):
    actions = table(spark, sf, "events").selectExpr(
        "event_id div 6 as approval_id", "event_id as action_id", "timestamp_seconds(1704067200 + event_id * 9) as ts",
        "element_at(array('lock', 'lock', 'renew', 'release', 'approve', 'reject', 'lock'), cast(event_id % 7 as int) + 1) as action",
        "concat('u', user_id % 2) as actor",
    )
    return approvals.approval_outcomes(actions)


# --- audit ------------------------------------------------------------------


def _audit(spark, sf):
    ev = table(spark, sf, "events")
    kinds = F.element_at(F.array(*[F.lit(a) for a in A.AUDIT_ACTIONS]), (F.col("event_id") % 8).cast("int") + 1)
    return A.audit_rows(
        ev, kinds, timestamp=F.col("ts"), job_id=F.concat(F.lit("job-"), (F.col("user_id") % 3).cast("string")),
        user_id=F.col("user_id"), issue_type=F.col("event_type"), execution_result=F.col("event_id"),
    )


@query(
    "audit_approvals",
    """SELECT strftime(ts, '%Y-%m-%d') AS log_date, CASE event_id % 3 WHEN 0 THEN 'ITEM_APPROVED' ELSE 'ITEM_REJECTED' END AS action, 'job-1' AS job_id,
 user_id::VARCHAR AS user_id, event_type AS issue_type, '{"response":"r' || (event_id % 5) || '"}' AS new_value,
 CASE WHEN event_id % 2 = 0 THEN 'dashboard' ELSE 'voice' END AS responded_via,
 CASE event_id % 3 WHEN 0 THEN 'approved' ELSE 'rejected' END || ' — r' || (event_id % 5) AS execution_result FROM events WHERE event_id % 3 < 2""",
)
def audit_approvals(spark, sf):
    """Audit rows of resolved approvals, appended to a table by day and read back."""
    approvals = table(spark, sf, "events").selectExpr(
        "ts", "user_id", "event_type as finding_type", "element_at(array('approved', 'rejected', 'pending'), cast(event_id % 3 as int) + 1) as status",
        "concat('r', event_id % 5) as response", "case when event_id % 2 = 0 then null else 'voice' end as responded_via",
    )
    folder = Scratch(spark).path("audit")
    A.append_audit(A.approval_events(approvals, F.lit("job-1"), F.col("user_id"), F.col("ts")), folder)
    return spark.read.parquet(folder).select(
        F.date_format("log_date", "yyyy-MM-dd").alias("log_date"), "action", "job_id", F.col("user_id").cast("string").alias("user_id"),
        "issue_type", "new_value", "responded_via", "execution_result",
    )


_ACTIONS = "(['" + "', '".join(A.AUDIT_ACTIONS) + "'])[(event_id % 8 + 1)::INT]"


@query(
    "audit_export",
    f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, 'job-' || (user_id % 3) AS job_id, {_ACTIONS} AS action, user_id::VARCHAR AS user_id, event_type AS issue_type,
 NULL AS execution_step, NULL AS responded_via, event_id::VARCHAR AS execution_result, NULL AS explanation FROM events""",
)
def audit_export(spark, sf):
    return A.audit_export(_audit(spark, sf)).withColumn("timestamp", F.date_format("timestamp", _TS))


@query(
    "audit_newest",
    """SELECT job_id, execution_result FROM (SELECT 'job-' || (user_id % 3) AS job_id, event_id::VARCHAR AS execution_result,
 row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2000""",
)
def audit_newest(spark, sf):
    order = [F.col("timestamp").desc(), F.col("execution_result").cast("long").desc()]
    return A.newest_events(_audit(spark, sf), "job_id", order).select("job_id", "execution_result")


@query(
    "retention",
    """SELECT event_id FROM events WHERE ts::DATE < DATE '2024-04-15' - 90""",
)
def retention(spark, sf):
    ev = table(spark, sf, "events").withColumn("log_date", F.to_date("ts"))
    return A.expired(ev, F.to_date(F.lit("2024-04-15")), 90).select("event_id")


def _chain(select: str) -> str:
    head = with_("logbody", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return (
        head
        + r""",
chain AS (SELECT log_date, user_id, line_no, repeat('0', 64) AS prev, left(body, -1) || ',"prevHash":"' || repeat('0', 64) || '"' AS head,
 sha256(repeat('0', 64) || left(body, -1) || ',"prevHash":"' || repeat('0', 64) || '"}') AS hash FROM logbody WHERE line_no = 1
 UNION ALL SELECT b.log_date, b.user_id, b.line_no, c.hash, left(b.body, -1) || ',"prevHash":"' || c.hash || '"',
 sha256(c.hash || left(b.body, -1) || ',"prevHash":"' || c.hash || '"}') FROM chain c JOIN logbody b ON b.log_date = c.log_date AND b.user_id = c.user_id AND b.line_no = c.line_no + 1)
"""
        + select
    )


@query("hash_chain_build", _chain("""SELECT log_date, user_id, line_no, head || ',"hash":"' || hash || '"}' AS line FROM chain"""))
def hash_chain_build(spark, sf):
    return A.build_chain(fx_audit(spark, sf), ["log_date", "user_id"], "event_id", "body")


def _tampered(spark, sf):
    """The built log with one line of some chains altered after the fact."""
    lines = hash_chain_build(spark, sf)
    spoil = (F.col("user_id") % 20 == 3) & (F.col("line_no") == 2)
    return lines.withColumn("line", F.when(spoil, F.regexp_replace("line", '"event":"[A-Z]+"', '"event":"FORGED"')).otherwise(F.col("line")))


@query(
    "hash_chain_verify",
    with_(
        "logbody",
        """SELECT log_date, user_id, count(*) AS total_lines, NOT bool_or(bad) AS valid, CASE WHEN bool_or(bad) THEN 2 END AS broken_at_line,
 CASE WHEN bool_or(bad) THEN 'edited' END AS problem FROM (SELECT *, user_id % 20 = 3 AND line_no = 2 AS bad FROM logbody) GROUP BY ALL""",
    ),
)
def hash_chain_verify(spark, sf):
    return A.verify_chain(_tampered(spark, sf), ["log_date", "user_id"])


# --- archives ---------------------------------------------------------------

def _manifest(spark, sf):
    names = F.array(
        F.lit("a/b/{}.csv"), F.lit("../{}.xlsx"), F.lit("C:\\docs\\{}.xml"), F.lit("run{}.exe"), F.lit("x/{}.zip"), F.lit("/"), F.lit("notes {}.txt"), F.lit("big{}.csv"),
    )
    name = F.replace(F.element_at(names, (F.col("doc_id") % 8).cast("int") + 1), F.lit("{}"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        (F.col("doc_id") % 3).cast("string").alias("archive_id"),
        F.floor(F.col("doc_id") / 3).alias("entry_no"),
        name.alias("name"),
        F.greatest(F.lit(1), F.floor(F.col("n_chars") * 1000 / (F.col("doc_id") % 130 + 1))).cast("long").alias("compressed_size"),
        (F.col("n_chars") * F.when(F.col("doc_id") % 3 == 1, 9000).otherwise(1000)).alias("file_size"),
        F.lit(False).alias("encrypted"),
    )


@query(
    "archive_verdicts",
    r"""WITH m AS (SELECT (doc_id % 3)::VARCHAR AS archive_id, doc_id // 3 AS entry_no, doc_id % 8 AS k, doc_id,
 greatest(1, floor(n_chars * 1000 / (doc_id % 130 + 1)))::BIGINT AS comp, n_chars * CASE WHEN doc_id % 3 = 1 THEN 9000 ELSE 1000 END AS file_size FROM documents),
c AS (SELECT *, CASE k WHEN 0 THEN 'a/b/' || doc_id || '.csv' WHEN 1 THEN doc_id || '.xlsx' WHEN 2 THEN 'docs/' || doc_id || '.xml' WHEN 3 THEN 'run' || doc_id || '.exe'
 WHEN 4 THEN 'x/' || doc_id || '.zip' WHEN 5 THEN '' WHEN 6 THEN 'notes ' || doc_id || '.txt' ELSE 'big' || doc_id || '.csv' END AS safe_name,
 CASE WHEN k = 5 THEN 'unsafe_path' WHEN k = 3 THEN 'dangerous_extension' WHEN k = 4 THEN 'nested_archive' WHEN file_size::DOUBLE / comp > 100 THEN 'compression_ratio'
 WHEN file_size > 524288000 THEN 'exceeds_size' END AS early FROM m),
r AS (SELECT *, coalesce(sum(CASE WHEN early IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY archive_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 sum(CASE WHEN early IS NULL THEN file_size ELSE 0 END) OVER (PARTITION BY archive_id ORDER BY entry_no) AS bytes FROM c)
SELECT archive_id, entry_no, safe_name, file_size, CASE WHEN before >= 200 OR bytes > 524288000 THEN 'not_reached' ELSE coalesce(early, 'extracted') END AS verdict FROM r""",
)
def archive_verdicts(spark, sf):
    return files.archive_verdicts(_manifest(spark, sf))

