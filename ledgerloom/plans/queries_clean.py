"""Queries on cleaning steps, profiles and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profile as P
from ledgerloom.operators import validate as V
from ledgerloom.operators.cleaning import Step
from ledgerloom.operators.stats import exact_medians
from ledgerloom.plans import steps as S
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import NSP, SP, blank, percent, prefix, trim, with_
from ledgerloom.plans.fixtures import fx_dirty, table


def _out(df):
    return df.withColumnRenamed("_row_id", "rid")


_ALL = "rid, name, date, amount, segment, code"


def _dirty(where: str = "", **change: str) -> str:
    cols = [f"{change[c]} AS {c}" if c in change else c for c in ("rid", "name", "date", "amount", "segment", "code")]
    return with_("dirty", f"SELECT {', '.join(cols)} FROM dirty {where}")


def _clean(name: str, oracle: str, fn):
    query(name, oracle)(lambda spark, sf: _out(fn(fx_dirty(spark, sf))))


_clean("clean_remove_nulls", _dirty(f"WHERE NOT {blank('segment')}"), lambda d: C.remove_nulls(d, "segment"))
_NUM = f"(SELECT {prefix('amount')} AS x FROM dirty) WHERE x IS NOT NULL"
_fill = lambda v: f"CASE WHEN {blank('amount')} THEN regexp_replace(({v})::VARCHAR, '\\.0$', '') ELSE amount END"
_clean(
    "clean_fill_mean",
    _dirty(amount=_fill(f"SELECT floor(sum(x::DECIMAL(28,6))::DOUBLE / count(*) * 100 + 0.5) / 100 FROM {_NUM}")),
    lambda d: C.fill_missing(d, "amount", "mean"),
)
_clean(
    "clean_fill_median",
    _dirty(amount=_fill(f"SELECT CASE WHEN count(*) % 2 = 0 THEN floor(median(x) * 100 + 0.5) / 100 ELSE median(x) END FROM {_NUM}")),
    lambda d: C.fill_missing(d, "amount", "median"),
)
_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
query(
    "column_medians",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count({c}) % 2 = 0 THEN floor(median({c}::DOUBLE) * 100 + 0.5) / 100 ELSE median({c}::DOUBLE) END AS fill, count({c}) AS n FROM lineitem"""
        for c in _MEASURES
    ),
)(lambda spark, sf: exact_medians(table(spark, sf, "lineitem"), list(_MEASURES)))
_clean(
    "clean_fill_mode",
    _dirty(
        segment=f"CASE WHEN {blank('segment')} THEN (SELECT segment FROM (SELECT segment, count(*) AS n, min(rid) AS f FROM dirty "
        f"WHERE NOT {blank('segment')} GROUP BY 1) ORDER BY n DESC, f LIMIT 1) ELSE segment END"
    ),
    lambda d: C.fill_missing(d, "segment", "mode"),
)
_clean("clean_fill_zero", _dirty(amount=f"CASE WHEN {blank('amount')} THEN '0' ELSE amount END"), lambda d: C.fill_missing(d, "amount", "zero"))
_clean("clean_fill_custom", _dirty(segment=f"CASE WHEN {blank('segment')} THEN 'UNKNOWN' ELSE segment END"), lambda d: C.fill_missing(d, "segment", "custom", "UNKNOWN"))
_clean("clean_fill_empty", _dirty(segment=f"CASE WHEN {blank('segment')} THEN '' ELSE segment END"), lambda d: C.fill_missing(d, "segment", "empty_string"))
_clean(
    "clean_dedup_exact",
    with_("dirty", "SELECT min(rid) AS rid, name, date, amount, segment, code FROM dirty GROUP BY ALL"),
    lambda d: C.dedup_exact(d),
)
_clean(
    "clean_dedup_subset",
    with_(
        "dirty",
        f"SELECT {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY name, segment ORDER BY rid) AS rn FROM dirty) WHERE rn = 1",
    ),
    lambda d: C.dedup_subset(d, ["name", "segment"]),
)


def _date_sql(policy: str, fmt: str) -> str:
    two = r"'^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$'"
    p = lambda i: f"TRY_CAST(regexp_extract({trim('date')}, {two}, {i}) AS INT)"
    iso = "strptime"
    day_first = f"({p(1)} > 12 OR ({p(2)} <= 12 AND {'false' if policy == 'assume_mdy' else 'true'}))"
    flagged = f"({p(1)} BETWEEN 1 AND 12 AND {p(2)} BETWEEN 1 AND 12)" if policy == "flag" else "false"
    d = (
        f"CASE WHEN regexp_matches({trim('date')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({trim('date')} AS DATE) "
        f"WHEN {flagged} THEN NULL WHEN {day_first} THEN TRY_CAST(printf('%04d-%02d-%02d', regexp_extract({trim('date')}, {two}, 3)::INT, {p(2)}, {p(1)}) AS DATE) "
        f"WHEN {p(1)} IS NOT NULL THEN TRY_CAST(printf('%04d-%02d-%02d', regexp_extract({trim('date')}, {two}, 3)::INT, {p(1)}, {p(2)}) AS DATE) END"
    )
    return f"coalesce(strftime({d}, '{fmt}'), date)"


for _policy, _target, _fmt in (
    ("flag", "YYYY-MM-DD", "%Y-%m-%d"), ("assume_dmy", "DD/MM/YYYY", "%d/%m/%Y"), ("assume_mdy", "MM/DD/YYYY", "%m/%d/%Y"),
):
    _clean(
        f"clean_dates_{_policy}",
        _dirty(date=_date_sql(_policy, _fmt)),
        lambda d, t=_target, p=_policy: C.format_dates(d, "date", t, p),
    )


@query(
    "clean_dates_report",
    with_(
        "dirty",
        f"""SELECT count(*) FILTER (n <> date) AS formatted, count(*) FILTER (NOT {blank('date')} AND n = date AND date <> '2024-02-29' AND date <> '05/06/2024' AND date <> '1-2-2023') AS failed,
 count(*) FILTER (date IN ('05/06/2024', '1-2-2023')) AS ambiguous FROM (SELECT date, {_date_sql('flag', '%Y-%m-%d')} AS n FROM dirty)""",
    ),
)
def clean_dates_report(spark, sf):
    return C.date_report(fx_dirty(spark, sf), "date", "YYYY-MM-DD")


_clean("clean_trim", _dirty(name=trim("name")), lambda d: C.trim_whitespace(d, "name"))
_clean(
    "clean_trim_collapse",
    _dirty(name=f"regexp_replace({trim('name')}, '{SP}+', ' ', 'g')"),
    lambda d: C.trim_whitespace(d, "name", collapse=True),
)
query("clean_rename", with_("dirty", "SELECT rid, name AS customer_name, date, amount, segment, code FROM dirty"))(
    lambda spark, sf: _out(C.rename_column(fx_dirty(spark, sf), "name", "customer_name"))
)
query("clean_drop_column", with_("dirty", "SELECT rid, name, date, amount, segment FROM dirty"))(
    lambda spark, sf: _out(C.drop_column(fx_dirty(spark, sf), "code"))
)
_X = prefix("amount")
_FILTERS = {
    "eq": ("segment", "BUILDING", "coalesce(segment, 'null') = 'BUILDING'"),
    "neq": ("segment", "BUILDING", "coalesce(segment, 'null') <> 'BUILDING'"),
    "ieq": ("segment", "building", "lower(coalesce(segment, 'null')) = 'building'"),
    "ineq": ("segment", "building", "lower(coalesce(segment, 'null')) <> 'building'"),
    "gt": ("amount", 1000, f"{_X} > 1000"),
    "gte": ("amount", 12, f"{_X} >= 12"),
    "lt": ("amount", 0, f"{_X} < 0"),
    "lte": ("amount", "12 items", f"{_X} <= 12"),
    "contains": ("name", "MAC", "contains(lower(name), 'mac')"),
    "not_null": ("segment", None, f"NOT {blank('segment')}"),
    "is_null": ("segment", None, blank("segment")),
}
for _op, (_c, _v, _sql) in _FILTERS.items():
    _clean(
        f"clean_filter_{_op}", _dirty(f"WHERE {_sql}"),
        lambda d, c=_c, o=_op, v=_v: C.filter_rows(d, c, o, v, strict_numeric=False),
    )


@query(
    "clean_filter_report",
    with_("dirty", f"SELECT count(*) FILTER ({_X} > 1000) AS kept, count(*) FILTER (NOT {_X} > 1000) AS removed, count(*) FILTER ({_X} IS NULL) AS parse_errors FROM dirty"),
)
def clean_filter_report(spark, sf):
    return C.filter_report(fx_dirty(spark, sf), "amount", "gt", 1000)


_clean("clean_case_lower", _dirty(name="lower(name)"), lambda d: C.standardize_case(d, "name", "lower"))
_clean("clean_case_upper", _dirty(name="upper(name)"), lambda d: C.standardize_case(d, "name", "upper"))
_clean(
    "clean_case_title",
    _dirty(
        name="""CASE name WHEN 'o''connor trading' THEN 'O''Connor Trading' WHEN '  smith-jones  ' THEN '  Smith-Jones  '
 WHEN 'McDONALD' THEN 'McDonald' WHEN 'ibm llc' THEN 'IBM LLC' WHEN 'macleod & sons' THEN 'MacLeod & Sons'
 WHEN 'élan  vital' THEN 'Élan  Vital' WHEN 'PLAIN name' THEN 'Plain Name' ELSE name END"""
    ),
    lambda d: C.standardize_case(d, "name", "title"),
)
_clean("clean_replace", _dirty(segment="CASE WHEN segment = 'BUILDING' THEN 'CONSTRUCTION' ELSE segment END"), lambda d: C.replace_values(d, "segment", "BUILDING", "CONSTRUCTION"))
_clean("clean_replace_loose", _dirty(code="CASE WHEN code = '7' THEN 'seven' ELSE code END"), lambda d: C.replace_values(d, "code", 7, "seven", strict=False))
query(
    "clean_flag",
    with_("dirty", f"SELECT rid, CASE WHEN {blank('segment')} THEN 'FLAGGED' END AS review_flag, CASE WHEN {blank('segment')} THEN 'segment' END AS review_column FROM dirty"),
)(
    lambda spark, sf: C.flag_for_review(fx_dirty(spark, sf), "segment").select(
        F.col("_row_id").alias("rid"), F.col("_review_flag").alias("review_flag"), F.col("_review_column").alias("review_column")
    )
)
_clean("clean_keep", _dirty(), lambda d: C.keep_as_is(d))
query("clean_stamp", with_("dirty", "SELECT rid, 'check by hand' AS instruction FROM dirty"))(
    lambda spark, sf: C.stamp_instruction(fx_dirty(spark, sf), "check by hand").select(
        F.col("_row_id").alias("rid"), F.col("_custom_instruction").alias("instruction")
    )
)

STEPS = [
    Step("trim", "name"),
    Step("standardise_case", "name", {"mode": "upper"}),
    Step("remove_nulls", "segment"),
    Step("filterRows", None, {"column": "amount", "operator": "gte", "value": 0, "strictNumeric": False}),
    Step("dedup", None, {"strategy": "subset", "columns": ["name", "segment", "amount"]}),
    Step("renameColumn", "code", {"newName": "customer_code"}),
]
_S1 = f"SELECT rid, upper({trim('name')}) AS name, date, amount, segment, code FROM dirty"
_S2 = f"SELECT * FROM ({_S1}) WHERE NOT {blank('segment')}"
_S3 = f"SELECT * FROM ({_S2}) WHERE {_X} >= 0"
_S4 = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY name, segment, amount ORDER BY rid) AS rn FROM ({_S3})) WHERE rn = 1"


@query("clean_steps_run", with_("dirty", f"SELECT rid, name, date, amount, segment, code AS customer_code FROM ({_S4})"))
def clean_steps_run(spark, sf):
    return _out(S.run_steps(fx_dirty(spark, sf), STEPS).df)


@query(
    "clean_steps_report",
    with_(
        "dirty",
        f"""SELECT * FROM (SELECT 0 AS step_index, 'trimWhitespace' AS action, (SELECT count(*) FROM dirty) AS rows_in, (SELECT count(*) FROM dirty) AS rows_out, (SELECT count(*) FROM dirty WHERE {trim('name')} <> name) AS affected
 UNION ALL SELECT 1, 'standardizeCase', (SELECT count(*) FROM dirty), (SELECT count(*) FROM dirty), (SELECT count(*) FROM dirty WHERE upper({trim('name')}) <> {trim('name')})
 UNION ALL SELECT 2, 'removeNulls', (SELECT count(*) FROM dirty), (SELECT count(*) FROM ({_S2})), (SELECT count(*) FROM dirty) - (SELECT count(*) FROM ({_S2}))
 UNION ALL SELECT 3, 'filterRows', (SELECT count(*) FROM ({_S2})), (SELECT count(*) FROM ({_S3})), (SELECT count(*) FROM ({_S2})) - (SELECT count(*) FROM ({_S3}))
 UNION ALL SELECT 4, 'deduplicate', (SELECT count(*) FROM ({_S3})), (SELECT count(*) FROM ({_S4})), (SELECT count(*) FROM ({_S3})) - (SELECT count(*) FROM ({_S4}))
 UNION ALL SELECT 5, 'renameColumn', (SELECT count(*) FROM ({_S4})), (SELECT count(*) FROM ({_S4})), 0)""",
    ),
)
def clean_steps_report(spark, sf):
    run = S.run_steps(fx_dirty(spark, sf), STEPS, counts=True)
    run.df.write.format("noop").mode("overwrite").save()
    return run.report().select("step_index", "action", "rows_in", "rows_out", "affected")


@query(
    "clean_dry_run",
    with_(
        "dirty",
        f"""SELECT n AS rows_in, least(n, 1000) AS sample_in, kept AS sample_out, least(n, 1000) - kept AS sample_removed,
 ((n * kept * 2 + least(n, 1000)) // (2 * least(n, 1000)))::BIGINT AS rows_out_estimate, kept < least(n, 1000) AS is_destructive
 FROM (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT count(*) FROM (SELECT * FROM dirty ORDER BY rid LIMIT 1000) WHERE NOT {blank('segment')}) AS kept)""",
    ),
)
def clean_dry_run(spark, sf):
    return S.dry_run(fx_dirty(spark, sf), Step("removeNulls", "segment"))


@query("preview_rows", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100")
def preview_rows(spark, sf):
    from ledgerloom.sources.files import preview

    return preview(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), 100, ["c_custkey"])


# --- profile ----------------------------------------------------------------

_LONG = "SELECT rid, c AS \"column\", v AS value FROM (SELECT rid, unnest(['amount','code','date','name','segment']) AS c, unnest([amount, code, date, name, segment]) AS v FROM dirty)"
_COUNTS = f"""SELECT "column", count(*) AS total_count, count(*) FILTER ({blank('value')}) AS null_count,
 count(DISTINCT value) FILTER (NOT {blank('value')}) AS unique_count FROM long GROUP BY 1"""
_HEAD = f'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rid) AS rn FROM long WHERE NOT {blank("value")})'
_DATE = r"'^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})$'"
_LABEL = rf"""SELECT "column", CASE WHEN avg(regexp_matches({trim('value')}, {_DATE})::INT) > 0.7 THEN 'date'
 WHEN avg(regexp_matches(replace(value, ',', ''), '^\s*[+-]?[0-9]+\s*$')::INT) > 0.8 THEN 'integer'
 WHEN avg(regexp_matches(regexp_replace(value, '[,$₹€£]', '', 'g'), '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$')::INT) > 0.7 THEN 'float'
 ELSE 'string' END AS type FROM head GROUP BY 1"""
_PROFILE = f"""prof AS (SELECT c."column", coalesce(l.type, 'unknown') AS type, null_count, {percent('null_count', 'total_count')} AS null_pct,
 unique_count, s.sample, total_count FROM counts c LEFT JOIN label l USING ("column")
 LEFT JOIN (SELECT "column", string_agg(value, '|' ORDER BY rid) AS sample FROM head WHERE rn <= 3 GROUP BY 1) s USING ("column"))"""


def _profile_sql(select: str) -> str:
    return (
        with_("dirty", "").rstrip()
        + f",\nlong AS MATERIALIZED ({_LONG}),\ncounts AS ({_COUNTS}),\nhead AS MATERIALIZED ({_HEAD}),\nlabel AS ({_LABEL}),\n{_PROFILE} {select}"
    )


@query("profile_columns", _profile_sql("SELECT * FROM prof"))
def profile_columns(spark, sf):
    return P.profile(fx_dirty(spark, sf)).withColumn("sample", F.array_join("sample", "|"))


@query(
    "profile_approx",
    _profile_sql('SELECT "column", type, null_count, null_pct, total_count, unique_count AS exact_count, true AS within_bound FROM prof'),
)
def profile_approx(spark, sf):
    df = fx_dirty(spark, sf)
    exact = P.column_counts(df).select("column", F.col("unique_count").alias("exact_count"))
    # The sketch's stated relative error is 5 %; three times that is allowed.
    close = F.abs(F.col("unique_count") - F.col("exact_count")) <= 0.15 * F.col("exact_count")
    return P.profile(df, approx=True).join(exact, "column").select(
        "column", "type", "null_count", "null_pct", "total_count", "exact_count", close.alias("within_bound")
    )


@query(
    "profile_strict",
    _profile_sql('SELECT "column", type FROM prof').replace("FROM head GROUP BY 1", "FROM head WHERE rn <= 100 GROUP BY 1"),
)
def profile_strict(spark, sf):
    return P.profile(fx_dirty(spark, sf), strict_reference=True).select("column", "type")


_SEVERITY = "CASE WHEN affected_pct > 10 THEN 'High' WHEN affected_pct > 3 THEN 'Medium' ELSE 'Low' END"
_ISSUES = f"""issue AS (SELECT 'missing' AS issue, "column", {_SEVERITY} AS severity, null_count AS affected_count, affected_pct,
 null_count || ' null values — ' || affected_pct || '% of rows' AS detail FROM (SELECT *, null_pct AS affected_pct FROM prof WHERE null_count > 0)
 UNION ALL SELECT 'format_inconsistency', "column", 'Low', total_count - null_count, {percent('total_count - null_count', 'total_count')}, 'Mixed formats: ' || f
 FROM prof JOIN (SELECT "column", string_agg(DISTINCT lay, ', ' ORDER BY lay) AS f, count(DISTINCT lay) AS k FROM (SELECT "column", CASE
  WHEN regexp_matches({trim('value')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'YYYY-MM-DD' WHEN regexp_matches({trim('value')}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN 'DD/MM/YYYY'
  WHEN regexp_matches({trim('value')}, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$') THEN 'DD-MM-YYYY' WHEN regexp_matches({trim('value')}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}$') THEN 'D/M/YY' END AS lay
  FROM head) GROUP BY 1) USING ("column") WHERE k > 1)"""


@query("profile_issues", _profile_sql("").rstrip() + f",\n{_ISSUES} SELECT * FROM issue")
def profile_issues(spark, sf):
    return P.issues(fx_dirty(spark, sf))


@query(
    "profile_duplicate_issue",
    with_(
        "dirty",
        f"""SELECT 'duplicate' AS issue, 'Medium' AS severity, sum(n - 1)::BIGINT AS affected_count, {percent('sum(n - 1)', 'sum(n)')} AS affected_pct,
 sum(n - 1)::BIGINT || ' exact duplicate rows' AS detail FROM (SELECT count(*) AS n FROM dirty GROUP BY name, date, amount, segment, code)""",
    ),
)
def profile_duplicate_issue(spark, sf):
    return P.duplicate_issue(fx_dirty(spark, sf)).drop("column")


@query(
    "cleaning_summary",
    _profile_sql(
        f"""SELECT max(total_count) AS total_rows, count(*) AS total_columns, sum(total_count)::BIGINT AS total_cells, sum(null_count)::BIGINT AS null_cells,
 {percent('sum(null_count)', 'sum(total_count)')} AS null_pct, sum(total_count) > 0 AS ready_to_clean FROM prof"""
    ),
)
def cleaning_summary(spark, sf):
    return P.cleaning_summary(P.column_counts(fx_dirty(spark, sf)))


@query(
    "column_report",
    _profile_sql(
        """SELECT "column", type, null_pct, CASE WHEN null_pct > 50 THEN 'poor' WHEN null_pct > 20 OR type = 'unknown' THEN 'fair' ELSE 'good' END AS quality,
 concat_ws('; ', CASE WHEN null_pct > 50 THEN 'High null rate: ' || null_pct || '%' END, CASE WHEN type = 'unknown' THEN 'Could not infer column type' END,
 CASE WHEN unique_count = 1 AND null_pct < 100 THEN 'All non-null values are identical — may be a constant column' END) AS warnings FROM prof"""
    ),
)
def column_report(spark, sf):
    return V.column_report(P.profile(fx_dirty(spark, sf)))


_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_VALUE = rf"regexp_replace({trim('amount')}, '[,$\s]', '', 'g')"


@query(
    "validate_clean",
    with_(
        "dirty",
        f"""SELECT * FROM (
 SELECT 'amount' AS "column", 'remaining_nulls' AS problem, count(*) AS count FROM dirty WHERE {blank('amount')}
 UNION ALL SELECT 'date', 'remaining_nulls', count(*) FROM dirty WHERE {blank('date')}
 UNION ALL SELECT 'name', 'remaining_nulls', count(*) FROM dirty WHERE {blank('name')}
 UNION ALL SELECT 'segment', 'remaining_nulls', count(*) FROM dirty WHERE {blank('segment')}
 UNION ALL SELECT 'amount', 'invalid_number', count(*) FROM dirty WHERE NOT {blank('amount')} AND NOT regexp_matches({_VALUE}, {_NUMBER}) AND {_VALUE} <> ''
 UNION ALL SELECT 'date', 'invalid_date', count(*) FROM dirty WHERE date IN ('31/02/2025', '29/02/2023', '29/02/2024', '13/02/2024', 'not a date', '2024/01/05')
 UNION ALL SELECT NULL, 'duplicate_rows', (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM dirty GROUP BY name, date, amount, segment, code))) WHERE count > 0""",
    ),
)
def validate_clean(spark, sf):
    return V.check_clean(fx_dirty(spark, sf), {"amount": "float", "date": "date"})


@query(
    "invalid_samples",
    with_(
        "dirty",
        f"""SELECT value FROM (SELECT amount AS value, row_number() OVER (ORDER BY rid) AS rn FROM dirty
 WHERE NOT {blank('amount')} AND NOT regexp_matches({_VALUE}, {_NUMBER})) WHERE rn <= 3""",
    ),
)
def invalid_samples(spark, sf):
    return V.invalid_samples(fx_dirty(spark, sf), "amount", "float").select("value")


@query(
    "step_guard",
    _profile_sql("").rstrip()
    + f""",\n{_ISSUES}, g AS (SELECT 'large_deletion' AS guard, 'High' AS severity, 'removeNulls' AS action, "column", null_count AS affected_count FROM prof
 WHERE "column" IN ('segment', 'name') AND null_count / total_count > 0.15
 UNION ALL SELECT 'drop_non_empty_column', 'Medium', 'dropColumn', "column", total_count - null_count FROM prof WHERE "column" = 'code' AND total_count > null_count)
 SELECT * FROM g UNION ALL SELECT 'high_impact_issue', 'High', NULL, "column", affected_count FROM issue
 WHERE severity = 'High' AND affected_pct > 20 AND "column" NOT IN (SELECT "column" FROM g)""",
)
def step_guard(spark, sf):
    df = fx_dirty(spark, sf)
    counts = P.column_counts(df)
    steps = [Step("removeNulls", "segment"), Step("removeNulls", "name"), Step("dropColumn", "code")]
    return V.guard_steps(steps, counts, P.issues(df))


@query(
    "transition_check",
    """SELECT event_id, user_id, status FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM (
 SELECT *, CASE event_type WHEN 'signup' THEN 'building' WHEN 'view' THEN 'ready' WHEN 'click' THEN 'executing' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status FROM events))
 WHERE NOT CASE WHEN prev IS NULL THEN status = 'building' ELSE (prev || '>' || status) IN ('building>ready', 'building>failed', 'ready>executing', 'ready>building', 'ready>failed', 'executing>complete', 'executing>failed', 'failed>building') END""",
)
def transition_check(spark, sf):
    log = table(spark, sf, "events").withColumn(
        "status",
        F.expr("case event_type when 'signup' then 'building' when 'view' then 'ready' when 'click' then 'executing' when 'purchase' then 'complete' else 'failed' end"),
    )
    return V.bad_transitions(log, "user_id", ["ts", "event_id"], F.to_date("ts")).select("event_id", "user_id", "status")
