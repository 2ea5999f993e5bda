"""Audit rows, their export and retention, and hash-chained security logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.blocks import first_rows_per_key

AUDIT_SCHEMA = (
    "timestamp timestamp, job_id string, action string, user_id string, issue_type string, "
    "source_file string, previous_value string, new_value string, explanation string, "
    "execution_step string, responded_via string, execution_result string"
)
AUDIT_COLUMNS = [part.split()[0] for part in AUDIT_SCHEMA.split(", ")]
# The kinds of audit events.
AUDIT_ACTIONS = (
    "JOB_CREATED", "FILE_INGESTED", "AI_QUESTION_GENERATED", "ITEM_APPROVED", "ITEM_REJECTED",
    "STEP_EXECUTED", "STEP_FAILED", "JOB_COMPLETED",
)
# Columns of the audit export, in order.
EXPORT_COLUMNS = (
    "timestamp", "job_id", "action", "user_id", "issue_type",
    "execution_step", "responded_via", "execution_result", "explanation",
)
AUDIT_DAYS = 90
EVENTS_PER_JOB = 2000
GENESIS = "0" * 64


# --- audit rows -------------------------------------------------------------


def audit_rows(df: DataFrame, action: str | Column, **values: Column) -> DataFrame:
    """Project a table to audit rows; unnamed fields are NULL.

    A fixed action name must be a known kind.
    """
    if isinstance(action, str):
        if action not in AUDIT_ACTIONS:
            raise ValueError(f"unknown audit action {action!r}")
        action = F.lit(action)
    unknown = set(values) - set(AUDIT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown audit fields {sorted(unknown)}")
    kinds = dict(part.split() for part in AUDIT_SCHEMA.split(", "))
    given = {"action": action, **values}
    return df.select(
        *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in AUDIT_COLUMNS]
    )


def approval_events(approvals: DataFrame, job_id: Column, user_id: Column, at: Column) -> DataFrame:
    """Audit rows of resolved approvals (finding_type, status, response, responded_via)."""
    done = approvals.filter(F.col("status").isin("approved", "rejected"))
    return audit_rows(
        done,
        F.when(F.col("status") == "approved", "ITEM_APPROVED").otherwise("ITEM_REJECTED"),
        timestamp=at,
        job_id=job_id,
        user_id=user_id,
        issue_type=F.col("finding_type"),
        new_value=F.to_json(F.struct("response")),
        execution_step=F.lit("approval"),
        responded_via=F.coalesce("responded_via", F.lit("dashboard")),
        execution_result=F.concat("status", F.lit(" — "), F.coalesce("response", F.lit(""))),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to a table partitioned by day."""
    rows.select(*AUDIT_COLUMNS).withColumn("log_date", F.to_date("timestamp")).write.mode(
        "append"
    ).partitionBy("log_date").parquet(path)


def audit_export(events: DataFrame) -> DataFrame:
    """The export columns in time order."""
    return events.select(*EXPORT_COLUMNS).orderBy("timestamp", "job_id", "action")


def newest_events(events: DataFrame, key: str, order: list[Column], n: int = EVENTS_PER_JOB) -> DataFrame:
    """The newest ``n`` events of each job."""
    return first_rows_per_key(events, [key], order, n)


def expired(df: DataFrame, as_of: Column, days: int = AUDIT_DAYS, date: str = "log_date") -> DataFrame:
    """Rows past their retention; on a table partitioned by ``date`` whole partitions."""
    return df.filter(F.col(date) < F.date_sub(as_of, days))


# --- hash chains ------------------------------------------------------------


def build_chain(entries: DataFrame, keys: list[str], order: str, body: str) -> DataFrame:
    """Chain log entries: adds ``line_no`` (from 1) and ``line`` (JSON with prevHash and hash).

    ``body`` is the JSON text of an entry.  Each line's hash covers the line
    before, so a chain can only be written in order.  The rows of a task are
    sorted by Spark and streamed through in batches; only the last hash is kept,
    never a whole chain.  Chains are independent of each other: ``keys`` should
    name every writer (for example day and host), so that a busy day is spread.
    """
    sorted_rows = entries.select(*keys, order, body).repartition(*keys).sortWithinPartitions(*keys, order)
    kinds = {f.name: f.dataType.simpleString() for f in sorted_rows.schema}
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", line_no long, line string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last, number = None, GENESIS, 0
        for batch in batches:
            lines, numbers = [], []
            for key, text in zip(batch[keys].itertuples(index=False, name=None), batch[body]):
                if key != chain:
                    chain, last, number = key, GENESIS, 0
                inner = text[:-1] + ("," if len(text) > 2 else "") + f'"prevHash":"{last}"'
                last_hash = hashlib.sha256((last + inner + "}").encode()).hexdigest()
                number += 1
                lines.append(f'{inner},"hash":"{last_hash}"}}')
                numbers.append(number)
                last = last_hash
            yield batch[keys].assign(line_no=numbers, line=lines)

    return sorted_rows.mapInPandas(fold, out)


_TAIL = r',"hash":"([0-9a-f]{64})"\}\z'


def check_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each line with the problem found on it (NULL when none).

    Every line stores the hash of the line before, so each can be checked on its
    own: the line before is found by an equi join on its number, and no chain is
    walked.
    """
    read = lines.select(
        *keys,
        "line_no",
        F.nullif(F.regexp_extract("line", _TAIL, 1), F.lit("")).alias("_hash"),
        F.nullif(F.regexp_extract("line", r'"prevHash":"([0-9a-f]{64})"' + _TAIL, 1), F.lit("")).alias("_prev"),
        F.concat(F.regexp_replace("line", _TAIL, ""), F.lit("}")).alias("_body"),
    )
    before = read.select(*keys, (F.col("line_no") + 1).alias("line_no"), F.col("_hash").alias("_want"))
    joined = read.join(before, [*keys, "line_no"], "left")
    want = F.when(F.col("line_no") == 1, F.lit(GENESIS)).otherwise(F.col("_want"))
    own = F.sha2(F.concat("_prev", "_body"), 256)
    problem = (
        F.when(F.col("_hash").isNull() | F.col("_prev").isNull(), "unreadable")
        .when(~F.col("_prev").eqNullSafe(want), "broken_link")
        .when(own != F.col("_hash"), "edited")
    )
    return joined.select(*keys, "line_no", problem.alias("problem"))


def verify_chain(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chain: lines, valid, the first broken line and what is wrong with it."""
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("line_no", "problem")))
    return (
        check_lines(lines, keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total_lines"), first.alias("_f"))
        .select(
            *keys,
            "total_lines",
            F.col("_f").isNull().alias("valid"),
            F.col("_f.line_no").alias("broken_at_line"),
            F.col("_f.problem").alias("problem"),
        )
    )
