"""Lists of cleaning steps: registry, run with per-step counts, dry run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import half_up
from ledgerloom.operators import cleaning as C
from ledgerloom.operators.cleaning import ROW_ID, Step, StepError

DESTRUCTIVE = ("removeNulls", "deduplicate", "dropColumn", "filterRows")
PREVIEW_ROWS = 1000

# Spellings accepted for the step names.
SPELLINGS = {
    "removeNulls": ("removenulls", "remove_nulls", "dropnulls", "drop_nulls", "removenull"),
    "fillMissing": ("fillmissing", "fill_missing", "fillnulls", "fill_nulls"),
    "deduplicate": ("deduplicate", "dedup", "removeduplicates", "remove_duplicates"),
    "formatDates": ("formatdates", "format_dates", "formatdate"),
    "trimWhitespace": ("trimwhitespace", "trim_whitespace", "trim"),
    "renameColumn": ("renamecolumn", "rename_column"),
    "dropColumn": ("dropcolumn", "drop_column"),
    "filterRows": ("filterrows", "filter_rows"),
    "standardizeCase": (
        "standardizecase", "standardize_case", "standardisecase", "standardise_case",
    ),
    "replaceValues": ("replacevalues", "replace_values"),
    "flagForReview": ("flagforreview", "flag_for_review"),
    "keepAsIs": ("keepasis", "keep_as_is", "skip"),
    "custom": ("custom",),
}

StepFn = Callable[[DataFrame, Step, str], DataFrame]


def _dedup(df: DataFrame, s: Step, row_id: str) -> DataFrame:
    if s.parameters.get("strategy", "exact") == "subset":
        return C.dedup_subset(df, s.parameters.get("columns") or [], row_id)
    return C.dedup_exact(df, row_id)


_REGISTRY: dict[str, StepFn] = {
    "removeNulls": lambda df, s, r: C.remove_nulls(df, s.column),
    "fillMissing": lambda df, s, r: C.fill_missing(
        df, s.column, s.parameters.get("method"), s.parameters.get("value"), r
    ),
    "deduplicate": _dedup,
    "formatDates": lambda df, s, r: C.format_dates(
        df, s.column, s.parameters.get("targetFormat"), s.parameters.get("ambiguousDatePolicy", "flag")
    ),
    "trimWhitespace": lambda df, s, r: C.trim_whitespace(
        df, s.column, s.parameters.get("collapseInternalWhitespace", False)
    ),
    "renameColumn": lambda df, s, r: C.rename_column(df, s.column, s.parameters.get("newName")),
    "dropColumn": lambda df, s, r: C.drop_column(df, s.column),
    "filterRows": lambda df, s, r: C.filter_rows(
        df,
        s.parameters.get("column") or s.column,
        s.parameters.get("operator"),
        s.parameters.get("value"),
        s.parameters.get("strictNumeric", True),
    ),
    "standardizeCase": lambda df, s, r: C.standardize_case(
        df, s.column, s.parameters.get("mode"), s.parameters.get("skipNonString", False)
    ),
    "replaceValues": lambda df, s, r: C.replace_values(
        df, s.column, s.parameters.get("find"), s.parameters.get("replace"), s.parameters.get("strict", True)
    ),
    "flagForReview": lambda df, s, r: C.flag_for_review(df, s.column),
    "keepAsIs": lambda df, s, r: C.keep_as_is(df),
    "custom": lambda df, s, r: C.stamp_instruction(df, s.parameters.get("instruction", "custom")),
}


def register_step(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a user step: ``fn(df, step, row_id) -> DataFrame``."""
    _REGISTRY[name] = fn


def step_name(action: str) -> str:
    low = action.strip().lower()
    for name, spellings in SPELLINGS.items():
        if low in spellings:
            return name
    return action.strip()


def apply_step(df: DataFrame, step: Step, row_id: str = ROW_ID) -> DataFrame:
    name = step_name(step.action)
    if name not in _REGISTRY:
        raise StepError(f"unknown step {step.action!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](df, step, row_id)


@dataclass
class StepRun:
    """Outcome of ``run_steps``; ``report`` is filled by the first action on ``df``."""

    df: DataFrame
    names: list[tuple[int, str, str | None]] = field(default_factory=list)
    seen: list[Observation] = field(default_factory=list)
    failed: list[tuple[int, str, str]] = field(default_factory=list)

    def report(self) -> DataFrame:
        """One row per step: rows in, rows out, rows affected, status.

        Call it after the first action on ``df``, which should be a plain write:
        the counts were taken along the way, and a sort or a repeated stage would
        run the rows past the counters twice.  ``count_steps`` gives the counts
        by aggregation instead, at the price of one run per step.
        """
        got = [o.get for o in self.seen]
        rows = []
        for k, (index, action, column) in enumerate(self.names):
            rows_in, rows_out = got[k]["n"], got[k + 1]["n"]
            changed = got[k + 1].get("changed")
            affected = rows_in - rows_out if changed is None else changed
            rows.append((index, action, column, rows_in, rows_out, affected, "ok", None))
        for index, action, message in self.failed:
            rows.append((index, action, None, None, None, None, "failed", message))
        return self.df.sparkSession.createDataFrame(
            sorted(rows),
            "step_index int, action string, column string, rows_in long, rows_out long, "
            "affected long, status string, error string",
        )


_CELL_STEPS = ("fillMissing", "formatDates", "trimWhitespace", "standardizeCase", "replaceValues")


def run_steps(
    df: DataFrame,
    steps: list[Step],
    row_id: str = ROW_ID,
    stop_on_error: bool = True,
    counts: bool = False,
) -> StepRun:
    """Fold confirmed steps into one lazy plan.

    With ``counts`` the row counts are observed while the plan runs, so they cost
    no extra pass.  Only errors found while planning (missing columns, bad
    parameters) can be skipped; an error inside a task fails the job.
    """
    for i, s in enumerate(steps):
        if s.status != "confirmed":
            raise StepError(f"step {i} ({s.action}) is not confirmed")
    run = StepRun(df)
    if counts:
        run.seen.append(Observation("step_input"))
        run.df = run.df.observe(run.seen[-1], F.count(F.lit(1)).alias("n"))
    for i, s in enumerate(steps):
        name = step_name(s.action)
        try:
            after = apply_step(run.df, s, row_id)
        except StepError as e:
            if stop_on_error:
                raise StepError(f"step {i} ({s.action}) failed: {e}") from e
            run.failed.append((i, name, str(e)))
            continue
        if counts:
            metrics = [F.count(F.lit(1)).alias("n")]
            drop = []
            if name in _CELL_STEPS:
                # Carry the cell before the step beside the cell after it, compare, drop it.
                before = run.df.withColumn("_before", F.col(s.column))
                after = apply_step(before, s, row_id)
                metrics.append(
                    F.count_if(~F.col("_before").eqNullSafe(F.col(s.column))).alias("changed")
                )
                drop = ["_before"]
            elif name == "flagForReview":
                metrics.append(F.count_if(F.col("_review_flag").isNotNull()).alias("changed"))
            elif name == "custom":
                metrics.append(F.count(F.lit(1)).alias("changed"))
            run.seen.append(Observation(f"step_{i}"))
            after = after.observe(run.seen[-1], *metrics).drop(*drop)
            run.names.append((i, name, s.column))
        run.df = after
    return run


def count_steps(df: DataFrame, steps: list[Step], row_id: str = ROW_ID) -> DataFrame:
    """Rows left after each step (step -1 is the input), by plain aggregation."""
    n = F.count(F.lit(1)).alias("rows")
    out = df.agg(n).withColumn("step_index", F.lit(-1))
    for i in range(len(steps)):
        after = run_steps(df, steps[: i + 1], row_id).df
        out = out.unionByName(after.agg(n).withColumn("step_index", F.lit(i)))
    return out.select("step_index", "rows")


def dry_run(df: DataFrame, step: Step, row_id: str = ROW_ID) -> DataFrame:
    """One row: what the step would do, judged on the first 1000 rows.

    ``rows_out_estimate`` scales the share of rows removed in the sample to the
    whole table.
    """
    sample = df.orderBy(row_id).limit(PREVIEW_ROWS)
    after = apply_step(sample, step, row_id)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    before_n = sample.agg(F.count(F.lit(1)).alias("n")).scalar()
    name = step_name(step.action)
    one = after.agg(F.count(F.lit(1)).alias("sample_out"))
    out = one.select(
        total.alias("rows_in"), before_n.alias("sample_in"), F.col("sample_out")
    )
    removed = F.col("sample_in") - F.col("sample_out")
    kept = F.when(F.col("sample_in") == 0, F.col("rows_in").cast("double")).otherwise(
        half_up(F.col("rows_in") * F.col("sample_out"), F.col("sample_in"), 0)
    )
    return out.select(
        "rows_in",
        "sample_in",
        "sample_out",
        removed.alias("sample_removed"),
        kept.cast("long").alias("rows_out_estimate"),
        (F.lit(name in DESTRUCTIVE) & (removed > 0)).alias("is_destructive"),
    )


def dry_run_samples(df: DataFrame, step: Step, n: int = 5, row_id: str = ROW_ID) -> DataFrame:
    """Up to ``n`` rows of the sample that the step removes or changes, before and after."""
    sample = df.orderBy(row_id).limit(PREVIEW_ROWS)
    after = apply_step(sample, step, row_id)
    data = lambda d: F.to_json(F.struct(*[c for c in d.columns if c != row_id]))
    b = sample.select(F.col(row_id), data(sample).alias("before"))
    a = after.select(F.col(row_id), data(after).alias("after"))
    return (
        b.join(a, row_id, "left")
        .filter(F.col("after").isNull() | (F.col("after") != F.col("before")))
        .orderBy(row_id)
        .limit(n)
        .select(row_id, "before", F.coalesce("after", F.lit("[row removed]")).alias("after"))
    )
