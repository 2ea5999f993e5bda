"""Cleaning steps, step lists, profile and validation on small frames."""

import math
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profile as P
from ledgerloom.operators import stats, validate as V
from ledgerloom.operators.cleaning import Step, StepError
from ledgerloom.plans import steps as S


def frame(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "_row_id long, c string")


def column(df):
    return [r.c for r in df.orderBy("_row_id").collect()]


def test_fill(spark):
    assert column(C.fill_missing(frame(spark, "1", "2", "4", "9", ""), "c", "median"))[-1] == "3"
    assert column(C.fill_missing(frame(spark, "-7", "x", "2.5", None, "10"), "c", "median"))[3] == "2.5"
    assert column(C.fill_missing(frame(spark, "1", "2x", "2", " "), "c", "mean"))[-1] == "1.67"
    assert column(C.fill_missing(frame(spark, "b", "a", "a", "b", None), "c", "mode"))[-1] == "b"
    # Raised inside the scalar subquery, so it may reach Python unwrapped.
    with pytest.raises(Exception, match="no numeric values"):
        C.fill_missing(frame(spark, "x", ""), "c", "mean").collect()
    with pytest.raises(StepError):
        C.fill_missing(frame(spark, "x"), "nope", "zero")


def test_median_of_many(spark):
    df = spark.range(10_001).select((F.col("id") * 37 % 10_001 - 5000).cast("string").alias("c"))
    assert stats.exact_median(df, "c").first().fill == 0.0


def test_filter(spark):
    df = frame(spark, "12abc", "abc", "5")
    assert column(C.filter_rows(df, "c", "gt", 10, strict_numeric=False)) == ["12abc"]
    assert C.filter_report(df, "c", "gt", 10).first().asDict() == {"kept": 1, "removed": 1, "parse_errors": 1}
    with pytest.raises(PySparkException):
        C.filter_rows(df, "c", "gt", 10).collect()


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "a", "z"), (1, "a", "y"), (2, "a", "y"), (4, None, "q"), (5, None, "q")], "_row_id long, c string, d string")
    assert sorted(r._row_id for r in C.dedup_exact(df).collect()) == [1, 3, 4]
    assert sorted((r._row_id, r.d) for r in C.dedup_subset(df, ["c"]).collect()) == [(1, "y"), (4, "q")]


def test_replace_rename_drop(spark):
    df = frame(spark, "0", "x")
    assert column(C.replace_values(df, "c", 0, "zero")) == ["0", "x"]
    assert column(C.replace_values(df, "c", 0, "zero", strict=False)) == ["zero", "x"]
    with pytest.raises(StepError):
        C.rename_column(df, "c", "_row_id")
    with pytest.raises(StepError):
        C.drop_column(df, "zzz")


def test_steps_run_with_counts(spark):
    df = frame(spark, " a ", "b", "", "b")
    run = S.run_steps(df, [Step("trim", "c"), Step("nope", "c"), Step("removeNulls", "c")], stop_on_error=False, counts=True)
    run.df.write.format("noop").mode("overwrite").save()
    assert column(run.df) == ["a", "b", "b"]
    assert sorted(map(tuple, S.count_steps(df, [Step("trim", "c"), Step("removeNulls", "c")]).collect())) == [(-1, 4), (0, 4), (1, 3)]
    got = [(r.step_index, r.action, r.rows_in, r.rows_out, r.affected, r.status) for r in run.report().orderBy("step_index").collect()]
    assert got == [(0, "trimWhitespace", 4, 4, 1, "ok"), (1, "nope", None, None, None, "failed"), (2, "removeNulls", 4, 3, 1, "ok")]
    with pytest.raises(StepError):
        S.run_steps(df, [Step("trim", "c", status="pending")])
    S.register_step("shout", lambda d, s, r: d.withColumn(s.column, F.upper(s.column)))
    assert column(S.run_steps(df, [Step("shout", "c")]).df) == [" A ", "B", "", "B"]


def test_dry_run(spark):
    got = S.dry_run(frame(spark, "a", "", "c", "d"), Step("remove_nulls", "c")).first()
    assert (got.rows_in, got.sample_removed, got.rows_out_estimate, got.is_destructive) == (4, 1, 3, True)
    shown = S.dry_run_samples(frame(spark, "a", ""), Step("remove_nulls", "c")).collect()
    assert [(r._row_id, r.after) for r in shown] == [(1, "[row removed]")]


def test_steps_repeat_without_change(spark):
    df = frame(spark, " x", "13/02/2024", None, "x", "o'NEIL")
    for step in (Step("trim", "c"), Step("removeNulls", "c"), Step("dedup"), Step("formatDates", "c", {"targetFormat": "YYYY-MM-DD"}), Step("standardizeCase", "c", {"mode": "title"})):
        once = S.apply_step(df, step)
        assert sorted(map(repr, S.apply_step(once, step).collect())) == sorted(map(repr, once.collect()))


def test_profile_and_checks(spark):
    df = spark.createDataFrame(
        [(i, f"{i}", "2024-01-01" if i % 2 else "01/02/2024", None if i < 6 else "k") for i in range(20)],
        "_row_id long, n string, d string, k string",
    )
    got = {r.column: r for r in P.profile(df).collect()}
    assert (got["n"].type, got["d"].type, got["k"].null_pct, got["n"].unique_count) == ("integer", "date", 30.0, 20)
    assert got["n"].sample == ["0", "1", "2"]
    found = {(r.issue, r.column): r.severity for r in P.issues(df).collect()}
    assert found == {("missing", "k"): "High", ("format_inconsistency", "d"): "Low"}
    report = {r.column: (r.quality, r.warnings) for r in V.column_report(P.profile(df)).collect()}
    assert report["k"][0] == "fair" and "constant" in report["k"][1]
    guard = V.guard_steps([Step("removeNulls", "k"), Step("dropColumn", "n")], P.column_counts(df), P.issues(df))
    assert sorted((r.guard, r.affected_count) for r in guard.collect()) == [("drop_non_empty_column", 20), ("large_deletion", 6)]
    assert [r.problem for r in V.check_clean(df.limit(0)).collect()] == ["empty_dataset"]


def test_required_groups(spark):
    got = {r.field_group: r.found for r in V.required_groups(spark, ["my_vendor_name", "Invoice_No", "vendor_total_x"]).collect()}
    assert got == {"Invoice identifier": True, "Vendor / Supplier": True, "Amount / Total": True}
    assert V.repeated_names(["a", "b", "a"]) == ["a"]


def test_median_and_mean_of_any_doubles(spark):
    from statistics import median

    from ledgerloom.operators.stats import exact_mean, exact_median

    cases = (
        ["0.00001", "0.00002", "0.00003"], ["1e15", "2", "3"], ["1e23", "-1e23", "7"], ["-5", "-0.25", "0", "0", "1e-9"],
        ["1", "2", "4", "9"], ["12345678.9012345", "x", "", None], ["1e300", "1e300", "-1e-300", "3"], ["-1", "-2", "-3", "-4.5"],
    )
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values], "v string")
        numbers = [float(v) for v in values if v not in (None, "", "x")]
        m, mean = median(numbers), sum(numbers) / len(numbers)
        halves = lambda y: y if abs(y * 100) >= 2**53 else math.floor(y * 100 + 0.5) / 100
        assert exact_median(df, "v").first().fill == (halves(m) if len(numbers) % 2 == 0 else m)
        assert math.isclose(exact_mean(df, "v").first().fill, halves(mean), rel_tol=1e-12)


def test_order_keys_and_medians_of_many_columns(spark):
    import random
    import struct
    from statistics import median

    rnd = random.Random(5)
    bits = lambda i: struct.unpack("<d", struct.pack("<q", i))[0]
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf")]
    values += [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, 0) for e in range(-1000, 1024, 3)]
    values += [bits(rnd.randrange(0x7FEFFFFFFFFFFFFF)) for _ in range(500)]
    values = sorted(set(values + [-v for v in values]))
    keys = [r.k for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", stats.order_key(F.col("x")).alias("k")).orderBy("x").collect()]
    assert all(a < b for a, b in zip(keys, keys[1:]))
    whole = [v for v in values if v >= 0]
    assert [struct.unpack("<q", struct.pack("<d", v))[0] for v in whole] == keys[len(values) - len(whole) :]

    # One column per kind: near doubles, equal ones, one value, none; odd and even numbers of rows.
    table = [
        [repr(math.nextafter(1.0, i)) if i % 2 else "1" for i in range(40)], [str(i // 9) for i in range(40)], ["7"] + [None] * 39,
        ["x"] * 40, [str(rnd.uniform(-1e6, 1e6)) for _ in range(39)] + [""], ["1e308", "1.5e308"] * 20,
    ]
    names = [f"c{i}" for i in range(len(table))]
    df = spark.createDataFrame(list(zip(*table)), ", ".join(f"{c} string" for c in names))
    got = {r.column: (r.fill, r.n) for r in stats.exact_medians(df, names).collect()}
    assert set(got) == {"c0", "c1", "c2", "c4", "c5"}
    for c, cells in zip(names, table):
        if c not in got:
            continue
        numbers = [float(v) for v in cells if v not in (None, "", "x")]
        want = median(numbers) if c != "c5" else 1.25e308
        even = len(numbers) % 2 == 0 and abs(want * 100) < 2**53
        assert got[c] == (math.floor(want * 100 + 0.5) / 100 if even else want, len(numbers)), c
