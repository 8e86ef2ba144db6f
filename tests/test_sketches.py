"""Sketched profiles: merging parts equals one pass, and estimates keep to their bounds."""

import datetime as dt
import math

from pyspark.sql import functions as F

from auditframe.functions import sketches
from auditframe.operators import profile, usage
from auditframe.plans import all_queries

SF = "/root/testdata/sf0.1"


def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_merged_parts_equal_one_pass(spark, tmp_path):
    df = lines(spark)
    parts = {str(k): df.filter(F.pmod(F.hash("l_orderkey"), F.lit(3)) == k) for k in range(3)}
    merged = {r.column: r for r in profile.column_profile_parts(parts, str(tmp_path)).collect()}
    once = {r.column: r for r in profile.column_profile_approx(df).collect()}
    assert set(merged) == set(once) and len(once) == len(df.columns)
    for c, r in once.items():
        m = merged[c]
        # One pass estimates from the order of arrival as well, a merged sketch from its registers alone.
        assert abs(m.distinct_count - r.distinct_count) <= 0.02 * r.distinct_count
        same = ("n_rows", "n_nulls", "min_number", "max_number", "min_time", "max_time")
        assert [m[k] for k in same] == [r[k] for k in same]
    # A part that is stored again replaces itself.
    sketches.append_part(parts["0"], str(tmp_path), "0")
    again = {r.column: r for r in sketches.profile(sketches.read_parts(spark, str(tmp_path))).collect()}
    assert all(again[c].n_rows == r.n_rows and again[c].distinct_count == r.distinct_count for c, r in merged.items())


def test_estimates_keep_to_their_bounds(spark):
    df = lines(spark)
    exact = {r.column: r for r in profile.column_profile(df).collect()}
    for r in profile.column_profile_approx(df).collect():
        e = exact[r.column]
        assert abs(r.distinct_count - e.distinct_count) <= max(2, 0.04 * e.distinct_count)
        assert (r.min_number, r.max_number, r.min_time, r.max_time) == (e.min_number, e.max_number, e.min_time, e.max_time)
        if r.p50_number is not None:
            for share in (0.25, 0.5, 0.75):
                value = r[f"p{round(100 * share)}_number"]
                below, upto = df.agg(F.avg((F.col(r.column) < value).cast("int")), F.avg((F.col(r.column) <= value).cast("int"))).first()
                assert below - 0.02 <= share <= upto + 0.02


def test_frequent_values_nulls_and_odd_columns(spark):
    rows = [("a", 1.0, None, None)] * 60 + [("b", -0.0, None, dt.date(2024, 1, 1))] * 30 + [("x" * 500, 0.0, None, dt.date(2024, 1, 3))] * 10 + [(None, math.nan, None, None)]
    df = spark.createDataFrame(rows, "s string, `a.b` double, n int, d date")
    got = {r.column: r for r in profile.column_profile_approx(df).collect()}
    assert got["s"].frequent_values[:2] == ["a", "b"] and (got["s"].n_nulls, got["s"].distinct_count, got["s"].min_number) == (1, 3, None)
    assert got["a.b"].distinct_count == 3 and got["a.b"].min_number == 0.0
    assert (got["n"].n_nulls, got["n"].distinct_count, got["n"].p50_number, got["n"].frequent_values) == (101, 0, None, [])
    assert got["d"].min_time == dt.datetime(2024, 1, 1) and got["d"].max_time == dt.datetime(2024, 1, 3) and got["d"].p50_time == dt.datetime(2024, 1, 1)
    empty = {r.column: r for r in profile.column_profile_approx(df.limit(0)).collect()}
    assert all(r.n_rows == 0 and r.distinct_count == 0 for r in empty.values()) and len(empty) == 4


def test_stored_parts_of_the_registered_query(spark):
    got = {r.column: r for r in all_queries()["dp_profile_parts"](spark, "/root/testdata/sf0.01").collect()}
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    assert {r.n_rows for r in got.values()} == {df.count()} and set(got) == set(df.columns)


def test_days_merge_to_an_agent(spark):
    log = spark.range(0, 20_000).select(
        (F.col("id") % 3).cast("string").alias("space_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("start_time"),
        (F.col("id") * 7 % 1000).alias("duration_ms"), F.lit("FINISHED").alias("execution_status"), (F.col("id") % 90).cast("string").alias("executed_by"),
    )
    for r in usage.merged_usage(usage.usage_sketches(log), "space_id").collect():
        own = sorted(x[0] for x in log.filter(F.col("space_id") == r.space_id).select("duration_ms").collect())
        assert r.queries == len(own) and abs(r.distinct_users - 30) <= 1
        assert abs(own.index(r.p50_ms) / len(own) - 0.5) < 0.02 and abs(own.index(r.p95_ms) / len(own) - 0.95) < 0.02
