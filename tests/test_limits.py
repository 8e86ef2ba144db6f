"""Inputs beyond the sizes that once were limits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditframe.functions import storage
from auditframe.functions.columns import value_counts
from auditframe.functions.ranking import kth_free, number_rows
from auditframe.operators import marts, profile, quality, ranking, text, usage


def test_long_blanks_are_blank(spark):
    df = spark.createDataFrame([(" " * 80,), (" ",), ("x" * 80,), ("x" * 80,), (None,)], "s STRING")
    row = quality.null_metrics(df).first()
    assert (row.empty_count, row.distinct_count, row.null_count) == (2, 3, 1)
    assert len([r for r in value_counts(df, ["s"], whole_values=False).collect() if (r.value or "").startswith("sha256:")]) == 1


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "x DOUBLE")
    assert quality.null_metrics(df).first().distinct_count == 2
    assert {r.value: r.n for r in value_counts(df, ["x"]).collect()} == {"0.0": 2, "1.5": 1}
    assert next(r for r in profile.column_profile(df).collect() if r["column"] == "x")["distinct_count"] == 2


@pytest.mark.parametrize("depth", [1, 12, 13, 40])
def test_brackets_of_any_depth(spark, depth):
    inner = "f(" * depth + "1" + ")" * depth
    statements = [
        (1, f"SELECT {inner} FROM t LIMIT 5"),
        (2, f"SELECT {inner} FROM t ORDER BY a LIMIT 5"),
        (3, "SELECT * FROM " + "(SELECT * FROM " * depth + "t LIMIT 3" + ") x" * depth + " ORDER BY 1"),
        (4, "SELECT * FROM " + "(SELECT * FROM " * depth + "t ORDER BY a LIMIT 3" + ") x" * depth),
        (5, f"SELECT a FROM t ORDER BY {inner} LIMIT 5) )"),
    ]
    df = spark.createDataFrame(statements, "question_id INT, expected_sql STRING")
    found = {r.question_id for r in text.statement_findings(df).collect() if r.code == "UNORDERED_LIMIT"}
    assert found == {1, 3}


def test_numbers_of_rows_without_a_part(spark):
    rows = [(None if k == 9 else k, i, None if i % 5 == 0 else i) for k in (1, 9) for i in range(12)]
    df = spark.createDataFrame(rows, "k INT, i INT, p INT")
    got = number_rows(df, ["k"], F.floor(F.col("p") / 4), [F.asc_nulls_first("p"), F.col("i")], "rn")
    assert got.columns == ["k", "i", "p", "rn"]
    for key in (1, None):
        own = sorted((r.rn, r.p is not None, r.p or r.i) for r in got.collect() if r.k == key)
        assert [n for n, _, _ in own] == list(range(1, 13))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


@pytest.mark.parametrize("start,block", [(1, 1), (2, 7), (3, 1000)])
def test_free_numbers_of_one_key_that_owns_all(spark, start, block):
    rng = random.Random(block)
    taken = sorted({rng.randrange(0, 900) for _ in range(500)} | set(range(100, 180)) | {10**12})
    rows = [("a", k) for k in range(1, 400)] + [(None, 3)]
    frame = spark.createDataFrame(rows, "key STRING, k INT")
    used = spark.createDataFrame([("a", n) for n in taken] + [(None, start), (None, start + 2)], "key STRING, n LONG")
    got = {(r.key, r.k): r.free for r in kth_free(frame, used, ["key"], "k", "n", "free", start=start, block=block).collect()}
    free = [n for n in range(start, 2000) if n not in set(taken)]
    assert len(got) == len(rows) and all(got["a", k] == free[k - 1] for k in range(1, 400))
    assert got[None, 3] == start + 4


def test_ids_lose_no_row(spark):
    rows = [(1, "q1"), (2, " q1"), (None, "q1"), (None, "q2"), (3, "q2"), (4, "q2:v2"), (5, "q2:v12345678901"), (6, ""), (7, None), (8, "q1:v2"), (9, "q1:v03")]
    df = spark.createDataFrame(rows, "ordinal INT, question_id STRING")
    got = text.renumber_ids(df, block=3).collect()
    named = [r.new_id for r in got if (r.new_id or "").strip()]
    assert len(got) == len(rows) and len(set(named)) == len(named) == 9
    assert {"q1", "q1:v2", "q1:v3", "q1:v4", "q2", "q2:v3"} <= set(named)
    big = spark.createDataFrame([(i, "q") for i in range(3)] + [(9, f"q:v{2**31 + 5}")], "ordinal INT, question_id STRING")
    assert {r.new_id for r in text.renumber_ids(big).collect()} == {"q", "q:v2", "q:v3", f"q:v{2**31 + 5}"}


def test_percentiles_of_a_busy_agent(spark):
    rng = random.Random(2)
    times = [rng.randrange(1, 10**9) for _ in range(30_000)]
    day = dt.datetime(2024, 1, 10)
    rows = [("a", day, t, "FINISHED", "u") for t in times] + [("a", day, None, "FAILED", "v"), ("b", day, None, "FAILED", "v")]
    log = spark.createDataFrame(rows, "space_id STRING, start_time TIMESTAMP, duration_ms LONG, execution_status STRING, executed_by STRING")
    got = {r.space_id: r for r in usage.daily_usage(log, dt.date(2024, 1, 20)).collect()}
    times.sort()
    assert (got["a"].p50_ms, got["a"].p95_ms, got["a"].queries, got["a"].errors, got["a"].distinct_users) == (times[14_999], times[28_499], 30_001, 1, 2)
    assert (got["b"].p50_ms, got["b"].queries, got["b"].errors) == (None, 1, 1)


def test_months_cover_the_table(spark):
    d = dt.date
    m = spark.createDataFrame([("u", d(1990, 3, 5), d(2001, 8, 2)), ("u", d(1991, 1, 1), None)], "unit STRING, s DATE, e DATE")
    got = {r.month: r.active for r in marts.monthly_snapshot(m, "unit", "s", "e").collect()}
    assert min(got) == d(1990, 3, 1) and max(got) == d(2001, 8, 1) and len(got) == 138
    assert (got[d(1990, 12, 1)], got[d(2001, 7, 1)], got[d(2001, 8, 1)]) == (1, 2, 1)
    assert marts.monthly_snapshot(m.limit(0), "unit", "s", "e").count() == 0


def test_names_are_no_patterns(spark):
    start = dt.datetime(2024, 1, 10)
    rows = [(1, "select * from a+c", start), (2, "select * from aac", start), (3, "select * from x.b(y", start)]
    log = spark.createDataFrame([(i, s, t, "FINISHED", "z") for i, s, t in rows], "statement_id INT, statement_text STRING, start_time TIMESTAMP, execution_status STRING, space_id STRING")
    assert {r.statement_id for r in ranking.relevant_log(log, ["a+c", "b(y"], dt.datetime(2024, 1, 20)).collect()} == {1, 3}


def test_wide_columns_are_named(spark):
    df = spark.createDataFrame([(f"v{i}", "A" if i % 2 else "a") for i in range(150)], "wide STRING, narrow STRING")
    assert {r["column"] for r in quality.casing_groups(df).collect()} == {"narrow"}
    assert [(r["column"], r.distinct_count) for r in quality.casing_skipped(df).collect()] == [("wide", 150)]
    assert {r["column"] for r in quality.casing_skipped(df, limit=1).collect()} == {"wide", "narrow"}


class _Cluster:
    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_a_cluster_must_name_its_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(_Cluster(**{"spark.master": "spark://host:7077", "spark.sql.warehouse.dir": "file:/x"}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(_Cluster(**{"spark.master": "local-cluster[2,1,1024]"}))
    assert storage.shared_folder(_Cluster(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert storage.shared_folder(_Cluster(**{"spark.master": "local[4]"}))
