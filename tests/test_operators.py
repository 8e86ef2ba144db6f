"""Pinned cases and edge frames per operator family."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditframe.operators import catalog, equivalence, evals, io, marts, profile, quality, ranking, text, usage
from auditframe.streaming import usage as stream


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- equivalence ---------------------------------------------------------------


@pytest.mark.parametrize(
    "a,b",
    [
        ([1, 1, 2], [1, 2, 2]),
        ([], []),
        ([None, None, 1], [None, 1, 1]),
        ([], [5, 5]),
        ([7] * 50 + [1], [7] * 20),
    ],
)
def test_bag_difference(spark, a, b):
    left = spark.createDataFrame([(x,) for x in a], "x INT")
    right = spark.createDataFrame([(x,) for x in b], "renamed INT")
    ca, cb = Counter(a), Counter(b)
    want = (sum((ca - cb).values()), sum((cb - ca).values()))
    assert rows(equivalence.setdiff_counts(left, right)) == [want]
    diff = {(r["side"], r["x"]): r["copies"] for r in equivalence.diff_rows(left, right).collect()}
    assert diff == {**{("a", k): n for k, n in (ca - cb).items()}, **{("b", k): n for k, n in (cb - ca).items()}}


def test_columns_compare_by_position(spark):
    a = spark.createDataFrame([(1, 2)], "x INT, y INT")
    swapped = spark.createDataFrame([(2, 1)], "x INT, y INT")
    assert rows(equivalence.compare(a, a.toDF("p", "q"))) == [("exact", True)]
    assert rows(equivalence.compare(a, swapped)) == [("exact", False)]
    assert rows(equivalence.compare(a, a.select(F.col("x").cast("double"), "y"))) == [("exact", True)]


def test_reshaped_numbers_and_no_numbers(spark):
    tall = spark.createDataFrame([("a", 1.0), ("b", 2.0000001)], "k STRING, v DOUBLE")
    wide = spark.createDataFrame([(2, 1, None)], "b INT, a INT, c INT")
    assert rows(equivalence.compare(tall, wide)) == [("numeric_multiset", True)]
    assert rows(equivalence.compare(tall, tall.select("k"))) == [("none", False)]
    assert rows(equivalence.numeric_equivalence(tall.select("k"), wide)) == [(None,)]
    empty = tall.filter("false")
    assert rows(equivalence.numeric_equivalence(empty, wide.filter("false"))) == [(True,)]


def test_maps_are_compared_as_json(spark):
    a = spark.sql("SELECT map('k', 1) AS m")
    assert rows(equivalence.setdiff_counts(a, a)) == [(0, 0)]


def test_final_verdict_order(spark):
    df = spark.createDataFrame(
        [(" good ", False, None), ("BAD", True, "different"), ("BAD", False, "Equivalent"), (None, None, None), ("NEEDS_REVIEW", False, "x")],
        "native STRING, equivalent BOOLEAN, reviewer_verdict STRING",
    )
    got = rows(equivalence.final_verdict(df).select("final", "decided_by"))
    assert got == [("GOOD", "native"), ("GOOD", "data"), ("GOOD", "reviewer"), ("BAD", "native"), ("NEEDS_REVIEW", "native")]


# ---- io ------------------------------------------------------------------------


def test_read_append_overwrite(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType())])
    path = str(tmp_path / "t")
    assert rows(io.read_filtered(spark, path, {"id": 1}, schema)) == []
    io.append(spark.createDataFrame([(1,)], "id INT"), path, schema)
    io.append(spark.createDataFrame([("b", 2)], "note STRING, id INT"), path, schema)
    assert sorted(rows(io.read_filtered(spark, path, {}))) == [(1, None), (2, "b")]
    assert rows(io.read_filtered(spark, path, {"id": 2, "note": "b"})) == [(2, "b")]
    assert rows(io.read_filtered(spark, path, {"note": None})) == [(1, None)]
    twice = spark.createDataFrame([(1, "x"), (1, "y")], schema)
    with pytest.raises(ValueError):
        io.overwrite_unique(twice, path, ["id"])
    io.overwrite_unique(twice.limit(1), path, ["id"])
    assert spark.read.parquet(path).count() == 1


def test_hash_check_finds_edits(spark):
    df = io.with_hash(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id INT, body STRING"), "body")
    edited = df.withColumn("body", F.when(F.col("id") == 2, "B").otherwise(F.col("body")))
    assert [r["id"] for r in io.hash_mismatches(edited, "body").collect()] == [2]


# ---- usage ---------------------------------------------------------------------


def test_price_interval_is_half_open(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    use = spark.createDataFrame([("w", "s", "c", t(h), 1.0) for h in (0, 1, 2, 3)],
                                "warehouse_id STRING, sku_name STRING, cloud STRING, usage_start_time TIMESTAMP, usage_quantity DOUBLE")
    prices = spark.createDataFrame([("s", "c", t(1), t(2), 10.0), ("s", "c", t(2), None, 20.0)],
                                   "sku_name STRING, cloud STRING, price_start_time TIMESTAMP, price_end_time TIMESTAMP, list_price DOUBLE")
    got = {r["hr"].hour: r["usd"] for r in usage.hourly_cost(use, prices).collect()}
    assert got == {0: 0.0, 1: 10.0, 2: 20.0, 3: 20.0}


def test_cost_is_shared_by_task_time(spark):
    t = dt.datetime(2024, 1, 1, 5, 30)
    log = spark.createDataFrame(
        [("s1", "ws", "w", t, 30, "u"), (None, "ws", "w", t, 70, "u"), ("s1", "ws", "w", t, 0, "u"), ("s2", "ws", "x", t, 5, "u")],
        "space_id STRING, workspace_id STRING, warehouse_id STRING, start_time TIMESTAMP, task_ms BIGINT, executed_by STRING",
    )
    use = spark.createDataFrame([("w", "s", "c", dt.datetime(2024, 1, 1, 5), 10.0)],
                                "warehouse_id STRING, sku_name STRING, cloud STRING, usage_start_time TIMESTAMP, usage_quantity DOUBLE")
    prices = spark.createDataFrame([("s", "c", dt.datetime(2023, 1, 1), None, 2.0)],
                                   "sku_name STRING, cloud STRING, price_start_time TIMESTAMP, price_end_time TIMESTAMP, list_price DOUBLE")
    got = {(r["space_id"], r["warehouse_id"]): (r["query_count"], r["approx_usd"])
           for r in usage.cost_daily(log, use, prices, dt.date(2024, 1, 2), 7).collect()}
    assert got == {("s1", "w"): (1, 6.0), ("s2", "x"): (1, 0.0)}


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("a",)], "workspace_id STRING")
    assert usage.scope(df, None).count() == 0 and usage.scope(df, "").count() == 0 and usage.scope(df, "a").count() == 1


def test_zero_filled_days(spark):
    log = spark.createDataFrame([("s", dt.datetime(2024, 1, 2, 3))], "space_id STRING, start_time TIMESTAMP")
    got = {r["day"].day: r["queries"] for r in usage.daily_volume(log, dt.date(2024, 1, 4), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


# ---- profile and quality ----------------------------------------------------------


def test_profile_matches_pandas_counts(spark):
    long = "x" * 500
    df = spark.createDataFrame(
        [(1, "a", 1.5, long), (2, "a", None, long + "y"), (None, None, 1.5, None)], "i INT, s STRING, d DOUBLE, t STRING"
    )
    got = {r["column"]: (r["distinct_count"], r["min_number"], r["max_number"]) for r in profile.column_profile(df).collect()}
    assert got == {"i": (2, 1.0, 2.0), "s": (1, None, None), "d": (1, 1.5, 1.5), "t": (2, None, None)}
    approx = {r["column"]: r["distinct_count"] for r in profile.column_profile_approx(df).collect()}
    assert approx == {"i": 2, "s": 1, "d": 1, "t": 2}


def test_approximate_profile_is_close(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("k"))
    got = profile.column_profile_approx(df, 0.02).collect()[0]["distinct_count"]
    assert abs(got - 5000) < 500


def test_value_lists_stop_at_the_limit(spark):
    df = spark.range(100).select(
        (F.col("id") % 20).cast("string").alias("twenty"), (F.col("id") % 21).cast("string").alias("more"),
        F.lit(None).cast("string").alias("none"),
    )
    got = {r["column"]: len(r["values"]) for r in profile.value_lists(df).collect()}
    assert got == {"twenty": 20}
    first = {r["column"]: (len(r["values"]), r["has_more"]) for r in profile.first_distinct_values(df, ["twenty"], 10).collect()}
    assert first == {"twenty": (10, True)}


def test_nearly_empty_column_is_not_all_null(spark):
    df = spark.range(30000).select(F.when(F.col("id") == 7, "x").alias("c"))
    metrics = quality.null_metrics(df)
    recs = {r["reason"] for r in quality.recommendations(metrics, quality.casing_groups(df)).collect()}
    assert metrics.collect()[0]["null_rate"] == 1.0
    assert recs == {"high_null_rate", "constant_value"}


def test_empty_table_quality(spark):
    df = spark.createDataFrame([], "a STRING, b INT")
    assert quality.null_metrics(df).count() == 0
    verdicts = quality.filter_selectivity(df, {"f": "b = 1"}).collect()
    assert verdicts[0]["verdict"] == "ok"


def test_literal_suggestions(spark):
    lits = spark.createDataFrame([("c", "Purchas"), ("c", "PURCHASE"), ("c", "zzz"), ("d", "x")], "column_name STRING, literal STRING")
    words = spark.createDataFrame([("c", ["purchase", "view"])], "column_name STRING, values ARRAY<STRING>")
    got = {r["literal"]: r["suggestion"] for r in quality.missing_literals(lits, words).collect()}
    assert got == {"Purchas": "purchase", "zzz": None}


def test_orphans_count_null_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "k INT")
    parent = spark.createDataFrame([(1,), (2,)], "k INT")
    assert rows(quality.fk_orphans(child, "k", parent, "k")) == [(3,)]
    assert rows(quality.fk_overlap(child, "k", parent, "k")) == [(2, 1, 0.5)]
    assert rows(quality.fk_overlap(child.filter("false"), "k", parent, "k")) == [(0, 0, 0.0)]


def test_calendar_without_current_year_is_stale(spark):
    cal = spark.createDataFrame([(dt.date(2020, 1, 1),)], "date_key DATE")
    flags = quality.calendar_flags(cal, dt.date(2024, 1, 1))
    got = quality.calendar_staleness(flags, dt.date(2024, 1, 1)).collect()[0]
    assert (got["status"], got["days_behind"]) == ("stale", None)


# ---- evals -----------------------------------------------------------------------

ITER = (
    "run_id STRING, iteration INT, eval_scope STRING, event_ts TIMESTAMP, overall_accuracy DOUBLE, evaluated_count INT,"
    " correct_count INT, rolled_back BOOLEAN, is_champion BOOLEAN, attempt_no INT, ordinal BIGINT"
)


def iteration(n, it, scope="full", acc=50.0, ev=None, ok=None, back=False, champ=False, attempt=None, run="r"):
    return (run, it, scope, dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), acc, ev, ok, back, champ, attempt, n)


def scores(spark, its):
    return rows(evals.run_scores(spark.createDataFrame(its, ITER)))


def test_run_scores_cases(spark):
    assert scores(spark, [iteration(1, 0, "slice", 100.0)]) == [("r", None, None, None, None, None)]
    assert scores(spark, [iteration(1, 0, acc=60.0)]) == [("r", 60.0, 60.0, 0, 0, "full")]
    tie = [iteration(1, 0, acc=60.0), iteration(2, 1, acc=80.0), iteration(3, 2, acc=80.0)]
    assert scores(spark, tie) == [("r", 60.0, 80.0, 0, 1, "full")]
    rolled = [iteration(1, 0, acc=60.0, back=True), iteration(2, 1, acc=90.0, back=True), iteration(3, 2, acc=55.0)]
    assert scores(spark, rolled) == [("r", 60.0, 60.0, 0, 0, "full")]
    reentry = [iteration(1, 0, acc=60.0), iteration(2, 0, acc=70.0), iteration(3, 0, "enrichment", 65.0)]
    assert scores(spark, reentry) == [("r", 60.0, 70.0, 0, 0, "enrichment")]
    assert scores(spark, [iteration(1, 0, None, 60.0, ev=4, ok=3)]) == [("r", 75.0, 75.0, 0, 0, "full")]


def test_champion_fallbacks(spark):
    def pick(*its):
        return evals.champion(spark.createDataFrame(list(its), ITER)).collect()[0]["ordinal"]

    assert pick(iteration(1, 1, acc=10.0), iteration(2, 1, "slice", 99.0)) == 1
    assert pick(iteration(1, 1, acc=90.0), iteration(2, 1, acc=20.0, champ=True)) == 2
    assert pick(iteration(1, 1, acc=90.0, back=True), iteration(2, 1, acc=20.0)) == 2
    assert pick(iteration(1, 0, acc=90.0, back=True), iteration(2, 1, acc=20.0)) == 1
    assert pick(iteration(1, 1, acc=30.0, back=True), iteration(2, 1, acc=40.0, back=True)) == 2
    assert pick(iteration(1, 1, "slice", 30.0), iteration(2, 1, "slice", 30.0)) == 1


def test_attempts_recover_reentry(spark):
    its = [
        iteration(1, 0, attempt=0, acc=50.0, champ=True), iteration(2, 0, attempt=0, acc=70.0, champ=True),
        iteration(3, 1, attempt=1, acc=60.0), iteration(4, 2, attempt=1, acc=65.0), iteration(5, 1, "slice", attempt=2),
    ]
    got = {r["ordinal"]: (r["attempt_no"], r["recovered"], r["is_champion"]) for r in evals.attempts(spark.createDataFrame(its, ITER)).collect()}
    assert got == {4: (1, False, False), 2: (2, True, True)}


def test_trajectory_takes_free_numbers(spark):
    its = [iteration(1, 0, attempt=0, acc=50.0), iteration(2, 0, attempt=0, acc=51.0), iteration(3, 0, attempt=0, acc=52.0),
           iteration(4, 1, attempt=1, acc=60.0), iteration(5, 2, attempt=3, acc=65.0)]
    got = {r["ordinal"]: (r["attempt_no"], r["delta_vs_baseline"], r["is_baseline"]) for r in evals.trajectory(spark.createDataFrame(its, ITER)).collect()}
    assert got == {1: (None, 0.0, True), 2: (2, 1.0, False), 3: (4, 2.0, False), 4: (1, 10.0, False), 5: (3, 15.0, False)}


def sign(spark, control, candidate):
    make = lambda xs: spark.createDataFrame([("r", *x) for x in xs], "run_id STRING, question_id STRING, assessment STRING")
    return evals.sign_test(make(control), make(candidate)).collect()[0]


def test_sign_test_cases(spark):
    def pair(wins, losses, ties=0):
        n = wins + losses + ties
        a = [(f"q{k}", "BAD" if k < wins else "GOOD") for k in range(n)]
        b = [(f"q{k}", "GOOD" if k < wins or k >= wins + losses else "NEEDS_REVIEW") for k in range(n)]
        return a, b

    r = sign(spark, *pair(5, 2))
    assert r["p_value"] == pytest.approx(29 / 128) and not r["passes"] and r["reason"] == "insufficient_paired_evidence"
    r = sign(spark, *pair(37, 0))
    assert r["passes"] and r["wins"] == 37
    r = sign(spark, *pair(0, 0, 4))
    assert r["p_value"] == 1.0 and r["reason"] == "no_discordant_pairs" and r["valid"]
    assert sign(spark, [("a", "GOOD"), ("a", "BAD")], [("a", "GOOD")])["reason"] == "duplicate_question_id"
    assert sign(spark, [("a", "GOOD")], [("b", "GOOD")])["reason"] == "question_id_mismatch"
    assert sign(spark, [("a", "odd")], [("a", "GOOD")])["reason"] == "unscored_row"
    assert sign(spark, [(" ", "GOOD")], [(" ", "GOOD")])["reason"] == "missing_question_id"
    bad = sign(spark, [("a", "GOOD")], [])
    assert bad["reason"] == "missing_rows" and bad["p_value"] == 1.0 and not bad["valid"]


def test_rolled_back_may_be_text(spark):
    df = spark.createDataFrame([("yes",), (" T ",), ("0",), (None,)], "rolled_back STRING")
    assert [r[0] for r in df.select(evals.truthy(df, "rolled_back")).collect()] == [True, True, False, False]


# ---- text ------------------------------------------------------------------------


def test_gap_evidence_prefers_two_users(spark):
    t = dt.datetime(2024, 1, 1)
    msgs = [("q 1?", "c1", "", "COMPLETED", None), ("q 2", "c2", "u1", "COMPLETED", None), ("q 3", "c3", "u1", "FAILED", None),
            ("q 4", "c4", "u2", "COMPLETED", "DISLIKE"), ("q 5", "c5", "u3", "COMPLETED", None), ("q 6", "c6", "u9", "EXECUTING", None)]
    df = spark.createDataFrame([(*m, t, k) for k, m in enumerate(msgs)],
                               "content STRING, conversation_id STRING, user_key STRING, status STRING, feedback STRING, created_at TIMESTAMP, ordinal BIGINT")
    term = text.terminal_messages(df)
    gaps = text.coverage_gaps(text.families(term), spark.createDataFrame([("other",)], "question STRING"))
    got = [r["conversation_id"] for r in text.gap_evidence(term, gaps).orderBy("rank").collect()]
    assert got == ["c2", "c4", "c3"]
    none = text.coverage_gaps(text.families(term), spark.createDataFrame([("Q 99.",)], "question STRING"))
    assert none.count() == 0


def test_renumbered_ids_are_unique(spark):
    ids = ["a", "a", "a:v2", "a", "b", "", "a:v2", None]
    df = spark.createDataFrame(list(enumerate(ids)), "ordinal BIGINT, question_id STRING")
    got = {r["ordinal"]: r["new_id"] for r in text.renumber_ids(df, block=2).collect()}
    assert got == {0: "a", 1: "a:v3", 2: "a:v2", 3: "a:v4", 4: "b", 5: "", 6: "a:v2:v2", 7: None}


def test_dedup_keeps_blank_and_prefers_user(spark):
    cols = "question_id INT, ordinal BIGINT, question STRING, expected_sql STRING, source STRING, validation_status STRING, priority STRING, provenance STRING"
    data = [
        (1, 1, "What  IS it", "x", "generated", "valid", "P0", "curated"), (2, 2, "[tag] what is it", "", "user", None, None, None),
        (3, 3, " ", "x", None, None, None, None), (4, 4, None, "x", None, None, None, None),
    ]
    df = spark.createDataFrame(data, cols)
    assert sorted(r["question_id"] for r in text.dedup_winners(df, "[tag] ").collect()) == [2, 3, 4]
    assert [(r["question_id"], r["retained_id"]) for r in text.dedup_rejected(df, "[tag] ").collect()] == [(1, 2)]


@pytest.mark.parametrize(
    "sql,codes",
    [
        ("SELECT a FROM t LIMIT 5", {"UNORDERED_LIMIT"}),
        ("SELECT a FROM t ORDER BY a LIMIT 5", set()),
        ("SELECT a FROM (SELECT a FROM t ORDER BY a) x LIMIT 5", {"UNORDERED_LIMIT"}),
        ("WITH c AS (SELECT a FROM t LIMIT 5) SELECT a FROM c ORDER BY a", {"UNORDERED_LIMIT"}),
        ("SELECT 'LIMIT 1' AS s, \"limit 2\" FROM t -- LIMIT 3\n/* now() */", set()),
        ("SELECT a, row_number() OVER (ORDER BY b) FROM t LIMIT 5", {"UNORDERED_LIMIT"}),
        ("SELECT uuid(), now()", {"NONDETERMINISTIC_SQL", "VOLATILE_TIME_REFERENCE"}),
        ("SELECT a FROM t ORDER BY a LIMIT 1 UNION ALL SELECT b FROM u LIMIT 1", {"UNORDERED_LIMIT"}),
        ("  ", set()),
    ],
)
def test_statement_findings(spark, sql, codes):
    df = spark.createDataFrame([(1, sql)], "question_id INT, expected_sql STRING")
    assert {r["code"] for r in text.statement_findings(df).collect()} == codes


@pytest.mark.parametrize(
    "line,is_sql",
    [
        ("Do not join orders to items", False),
        ("Where applicable, group by urgency", False),
        ("SELECT a FROM t", True),
        ("- Use: SELECT a FROM t", True),
        ("JOIN dim ON", True),
        ("Never order by x.a where y.b applies", False),
        ("order by x.a having more", True),
        ("", False),
    ],
)
def test_sql_in_prose(spark, line, is_sql):
    df = spark.createDataFrame([(1, "ok\r\n" + line)], "doc_id INT, body STRING")
    assert [r["line"] for r in text.sql_in_prose(df).collect()] == ([line] if is_sql else [])


def test_leak_decisions(spark):
    corpus = spark.createDataFrame([(1, "total revenue by region and month", "SELECT sum(r) FROM sales")], "item_id INT, question STRING, sql_text STRING")
    arts = spark.createDataFrame(
        [
            (1, "k", "Show me total revenue by region and month", "select sum(r)  from sales -- same"),
            (2, "k", "total revenue by region and year month", "SELECT sum(r) FROM sale"),
            (3, "k", "total revenue, by region and month?", "DELETE x"),
            (4, "k", "something else", "SELECT sum(r) FROM sales"),
            (5, "k", "something else", "DELETE x"),
        ],
        "artifact_id INT, kind STRING, question STRING, sql_text STRING",
    )
    got = {r["artifact_id"]: (r["decision"], r["reason"]) for r in text.leak_decisions(arts, corpus, strict=False).collect()}
    assert got == {
        1: ("block", "exact_question_and_sql"),
        2: ("block", "high_question_and_sql_similarity"),
        3: ("block", "benchmark_question_echo"),
        4: ("warn", "sql_pattern_overlap_warning"),
        5: ("pass", None),
    }
    strict = {r["artifact_id"]: (r["decision"], r["reason"]) for r in text.leak_decisions(arts, corpus).collect()}
    assert strict[4] == ("block", "sql_pattern_overlap_strict")


# ---- ranking ----------------------------------------------------------------------


def test_old_use_is_dropped(spark):
    as_of = dt.datetime(2024, 6, 1)
    use = lambda days, shape, role, scoped=False: ("t", "c", role, shape, scoped, as_of - dt.timedelta(days=days))
    df = spark.createDataFrame([use(91, "old", "join"), use(3, "s", "filter", True), use(20, "s", "filter"), use(10, "p", "projection")],
                               "table_name STRING, column_name STRING, sql_role STRING, shape_id STRING, in_scope BOOLEAN, start_time TIMESTAMP")
    r = ranking.history_score(df, as_of).collect()[0]
    import math
    assert r["shapes"] == 2 and r["score"] == pytest.approx(5 * 1.0 * (1 + math.log1p(1)) * 2 + 1 * 0.5)


def sequential_plan(cols, core, slots, initial, seed):
    """The rule as written: append in order until full."""
    import hashlib

    ranked = sorted(cols, key=lambda c: c["stable_rank"])
    chosen = [c for c in ranked if c["is_hard"] and not c["hidden"]][:50]
    for c in ranked:
        if len(chosen) >= core:
            break
        if c not in chosen and not c["hidden"]:
            chosen.append(c)
    rest = [c for c in ranked if c not in chosen and not c["hidden"]]
    h = lambda c: hashlib.sha256((seed + c["column_id"]).encode()).hexdigest()
    have = {c["structural_class"] for c in chosen}
    order = []
    for cat in ranking.CATEGORY_ORDER:
        some = [c for c in rest if c["structural_class"] == cat]
        if cat not in have and some:
            order.append(min(some, key=h))
    order += sorted([c for c in rest if c not in order], key=h)
    n = max(0, min(slots, initial - len(chosen)))
    return {c["column_id"] for c in chosen}, {c["column_id"] for c in order[:n]}


@pytest.mark.parametrize("seed", range(6))
def test_selection_equals_the_sequential_rule(spark, seed):
    import random

    rng = random.Random(seed)
    cols = [
        {"column_id": f"c{k}", "stable_rank": k + 1, "is_hard": rng.random() < 0.2, "hidden": rng.random() < 0.15,
         "structural_class": rng.choice(ranking.CATEGORY_ORDER[: 3 + seed % 3]), "priority": 3}
        for k in range(rng.choice([5, 30, 70]))
    ]
    core, slots, initial = rng.choice([(4, 3, 8), (20, 5, 22), (40, 5, 45)])
    df = spark.createDataFrame([("t", c["column_id"], c["stable_rank"], c["is_hard"], c["hidden"], c["structural_class"], c["priority"]) for c in cols],
                               "table_name STRING, column_id STRING, stable_rank INT, is_hard BOOLEAN, hidden BOOLEAN, structural_class STRING, priority INT")
    out = ranking.explore(ranking.select_core(df, core), "s", slots, initial).collect()
    want = sequential_plan(cols, core, slots, initial, "s")
    assert ({r["column_id"] for r in out if r["selected"]}, {r["column_id"] for r in out if r["explored"]}) == want


def test_activate_evicts_or_reports_full(spark):
    plan = "table_name STRING, column_id STRING, stable_rank INT, active BOOLEAN, is_join_key BOOLEAN, protected BOOLEAN"
    ask = "table_name STRING, column_id STRING, reason STRING"
    df = spark.createDataFrame(
        [("t", "a", 1, True, False, False), ("t", "b", 2, True, True, False), ("t", "c", 3, False, False, False),
         ("u", "a", 1, True, True, False), ("u", "c", 2, False, False, False), ("v", "a", 1, True, False, False)], plan)
    req = spark.createDataFrame([("t", "c", "REPAIR"), ("u", "c", "REPAIR"), ("v", "a", "REPAIR")], ask)
    got = {(r["table_name"], r["column_id"]): (r["active"], r["eviction_reason"], r["status"]) for r in ranking.activate(df, req, 2).collect()}
    assert got[("t", "a")] == (False, "promoted:c", "activated") and got[("t", "b")][0] and got[("t", "c")][0]
    assert ranking.activate(df.filter("table_name = 'u'"), req, 1).filter("status <> 'full'").count() == 0
    assert got[("v", "a")][2] == "already_active"


# ---- catalog ----------------------------------------------------------------------


def test_neighbours_on_a_chain(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "b")], "source_table STRING, target_table STRING")
    assert sorted(rows(catalog.neighbours(e))) == [("a", "downstream", "b"), ("b", "downstream", "c"), ("b", "upstream", "a"), ("c", "upstream", "b")]


def test_governance_precedence(spark):
    a = spark.createDataFrame(
        [("base", False, True, True, False, False), ("dark", False, False, False, False, False), ("v1", True, True, False, False, False),
         ("v2", True, True, False, False, False), ("v3", True, True, False, False, False), ("t", False, True, False, True, False)],
        "asset STRING, is_view BOOLEAN, readable BOOLEAN, has_row_filter BOOLEAN, has_column_mask BOOLEAN, is_dynamic BOOLEAN")
    b = spark.createDataFrame([("v1", "base"), ("v1", "dark"), ("v2", "dark"), ("v3", "v1")], "asset STRING, base STRING")
    got = {r["asset"]: r["verdict"] for r in catalog.governance_verdicts(a, b).collect()}
    assert got == {"base": "tainted", "dark": "unknown", "v1": "tainted", "v2": "unknown", "v3": "clean", "t": "tainted"}


def card(spark, doc, accuracy=None):
    df = spark.createDataFrame([(1, json.dumps(doc), accuracy)], "doc_id INT, document STRING, accuracy DOUBLE")
    out = catalog.scorecard(df)
    return {r["check_no"]: r["severity"] for r in out.collect()}, catalog.maturity(out).collect()[0]


def full_document():
    col = lambda n: {"column_name": n, "description": "A useful text", "enable_entity_matching": True}
    return {
        "description": ["Sales of all regions by month, customer segment and product line, ", "for the finance team and its planning rounds."],
        "data_sources": {"tables": [{"name": "t", "description": "Sales by day", "columns": [col("region"), col("amount")]}]},
        "instructions": {
            "text_instructions": [{"content": ["Report revenue net of returns ", "and always in US dollars, please."]}],
            "sql_snippets": {"measures": [{"id": "m"}], "filters": [{"id": "f"}]},
        },
        "benchmarks": {"questions": [{"id": str(k)} for k in range(20)]},
    }


def test_scorecard_documents(spark):
    checks, mark = card(spark, full_document(), 0.9)
    assert set(checks.values()) == {"pass"} and (mark["score"], mark["maturity"]) == (12, "Trusted")
    checks, mark = card(spark, full_document(), 0.5)
    assert checks[12] == "fail" and mark["maturity"] == "Ready to Optimize"
    checks, mark = card(spark, {})
    assert mark["score"] == 0 and mark["maturity"] == "Not Ready"
    view_only = {"data_sources": {"metric_views": [{"name": "m"}]}}
    checks, _ = card(spark, view_only)
    assert (checks[2], checks[3], checks[5], checks[6]) == ("pass", "pass", "pass", "pass")
    many = {"data_sources": {"tables": [{"name": f"t{k}"} for k in range(13)]}}
    assert card(spark, many)[0][6] == "fail"
    noisy = {"data_sources": {"tables": [{"name": "t", "columns": [{"column_name": f"raw_{k}"} for k in range(20)]}]}}
    assert card(spark, noisy)[0][10] == "fail"
    hidden = {"data_sources": {"tables": [{"name": "t", "columns": [{"column_name": f"raw_{k}", "exclude": True} for k in range(20)]}]}}
    assert card(spark, hidden)[0][10] == "pass"


def fingerprints_of(spark, *docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id int, document string")
    return [(r.config_fp, r.benchmark_fp) for r in catalog.fingerprints(frame).orderBy("doc_id").collect()]


def test_fingerprint_ignores_representation(spark):
    doc = full_document()
    turned = dict(reversed(list(doc.items())))
    quoted = {"config": {"note": "O'Reilly sells 'x'"}}
    plain = {"config": {"note": "O'Reilly sells x"}}
    got = fingerprints_of(
        spark, doc, {"serialized_space": json.dumps(turned), "_internal": 1}, {"_parsed_space": turned}, {**doc, "benchmarks": {}}, "not json", None,
        {"benchmarks": {"questions": "bad"}}, quoted, plain, {"serialized_space": doc, "_parsed_space": plain}, "[1]", {"other": 1}, {"config": {}, "_x": 2}, {"config": {}, "version": 2},
    )
    a = got[0]
    assert None not in a and got[1] == got[2] == got[9] == a
    assert got[3][0] == a[0] and got[3][1] != a[1]
    assert got[4] == got[5] == got[10] == got[11] == (None, None)
    assert got[6][0] is not None and got[6][1] is None
    assert got[7][0] == got[8][0] and got[12] == got[13]


def test_fingerprint_order_of_lists(spark):
    """Elements with ids have no order, others do; equal ids keep theirs; text lists are one text."""
    make = lambda x: {"config": {"rows": x, "content": ["a", "b"]}}
    ids = [{"id": "1", "v": 1}, {"id": "2", "v": 2}]
    twice = [{"id": "1", "v": 1}, {"id": "1", "v": 2}]
    got = fingerprints_of(
        spark, make(ids), make(ids[::-1]), make([1, 2]), make([2, 1]), make(twice), make(twice[::-1]), {"config": {"rows": ids, "content": "ab"}}, make([]), make({}), make(None),
    )
    config = [c for c, _ in got]
    assert config[0] == config[1] == config[6] and config[2] != config[3] and config[4] != config[5]
    assert len({config[0], config[2], config[4], config[7], config[8], config[9]}) == 6


def test_drift_of_documents_on_one_side(spark):
    schema = "doc_id int, document string"
    bad = json.dumps({"config": {"a": 1}, "benchmarks": {"questions": "none"}})
    stored = spark.createDataFrame([(1, '{"config": {"a": 1}}'), (2, '{"config": {"a": 1}}'), (3, "x"), (4, bad), (5, '{"config": {"a": 1}}')], schema)
    live = spark.createDataFrame([(1, '{"config": {"a": 1}}'), (2, '{"config": {"a": 2}}'), (3, "x"), (4, bad), (6, '{"config": {"a": 1}}')], schema)
    got = {r.doc_id: (r.config_drifted, r.benchmarks_drifted) for r in catalog.config_drift(stored, live).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (None, None), 4: (False, None), 5: (None, None), 6: (None, None)}


# ---- marts and streams --------------------------------------------------------------


def test_snapshot_boundaries(spark):
    d = dt.date
    m = spark.createDataFrame(
        [(1, "u", d(2024, 1, 31), d(2024, 2, 29)), (2, "u", d(2024, 2, 1), None), (3, "u", d(2023, 5, 5), d(2024, 1, 1)), (4, "w", d(2024, 3, 1), d(2024, 3, 1))],
        "id INT, unit STRING, s DATE, e DATE")
    got = {(r["unit"], r["month"].month): (r["active"], r["active_at_start"], r["joins"], r["exits"])
           for r in marts.monthly_snapshot(m, "unit", "s", "e", d(2024, 1, 1), 3).collect()}
    assert got == {("u", 1): (1, 1, 1, 1), ("u", 2): (1, 1, 1, 1), ("u", 3): (1, 1, 0, 0), ("w", 3): (0, 0, 1, 1)}


def test_stream_equals_batch(spark, tmp_path):
    rows_ = [("s1", dt.datetime(2024, 1, 1, h, m), 10, "FINISHED") for h in range(6) for m in (0, 30)]
    schema = "space_id STRING, start_time TIMESTAMP, task_ms BIGINT, execution_status STRING"
    path = str(tmp_path / "in")
    log = spark.createDataFrame(rows_, schema)
    log.coalesce(1).write.parquet(path)
    live = spark.readStream.schema(schema).parquet(path)
    stream.append_available(stream.hourly_usage(live), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["hr"].hour: r["queries"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {h: 2 for h in range(5)}
    live = spark.readStream.schema(schema).parquet(path)
    stream.upsert_available(stream.daily_usage(live), str(tmp_path / "log"), str(tmp_path / "cp2"))
    late = spark.createDataFrame([("s1", dt.datetime(2024, 1, 1, 1), 5, "FAILED")], schema)
    late.write.mode("append").parquet(path)
    live = spark.readStream.schema(schema).parquet(path)
    stream.upsert_available(stream.daily_usage(live), str(tmp_path / "log"), str(tmp_path / "cp2"))
    out = stream.read_upserted(spark, str(tmp_path / "log"), ["day", "space_id"]).collect()
    assert [(r["queries"], r["task_ms"]) for r in out] == [(13, 125)]
