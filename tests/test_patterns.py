"""Many patterns against many texts, compared with plain Python."""

import datetime as dt
import random
import re

import pytest

from auditframe.functions.patterns import occurrences
from auditframe.operators import ranking, text

TEXT, PATTERN = "text string", "pattern string, whole boolean"


def plain(texts, patterns):
    out = set()
    for t in set(texts) - {None}:
        for p, whole in set(patterns):
            if p is None or p not in t:
                continue
            if not whole or re.search("(^|[^a-z0-9_])" + re.escape(p) + "([^a-z0-9_]|$)", t):
                out.add((t, p, whole))
    return out


def found(spark, texts, patterns):
    got = occurrences(spark.createDataFrame([(t,) for t in texts], TEXT), spark.createDataFrame(patterns, PATTERN))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_texts(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab._ \n+é") for _ in range(n))
    texts = [word(draw.randrange(0, 30)) for _ in range(150)] + [None, "", "ab", "ab"]
    patterns = [(word(draw.randrange(0, 6)), draw.random() < 0.5) for _ in range(150)] + [(None, True), ("", False), ("", True)]
    assert found(spark, texts, patterns) == plain(texts, patterns)


def test_quoting_and_edges(spark):
    texts = [r"x \E y", "a.c", "abc", "t1", "t10", "x_t1", "(t1)", "T1", "t1\n", "\U0001F600\U0001F600t1"]
    patterns = [(r"\E", False), (r"\E", True), ("a.c", False), ("t1", True), ("t1", False), ("\U0001F600", True), (r"\Q(", True)]
    assert found(spark, texts, patterns) == plain(texts, patterns)


def test_empty_sides(spark):
    assert found(spark, ["a"], []) == set() and found(spark, [], [("a", True)]) == set() and found(spark, [None], [(None, False)]) == set()


def test_frequent_patterns_and_long_texts(spark):
    texts = ["select x from t1 where k = " + str(i) for i in range(300)] + ["x " * 100_000 + "needle", "y" * 4094 + "select x", "y" * 4095 + "select x", "y" * 4096]
    patterns = [("t1", True), ("select x", False), ("needle", True), ("k = 29", False), ("absent", False)]
    assert found(spark, texts, patterns) == plain(texts, patterns)


def _log(spark, statements):
    rows = [(n, "s1" if n % 5 == 0 else None, dt.datetime(2024, 1, 15), "FINISHED", s) for n, s in enumerate(statements)]
    return spark.createDataFrame(rows, "statement_id int, space_id string, start_time timestamp, execution_status string, statement_text string")


def test_relevant_log_of_gives_the_rows_of_the_list(spark):
    names = ["main.sales.T1", "a+c", "b(y", "sales.orders", "x.", "é"]
    statements = ["select * from `main`.`sales`.`t1`", "from t1x", "a+c", "b(y", None, "", "sales.orders2", "orders", "orders_", "x.", "é", "caféteria"] * 2
    log = _log(spark, statements)
    many = spark.createDataFrame([(n,) for n in [*names, None]], "asset string")
    for space in (None, "s1"):
        want = [tuple(r) for r in ranking.relevant_log(log, names, dt.datetime(2024, 1, 20), target_space=space).collect()]
        got = [tuple(r) for r in ranking.relevant_log_of(log, many, dt.datetime(2024, 1, 20), target_space=space).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and got


def test_ten_thousand_assets_in_a_plan_of_one_size(spark):
    log = _log(spark, [f"select * from t{n}" for n in range(200)])
    plans = []
    for n in (10, 10_000):
        assets = spark.range(n).selectExpr("concat('main.sales.t', id) AS asset")
        rows = ranking.relevant_log_of(log, assets, dt.datetime(2024, 1, 20))
        assert rows.count() == min(n, 200)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert "CartesianProduct" not in plans[1] and "BroadcastNestedLoop" not in plans[1]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())


@pytest.mark.parametrize("words", [["Status"], ["promo", "x"], [""]])
def test_keyword_tables_gives_what_single_searches_give(spark, words):
    tables = spark.createDataFrame(
        [("t1", "status of things", 3), ("t2", None, None), ("promos", "other", 5), ("bare_status", None, 1)], "table_name string, table_comment string, last_altered long"
    )
    columns = spark.createDataFrame(
        [("t1", "a", "x"), ("t1", "b", None), ("t2", "promo_id", "Status"), ("promos", "c", "promo"), ("lost", "status", "s")], "table_name string, column_name string, description string"
    )
    got = text.keyword_tables(tables, columns, spark.createDataFrame([(w,) for w in words], "keyword string")).collect()
    for w in words:
        want = [tuple(r) for r in text.keyword_search(tables, columns, [w]).collect()]
        own = sorted((r for r in got if r.keyword == w.lower()), key=lambda r: r.place)
        assert [(r.table_name, r.table_comment, r.last_altered, r.matching_columns, r.total_columns) for r in own] == want


def test_rule_findings_of_gives_the_findings_of_the_list(spark):
    rules = [
        {"name": "a", "column": "Is_Active", "terms": ["active", "Current"], "issue": "extra {column}"},
        {"name": "b", "column": "key", "terms": [], "issue": "names {column}"},
        {"name": "c", "column": "absent", "terms": ["x"], "issue": "never"},
    ]
    rows = spark.createDataFrame(
        [(1, "Which?", "where is_active"), (2, "Current ones", "where IS_ACTIVE and key = 1"), (3, None, "key"), (3, None, "key"), (4, "q", None)],
        "question_id int, question string, expected_sql string",
    )
    many = spark.createDataFrame([tuple(r[c] for c in ("name", "column", "terms", "issue")) for r in rules], "name string, column string, terms array<string>, issue string")
    want = sorted(map(tuple, text.rule_findings(rows, rules).collect()))
    assert sorted(map(tuple, text.rule_findings_of(rows, many).collect())) == want and len(want) == 4
