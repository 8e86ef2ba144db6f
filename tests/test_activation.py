"""Ordered activation requests, compared with a loop over single requests."""

import random

from auditframe.operators import ranking

PLAN = "table_name string, column_id string, stable_rank int, active boolean, protected boolean, hidden boolean, reason_codes array<string>"
ASKED = "table_name string, column_id string, reason string, place long"
REASONS = ["REPAIR_FAILURE", "EXPLORATION", "JOIN_KEY", "QUERY_HISTORY", "other", None]


def loop(plan, requests, most):
    rows = {(p[0], p[1]): {"rank": 999_999 if p[2] is None else p[2], "on": bool(p[3]), "fixed": bool(p[4]), "hidden": bool(p[5]), "codes": list(p[6] or []), "out": None, "why": None, "asked": 0, "no": 0} for p in plan}
    place = lambda c: ranking.REASON_PRIORITY.get(c, 99)
    for table, column, reason, _ in sorted((r for r in requests if r[0] and r[1]), key=lambda r: (r[3], r[1], r[2] or "EXPLORATION")):
        reason, own = reason or "EXPLORATION", rows.get((table, column))
        if own is None:
            continue
        own["asked"] += 1
        if own["hidden"]:
            own["no"] += 1
        elif not own["on"]:
            on = [(k, r) for k, r in rows.items() if k[0] == table and r["on"]]
            can = sorted((r["rank"], k[1]) for k, r in on if not r["fixed"] and "JOIN_KEY" not in r["codes"])
            if len(on) >= most and not can:
                own["no"] += 1
                continue
            if len(on) >= most:
                rows[table, can[-1][1]] |= {"on": False, "out": f"promoted:{column}"}
            own |= {"on": True, "why": reason.lower(), "codes": sorted({*own["codes"], reason}, key=lambda c: (place(c), c))}
    return sorted(
        (*k, r["rank"], r["on"], r["out"], r["why"], r["codes"], min(map(place, r["codes"]), default=None), r["asked"], r["no"]) for k, r in rows.items()
    )


def test_random_plans(spark):
    draw = random.Random(11)
    plan, asked = [], []
    for t in range(40):
        for c in range(draw.randrange(1, 9)):
            codes = draw.sample(["JOIN_KEY", "QUERY_HISTORY", "EXPLORATION", "other"], draw.randrange(0, 3))
            plan.append((f"t{t}", f"c{c}", draw.choice([1, 2, 2, 3, None]), draw.random() < 0.5, draw.choice([True, False, False, None]), draw.random() < 0.1, codes or None))
        asked += [(f"t{t}", f"c{draw.randrange(10)}", draw.choice(REASONS), draw.randrange(6)) for _ in range(draw.randrange(0, 12))]
    asked += [(None, "c1", "x", 1), ("t1", None, "x", 1), ("lost", "c1", "x", 1)]
    for most in (1, 3):
        got = ranking.activate_in_order(spark.createDataFrame(plan, PLAN), spark.createDataFrame(asked, ASKED), most).collect()
        assert sorted(map(tuple, got)) == loop(plan, asked, most)


def test_empty_sides(spark):
    row = ("t", "a", 1, True, False, False, ["JOIN_KEY"])
    got = ranking.activate_in_order(spark.createDataFrame([row], PLAN), spark.createDataFrame([], ASKED)).collect()
    assert [tuple(r) for r in got] == [("t", "a", 1, True, None, None, ["JOIN_KEY"], 2, 0, 0)]
    assert ranking.activate_in_order(spark.createDataFrame([], PLAN), spark.createDataFrame([("t", "a", "x", 1)], ASKED)).count() == 0


def test_requests_taken_from_the_plan(spark):
    plan = spark.createDataFrame([("t", "a", 1, True, False, False, None), ("t", "b", 2, False, False, False, None), ("t", "c", 3, False, False, False, None)], PLAN)
    asked = plan.filter("NOT active").selectExpr("table_name", "column_id", "CAST(NULL AS STRING) AS reason", "stable_rank AS place")
    got = {r.column_id: (r.active, r.eviction_reason) for r in ranking.activate_in_order(plan, asked, 1).collect()}
    assert got == {"a": (False, "promoted:b"), "b": (False, "promoted:c"), "c": (True, None)}
