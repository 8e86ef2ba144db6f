"""Stored tables with range digests against plain bags."""

import random
from collections import Counter

import pytest

from auditframe.operators import digest, equivalence

SCHEMA = "k int, s string, d double, l array<string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def kept(spark, tmp_path, name, rows, **how):
    folder = str(tmp_path / name)
    digest.put(frame(spark, rows), folder, **how)
    return folder


def random_rows(rng, n):
    return [(rng.choice([None, 1, -1, 2]), rng.choice([None, "", "a", "1"]), rng.choice([None, 0.0, -0.0, -1.5, float("inf")]), rng.choice([None, [], ["a"], [None, "a"], ["a", None]])) for _ in range(n)]


def test_counts_of_bags_with_copies_signs_and_nulls(spark, tmp_path):
    rng = random.Random(3)
    for turn in range(3):
        x, y = random_rows(rng, 60), random_rows(rng, 50)
        y += x[:20]
        a, b = kept(spark, tmp_path, f"a{turn}", x, ranges=16), kept(spark, tmp_path, f"b{turn}", y, ranges=16)
        key = lambda r: (*r[:3], r[3] if r[3] is None else tuple(r[3]))
        left, right = Counter(map(key, x)), Counter(map(key, y))
        want = ((left - right).total(), (right - left).total())
        assert tuple(digest.stored_setdiff_counts(spark, a, b).first()) == want
        assert tuple(equivalence.setdiff_counts(frame(spark, x), frame(spark, y)).first()) == want
        assert digest.stored_equal(spark, a, b).first()[0] is False


def test_rows_that_a_plain_hash_would_confuse(spark, tmp_path):
    pairs = [
        ([(None, "a", None, None)], [(None, None, None, ["a"])]),
        ([(1, "a", 0.0, [None, "a"])], [(1, "a", 0.0, ["a", None])]),
        ([(1, "x", 0.0, [])] * 2, [(1, "x", 0.0, [])] * 3),
        ([(1, "x", 1.0, []), (-1, "x", -1.0, [])], [(1, "x", -1.0, []), (-1, "x", 1.0, [])]),
    ]
    for turn, (x, y) in enumerate(pairs):
        a, b = kept(spark, tmp_path, f"a{turn}", x, ranges=1), kept(spark, tmp_path, f"b{turn}", y, ranges=1)
        assert digest.stored_equal(spark, a, b).first()[0] is False


def test_a_changed_row_reads_one_range(spark, tmp_path):
    x = [(k, "same", float(k), None) for k in range(2000)]
    y = [(k, "changed" if k == 777 else "same", float(k), None) for k in range(1999, -1, -1)]
    a = kept(spark, tmp_path, "a", x, keys=["k"], ranges=32)
    b = kept(spark, tmp_path, "b", y, keys=["k"], ranges=32)
    found = digest.differing_ranges(spark, a, b).collect()
    assert len(found) == 1 and found[0].a_rows == found[0].b_rows < 200
    assert {(r.c0, r.c1, r.surplus) for r in digest.stored_surplus(spark, a, b).collect()} == {(777, "same", 1), (777, "changed", -1)}
    plan = digest.stored_surplus(spark, a, b)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/rows" in line]
    assert len(scans) == 2 and all(f"= {found[0].range})" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scans)


def test_equal_tables_are_told_from_digests(spark, tmp_path):
    x = random_rows(random.Random(8), 300)
    a = kept(spark, tmp_path, "a", x, ranges=8)
    b = kept(spark, tmp_path, "b", x[:100], ranges=8)
    digest.put(frame(spark, x[100:][::-1]), b, batch="1", ranges=8)
    same = digest.stored_equal(spark, a, b)
    assert same.first()[0] is True
    assert all("/digests/" in f for f in same.inputFiles())
    assert tuple(digest.stored_setdiff_counts(spark, a, b).first()) == (0, 0)


def test_attempts_that_failed_are_not_read(spark, tmp_path):
    x = random_rows(random.Random(9), 40)
    a, b = kept(spark, tmp_path, "a", x, ranges=8), kept(spark, tmp_path, "b", x, ranges=8)
    # Rows of a batch whose digests were never written.
    left = kept(spark, tmp_path, "c", random_rows(random.Random(1), 30), batch="1", ranges=8)
    (tmp_path / "c" / "rows" / "batch=1").rename(tmp_path / "b" / "rows" / "batch=1")
    assert left and digest.stored_equal(spark, a, b).first()[0] is True
    more = frame(spark, [(5, "new", 1.0, None)])
    digest.put(more, b, batch="1", ranges=8)
    assert tuple(digest.stored_setdiff_counts(spark, a, b).first()) == (0, 1)
    with pytest.raises(ValueError):
        digest.put(more, b, batch="1", ranges=8)
    with pytest.raises(ValueError):
        digest.put(more, b, batch="2", ranges=4)


def test_empty_tables(spark, tmp_path):
    a, b = kept(spark, tmp_path, "a", []), kept(spark, tmp_path, "b", [])
    assert digest.stored_equal(spark, a, b).first()[0] is True
    c = kept(spark, tmp_path, "c", [(1, None, None, None)])
    assert digest.stored_equal(spark, a, c).first()[0] is False
    assert tuple(digest.stored_setdiff_counts(spark, a, c).first()) == (0, 1)
