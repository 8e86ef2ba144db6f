"""Samples of exact size against sorting by hash."""

import hashlib
from collections import Counter

import pytest

from auditframe.operators import profile

SCHEMA = "k int, `g.h` string, rank int"


def drawn(rows, n, seed, strata):
    """The same rows by sorting each stratum."""
    draw = lambda r: hashlib.md5("\x1f".join([str(seed)] + [str(r[0])] * (r[0] is not None)).encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if strata else 0, []).append(r)
    # Equal keys differ in their last column only, which has one digit.
    return Counter(r for g in groups.values() for r in sorted(g, key=lambda r: (draw(r), r[2]))[:n])


@pytest.mark.parametrize(("n", "strata"), [(0, True), (1, True), (25, True), (25, False), (5000, True), (700, False)])
def test_the_smallest_hashes_of_each_stratum(spark, n, strata):
    rows = [(k % 900, "hot" if k % 3 else None, k % 7) for k in range(2000)] + [(None, "b", 1)] * 3 + [(7, "hot", 1)] * 400
    df = spark.createDataFrame(rows, SCHEMA)
    by = ["g.h"] if strata else None
    want = drawn(rows, n, 4, strata)
    for parts in (1, 7):
        got = profile.exact_sample(df.repartition(parts), ["k"], n, by, seed=4)
        assert got.columns == df.columns
        assert Counter(tuple(r) for r in got.collect()) == want


def test_empty_table(spark):
    assert profile.exact_sample(spark.createDataFrame([], SCHEMA), ["k"], 5).count() == 0
