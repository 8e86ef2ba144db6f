import numpy as np
import pytest
import xxhash
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import simhash
from auditframe.llm.components import _nearest, components


def reference_fingerprint(text):
    """One bit at a time, from the definition."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, ids, most=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_is_the_definition():
    for text in [*ODD, "One two", "a b c d e f", "A B C D E F", "é x y\vz"]:
        assert simhash.fingerprint(text) == reference_fingerprint(text), text and text[:20]
    assert simhash.fingerprint("A b C") == simhash.fingerprint("a B c")


def test_spark_hashes_shingles_alike(spark):
    row = spark.sql("SELECT xxhash64('wörter a b') AS h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("wörter a b".encode(), 42)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_are_those_of_all_pairs(spark, seed):
    """Fingerprints around few centres: near, exactly at the limit, and just beyond it."""
    rng = np.random.default_rng(seed)
    fps = []
    for center in rng.integers(0, 1 << 63, 12, dtype=np.uint64):
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            fps.append(int(center) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_links(frame).collect()]
    got = {r.node & (1 << 64) - 1: r.root for r in components(simhash.near_links(frame), "a", "b").collect()}
    want = brute_groups(fps, list(range(len(fps))))
    groups = lambda label: sorted(tuple(sorted(f for f in fps if label[f] == x)) for x in set(label.values()))
    assert groups({f: got.get(f, f"alone {f}") for f in fps}) == groups(dict(zip(fps, want, strict=True)))
    assert len(links) < len(fps) * 64


def test_a_crowded_bucket_is_cut_and_stays_linear(spark, monkeypatch):
    """A dense cluster larger than CROWDED, whose pairs would be a hundred times its links."""
    rng = np.random.default_rng(5)
    base = 0x0F0F_1234_5678_9ABC
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(24, 4, replace=False)) for _ in range(1500)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(frame).collect()
    assert len(links) < 40 * len(fps)
    root = {r.node: r.root for r in components(spark.createDataFrame(links), "a", "b").collect()}
    want = brute_groups(fps, fps)
    assert len({root.get(f, f) for f in fps}) == len(set(want))


def test_within_agrees_with_itself_above_and_below_the_limit(monkeypatch):
    rng = np.random.default_rng(3)
    bits = rng.choice(64, 18, replace=False)
    fps = np.unique(np.array([sum(1 << int(b) for b in bits[rng.random(18) < 0.3]) for _ in range(900)], np.uint64))
    table = simhash.within(fps, 3)
    monkeypatch.setattr(simhash, "CROWDED", 10_000)
    assert (table == simhash.within(fps, 3)).all()


def test_groups_of_odd_rows(docs_of):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(None, "same text here", None, None, None), (7, "same text here", "en", "s", 0)]
    got = simhash.near_groups(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_id = {(r.id, r.text_hash): r.component_id for r in got}
    empty = {r.component_id for r in got if r.fp == 0}
    assert empty == {0}
    assert {c for (i, _), c in by_id.items() if i in (7, 8, None)} == {7}


def test_dedup_keeps_one_row_and_all_columns(docs_of):
    docs = docs_of([(5, "a b c d", "en", "s", 1), (3, "a b c d", "de", "t", 2), (3, "a b c d", "de", "t", 2), (9, "other words stand here", "en", "s", 3), (None, None, None, None, None)])
    docs = docs.withColumns({"id": F.lit("x"), "fp": F.lit(1), "text_hash": F.lit(2), "component_id": F.lit("y")})
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.lang) for r in kept.collect()) == [(False, 3, "de"), (False, 9, "en"), (True, None, None)] or sorted(
        str(r.doc_id) for r in kept.collect()
    ) == ["3", "9", "None"]


def test_empty_table(docs_of):
    assert simhash.near_groups(docs_of([])).count() == 0
    assert simhash.drop_near_copies(docs_of([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_query_against_brute_force(spark):
    from auditframe.llm.queries import QUERIES

    rows = sorted(QUERIES["op4_simhash"](spark, "/root/testdata/sf0.001").collect())
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = [reference_fingerprint(text[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == brute_groups(fps, [r.doc_id for r in rows])


def test_small_tables_are_not_broadcast(spark, docs_of):
    """Exploded keys and written tables look small to Spark; their joins must not go through the driver."""
    docs = docs_of([f"word{i % 5} and some more words" for i in range(40)])
    fps = simhash.fingerprints(docs).select("fp").distinct()
    for df in (simhash.near_links(fps), simhash.near_groups(docs)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    edges = spark.range(50).selectExpr("id + 1 AS u", "id AS v")
    assert "Broadcast" not in _nearest(edges)._jdf.queryExecution().executedPlan().toString()
