"""The stored vector index against comparing all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.functions import vector_index as vi
from auditframe.operators import text as t
from auditframe.plans import all_queries

KIND = "id long, embedding array<double>"


def frame(spark, vectors, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], KIND.replace("id ", f"{name} ", 1))


def brute(left, right, threshold):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(left) @ unit(right).T
    return {i: (int(row.argmax()), row.max()) for i, row in enumerate(s) if row.max() >= threshold}


def test_recall_and_work_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    queries = all_queries()
    exact = {r.artifact_id: (r.item_id, r.score) for r in queries["tx_cosine_match"](spark, sf).collect()}
    found = {r.artifact_id: (r.item_id, r.score) for r in queries["tx_cosine_indexed"](spark, sf).collect()}
    right = sum(found.get(k) == v for k, v in exact.items())
    assert right >= 0.9 * len(exact) and len(exact) > 1000
    # A score is exact, so none is above the best.
    assert all(k in exact and found[k][1] <= exact[k][1] for k in found)


def test_work_is_a_small_share_of_all_pairs(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    t.index_corpus(vectors, str(tmp_path))
    _, left = vi._distinct(vectors, "item_id", "embedding")
    assert vi.candidates(left, str(tmp_path)).count() < 0.05 * left.count() ** 2


def test_without_clusters(spark, tmp_path):
    rng = np.random.default_rng(3)
    right = rng.standard_normal((1500, 40))
    left = right[:400] + rng.standard_normal((400, 40)) * 0.5
    t.index_corpus(frame(spark, right, "item_id"), str(tmp_path))
    found = {r.artifact_id: r.item_id for r in t.cosine_indexed(frame(spark, left, "artifact_id"), str(tmp_path)).collect()}
    want = brute(left, right, 0.85)
    assert sum(found.get(k) == v[0] for k, v in want.items()) >= 0.9 * len(want) > 100 and set(found) <= set(want)


def test_batches_are_found_and_written_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    old, new = rng.standard_normal((50, 8)), rng.standard_normal((50, 8))
    t.index_corpus(frame(spark, old, "item_id"), str(tmp_path))
    later = frame(spark, new, "item_id").withColumn("item_id", F.col("item_id") + 1000)
    for _ in range(2):  # a batch that is written again replaces itself
        vi.append_vectors(later, str(tmp_path), "1", "item_id")
    # The same vector in a third batch counts once, under the least id.
    vi.append_vectors(frame(spark, new[:1], "item_id").withColumn("item_id", F.lit(5000).cast("long")), str(tmp_path), "2", "item_id")
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 101
    found = t.cosine_indexed(frame(spark, new * 3, "artifact_id"), str(tmp_path)).collect()
    assert {r.artifact_id: r.item_id for r in found} == {i: 1000 + i for i in range(50)} and all(abs(r.score - 1) < 1e-12 for r in found)
    with pytest.raises(Exception, match="8 dimensions"):
        vi.append_vectors(frame(spark, [[1.0, 2.0]], "item_id"), str(tmp_path), "3", "item_id")


def test_odd_vectors(spark, tmp_path):
    odd = [None, [], [0.0, 0.0], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [1.0]]
    t.index_corpus(frame(spark, odd[:8], "item_id"), str(tmp_path))
    found = {r.artifact_id: r.item_id for r in t.cosine_indexed(frame(spark, odd, "artifact_id"), str(tmp_path)).collect()}
    assert found == {5: 5, 6: 5, 7: 5}
    t.index_corpus(frame(spark, [], "item_id"), f"{tmp_path}/none")
    assert t.cosine_indexed(frame(spark, odd, "artifact_id"), f"{tmp_path}/none").collect() == []
