"""Copy-on-write tables: merges against the newest row per key of the whole log, versions, crashes and conflicts."""

import os

import pytest
from pyspark.sql import functions as F

from auditframe.operators import merge as m
from auditframe.operators.io import latest_wins
from auditframe.streaming import usage as s

SCHEMA = "k int, `k 2` string, v string, ts int"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def contents(spark, path, number=None):
    return sorted(map(tuple, m.read_table(spark, path, number).collect()), key=str)


def test_merges_equal_the_newest_rows_of_the_log(spark, tmp_path):
    log = spark.range(3000).select((F.col("id") * 7919 % 500).cast("int").alias("k"), F.lit("x").alias("k 2"), F.col("id").cast("string").alias("v"), (F.col("id") * 31 % 997).cast("int").alias("ts"))
    order = [F.desc("ts"), F.desc("v")]
    path = str(tmp_path / "t")
    m.create_table(log.filter("v % 4 = 0"), path, ["k", "k 2"], order)
    for part in (1, 2, 3):
        m.merge(log.filter(f"v % 4 = {part}"), path, order)
    want = latest_wins(log, ["k", "`k 2`"], order).select("k", "k 2", "v", "ts").collect()
    assert contents(spark, path) == sorted(map(tuple, want), key=str) and len(want) == 500


def test_only_touched_buckets_are_written_and_old_versions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    old = m.create_table(rows(spark, [(i, "a", "old", 1) for i in range(400)]), path, ["k"], buckets=8)
    new = m.merge(rows(spark, [(7, "b", "new", 2), (1000, "b", "new", 2)]), path)
    changed = [b for b, f in new.folders.items() if old.folders.get(b) != f]
    assert 1 <= len(changed) <= 2 and len(new.folders) == 8
    assert len(contents(spark, path)) == 401 and (7, "b", "new", 2) in contents(spark, path)
    assert contents(spark, path, 1) == sorted([(i, "a", "old", 1) for i in range(400)], key=str)
    # A lookup opens the files of one bucket of eight.
    found = m.lookup(spark, path, spark.createDataFrame([(7,)], "k int"))
    assert list(map(tuple, found.collect())) == [(7, "b", "new", 2)]
    assert len(found.inputFiles()) <= len(m.read_table(spark, path).inputFiles()) / 4


def test_a_crash_before_the_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    m.create_table(rows(spark, [(1, "a", "old", 1), (2, "a", "old", 1)]), path, ["k"])

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(m, "_commit", crash)
        with pytest.raises(OSError, match="lost"):
            m.merge(rows(spark, [(1, "a", "new", 2)]), path)
    assert contents(spark, path) == [(1, "a", "old", 1), (2, "a", "old", 1)] and m.read_version(spark, path).number == 1
    m.merge(rows(spark, [(1, "a", "new", 2)]), path)
    assert contents(spark, path) == [(1, "a", "new", 2), (2, "a", "old", 1)]
    # The folder of the crash and the replaced bucket go; what the kept version names stays.
    assert m.clean(spark, path, keep=1) >= 2
    assert contents(spark, path) == [(1, "a", "new", 2), (2, "a", "old", 1)] and m._versions(spark, path) == [2]


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    first = m.create_table(rows(spark, [(1, "a", "old", 1)]), path, ["k"])
    m.merge(rows(spark, [(1, "a", "mine", 2)]), path)
    with pytest.raises(m.Conflict):
        m._commit(spark, path, m.Version(2, first.keys, first.buckets, first.schema, first.folders))
    assert contents(spark, path) == [(1, "a", "mine", 2)]
    assert not [f for f in os.listdir(tmp_path / "t/manifest") if f.startswith(".") and not f.endswith(".crc")]


def test_null_keys_repeated_keys_and_empty_merges(spark, tmp_path):
    path = str(tmp_path / "t")
    m.create_table(rows(spark, []), path, ["k", "k 2"])
    assert contents(spark, path) == []
    m.merge(rows(spark, [(None, None, "one", 1), (None, "a", "two", 1)]), path)
    m.merge(rows(spark, [(None, None, "three", 3), (None, None, "four", 4)]), path, [F.desc("ts")])
    m.merge(rows(spark, []), path)
    assert contents(spark, path) == [(None, "a", "two", 1), (None, None, "four", 4)] and m.read_version(spark, path).number == 4
    with pytest.raises(ValueError):
        m.read_table(spark, path, 9)


def test_a_batch_of_a_stream_counts_once(spark, tmp_path):
    schema = "space_id string, start_time timestamp, task_ms long"
    made = spark.range(100).select((F.col("id") % 3).cast("string").alias("space_id"), F.timestamp_seconds(F.col("id") * 9000).alias("start_time"), F.col("id").alias("task_ms"))
    made.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    s.merge_available(s.daily_usage(stream), table, ["day", "space_id"], checkpoint)
    want = sorted(map(tuple, s.daily_usage(made).collect()), key=str)
    assert contents(spark, table) == want
    version = m.read_version(spark, table)
    assert version.marks == {checkpoint: 3}
    # The last batch runs again, as after a failure between its merge and the stream's own mark.
    for name in os.listdir(tmp_path / "c/commits"):
        if name.strip(".").startswith("3"):
            os.remove(tmp_path / "c/commits" / name)
    s.merge_available(s.daily_usage(stream), table, ["day", "space_id"], checkpoint)
    assert contents(spark, table) == want and m.read_version(spark, table).number == version.number
