from collections import Counter

from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import sharding


def test_maps_and_dotted_names(docs_of):
    docs = docs_of(["one", "two", None, ""]).withColumns({"m": F.create_map(F.lit("a"), "doc_id"), "nested": F.struct(F.create_map(F.lit(1), F.lit(2)).alias("x")), "a.b": F.lit(1)})
    got = sharding.deal(docs, shards=2).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3] and all(r.m == {"a": r.doc_id} and r["a.b"] == 1 for r in got)


def place(frame):
    return sorted((str(r.doc_id), str(r.text)[:40], r.shard, r.slot) for r in frame.select("doc_id", "text", "shard", "slot").collect())


def check(frame, rows, shards=8):
    dealt = [(r.shard, r.slot) for r in frame.select("shard", "slot").collect()]
    sizes = Counter(s for s, _ in dealt)
    assert len(dealt) == rows and len(set(dealt)) == rows
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == shards else 0) <= 1
    assert all(sorted(p for s, p in dealt if s == x) == list(range(sizes[x])) for x in sizes)


def test_every_row_has_one_gapless_slot(table):
    docs = table("documents")
    check(sharding.deal(docs, bucket_bytes=20_000), docs.count())
    check(sharding.deal(docs, shards=3), docs.count(), 3)


def test_the_order_depends_on_the_seed_and_not_on_the_layout(table):
    docs = table("documents")
    one = place(sharding.deal(docs, bucket_bytes=30_000))
    assert one == place(sharding.deal(docs.repartition(7), bucket_bytes=30_000))
    assert one != place(sharding.deal(docs, seed=8, bucket_bytes=30_000))


def test_buckets_keep_their_size(table):
    docs = table("documents")
    sizes = sharding.external_shuffle(docs, sharding.text_size("text"), bucket_bytes=40_000).groupBy("_bucket").agg(F.sum(F.octet_length("text")).alias("b"))
    assert sizes.agg(F.max("b")).first()[0] < 200_000


def test_rows_that_repeat_are_scattered(docs_of):
    docs = docs_of([(1, "the same row", "en", "s", 1)] * 3000 + [(i, f"row {i}", "en", "s", 1) for i in range(300)])
    sizes = [r["count"] for r in sharding.external_shuffle(docs, sharding.text_size("text"), bucket_bytes=2000).groupBy("_bucket").count().collect()]
    assert max(sizes) < 5 * sum(sizes) / len(sizes)
    check(sharding.deal(docs, bucket_bytes=2000), 3300)


def test_odd_rows_and_clashing_columns(docs_of):
    docs = docs_of([*ODD, (None, None, None, None, None)]).withColumns({"shard": F.lit("old"), "_Bucket": F.lit(1), "Slot": F.lit(2)})
    dealt = sharding.deal(docs)
    check(dealt, len(ODD) + 1)
    assert sorted(str(r.text) for r in dealt.collect()) == sorted(str(t) for t in [*ODD, None])
    assert sharding.deal(docs_of([])).count() == 0


def test_written_shards(docs_of, tmp_path, spark):
    dealt = sharding.deal(docs_of([f"text {i}" for i in range(50)]))
    sharding.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert place(back) == place(dealt)


def test_query(spark):
    from auditframe.llm.queries import QUERIES

    rows = QUERIES["op2_external_shuffle"](spark, "/root/testdata/sf0.001")
    check(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count())
    import zlib

    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows.collect())
