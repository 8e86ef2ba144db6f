"""Near copies by SimHash: fingerprints, deletion-variant join, connected components."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written
from auditframe.llm._table import packed
from auditframe.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Members of a bucket that are compared at once; a larger bucket is cut again.
CROWDED = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash over word shingles, each hashed by XXH64 with seed 42; ASCII letters are lower-cased.

    A text of fewer words is one shingle. A text without words, and a null
    text, has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    spans = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in spans), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):  # a very long text needs no more memory than this
        octets = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id``, ``text_hash`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["id", "text_hash", "fp"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, "id long, text_hash long, fp long")


def _wildcards(bits: str, width: int, mark: int) -> str:
    """SQL for the variants of a segment: one per position, with that bit cleared and the position noted above it."""
    return (
        f"transform(sequence(0, {width - 1}), i -> shiftleft(cast({mark * width} + i AS bigint), {width})"
        f" | ({bits} & ~shiftleft(1L, i)))"
    )


def _keys(bits: str, width: int) -> str:
    """SQL for the variants of a value of 2 * width bits, cut into two segments."""
    low = f"({bits} & {(1 << width) - 1}L)"
    return f"concat({_wildcards(low, width, 0)}, {_wildcards(f'shiftrightunsigned({bits}, {width})', width, 1)})"


def within(fps: np.ndarray, most: int) -> np.ndarray:
    """For each of the distinct fingerprints the position of the first one that near fingerprints lead to.

    Up to CROWDED members are compared with one another. More members differ
    in few positions only (18 in a bucket that was cut twice), so that each
    looks up the values near it in a table of those positions.
    """
    n = len(fps)
    root = np.arange(n)
    if n <= CROWDED:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most
        while True:
            least = np.where(near, root[None, :], n).min(1)
            if (least == root).all():
                return root
            root = least
    free = [b for b in range(64) if ((fps ^ fps[0]) >> np.uint64(b) & np.uint64(1)).any()]
    place = np.zeros(n, np.int64)
    for i, b in enumerate(free):
        place |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    table = np.full(1 << len(free), n)
    table[place] = root
    masks = [sum(1 << i for i in c) for w in range(1, most + 1) for c in combinations(range(len(free)), w)]
    while True:
        for mask in masks:
            np.minimum(root, table[place ^ mask], out=root)
        if (table[place] == root).all():
            return root
        table[place] = root


def _link(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for fps in b.column(0):
                own = np.unique(np.asarray(fps.values, dtype=np.int64)).view(np.uint64)
                root = within(own, most)
                moved = root != np.arange(len(own))
                a.append(own[moved])
                z.append(own[root[moved]])
            pair = [pa.array(np.concatenate([*x, np.empty(0, np.uint64)]).view(np.int64)) for x in (a, z)]
            yield pa.RecordBatch.from_arrays(pair, ["a", "b"])

    return run


def near_links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``fp`` at ``most`` (up to 3) or fewer differing bits.

    Two fingerprints at three bits differ by at most one in one of their two
    halves. So every half is indexed under 32 variants, each with one bit as a
    wildcard, and equal variants meet. Keys that occur once are dropped by a
    count that is combined before its shuffle. A bucket of more than CROWDED
    fingerprints is cut once more by its other half in the same way; what
    meets there shares 46 bits, so no bucket can outgrow 2**18 members,
    whatever the corpus. A bucket yields a link to the first member of each
    group, never its pairs; which links hold is decided on the bits.
    """
    if not 0 <= most <= 3:
        raise ValueError("two halves with one wildcard find up to three differing bits")
    rows = fps.select("fp").withColumn("key", F.explode(F.expr(_keys("fp", 32))))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # The half that the key does not hold: the low half for keys of the high one.
    other = "if(key >= shiftleft(32L, 32), fp & 4294967295L, shiftrightunsigned(fp, 32))"
    # Spark sizes an explode by its input, 64 times too low, and would broadcast the keys of up to a million documents.
    buckets = (
        rows.hint("merge").join(shared, "key")
        .withColumn("cut", F.explode(F.expr(f"if(n <= {CROWDED}, array(-1L), {_keys(f'({other})', 16)})")))
        .groupBy("key", "cut")
        .agg(F.collect_list("fp").alias("fps"))
        .filter("size(fps) > 1")
        .select("fps")
    )
    return buckets.mapInArrow(_link(most), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """Every row's ``id``, ``text_hash``, ``fp`` and ``component_id``, the smallest id that links lead to.

    Rows with one fingerprint collapse before the join, so exact copies cost
    nothing there. Null ids get a component like others; it has the smallest
    id that is not null, or null where there is none. Repeated rows stay.
    Written tables are sized by their files, a fraction of their rows in
    memory, so the joins are by merge and nothing goes through the driver.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    roots = components(near_links(distinct, most), "a", "b")
    placed = distinct.hint("merge").join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "simhash-roots")
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.hint("merge").join(named, "root").select("fp", "component_id")
    return rows.hint("merge").join(named, "fp").select("id", "text_hash", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one with the smallest id stays, once.

    All columns are kept. Groups whose ids are all null keep one row per text.
    """
    groups = near_groups(docs, id_col, text_col, shingle, most)
    stay = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "text_hash").agg(F.count("*").alias("rows"))
    keyed = packed(docs, own_id=F.col(id_col).cast("long"), own_hash=F.xxhash64(text_col))
    same = keyed["own_id"].eqNullSafe(stay["id"]) & (keyed["own_hash"] == stay["text_hash"])
    # Only rows that occur more than once have to meet each other; the others move for the join alone.
    kept = keyed.join(stay, same).select("row", "own_id", "own_hash", "rows")
    once, often = kept.filter("rows = 1"), kept.filter("rows > 1").dropDuplicates(["own_id", "own_hash"])
    return once.unionByName(often).select("row.*")
