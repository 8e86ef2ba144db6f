"""A stored index of token sets by banded MinHash, for approximate best matches by Jaccard similarity.

A set's signature is one-permutation MinHash: every token has one hash, which
names a bin and a value, and each bin keeps its least value; empty bins borrow
from others by a fixed sequence. Bands of the signature are join keys. The index
keeps the hashes of the sets, so later texts are scored exactly without reading
or tokenising a text of the corpus again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.similarity import best_in_blocks, frequent_codes, packed_codes, spread_sets
from auditframe.functions.storage import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bands and values of each: at a similarity of 0.6 the chance to share a band is 0.88, at 0.65 0.98, at 0.4 0.08, at 0.3 below 0.01.
BANDS, VALUES = 128, 8
# Indexed sets under one band beyond which the next band is a part of the key.
CROWDED = 1000
# Indexed sets, of about 1.2 KB each, that go to the tasks at a time.
BLOCK = 8192


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _signature(codes: np.ndarray, bins: int) -> np.ndarray:
    """The least value of each bin of a set that is not empty."""
    h = _mix(codes.view(np.uint64))
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h % np.uint64(bins)).astype(np.int64), h // np.uint64(bins))
    empty = np.flatnonzero(least == np.iinfo(np.uint64).max)
    full = least != np.iinfo(np.uint64).max
    turn = 0
    while len(empty):
        # Where an empty bin looks depends on the bin and the turn alone, so that equal sets borrow alike.
        source = (_mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)
        found = full[source]
        least[empty[found]] = least[source[found]]
        empty, turn = empty[~found], turn + 1
    return least


def bands(codes: Column, number: int = BANDS, values: int = VALUES) -> Column:
    """One key per band; equal keys stand for equal values of the band. Empty sets have none."""

    def run(sets: pd.Series) -> pd.Series:
        out = []
        for own in sets:
            if not len(own):
                out.append(np.zeros(0, np.int64))
                continue
            rows = _signature(np.asarray(own, dtype=np.int64), number * values).reshape(number, values)
            key = np.arange(number, dtype=np.uint64)
            for column in rows.T:
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
            out.append(key.view(np.int64))
        return pd.Series(out)

    # Else Spark would move a filter below it and compute what it reads once more.
    return F.pandas_udf(run, "array<long>").asNondeterministic()(codes)


def _sets(df: DataFrame, id_: Column, text: Column, tokenise: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(id, key) of all rows, and one row per distinct text: least id, hashes of its tokens, their number and bands."""
    rows = df.select(id_.alias("id"), text.alias("text")).withColumn("key", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    texts = rows.groupBy("key").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
    codes = F.array_sort(F.array_distinct(F.transform(F.coalesce(tokenise(F.col("text")), F.array().cast("array<string>")), lambda t: F.xxhash64(t))))
    coded = texts.select("key", "id", codes.alias("codes"))
    coded = coded.select("key", "id", "codes", F.size("codes").alias("size"), bands(F.col("codes")).alias("bands"))
    # Empty sets are those without bands. A filter by the tokens would read every text twice.
    return rows.select("id", "key"), coded.filter(F.size("bands") > 0)


def append_texts(df: DataFrame, path: str, batch: str, id_: Column, text: Column, tokenise: Callable[[Column], Column]) -> None:
    """File one batch; nothing that is in the index is read, and a batch written again replaces itself."""
    _, sets = _sets(df, id_, text, tokenise)
    sets.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Indexed sets; a text that came in several batches has a row of each."""
    return spark.read.parquet(path).select("key", "id", "codes", "size", "bands")


def _crowded(index: DataFrame) -> np.ndarray:
    """Bands that more than CROWDED indexed sets share, in order: at most BANDS for each CROWDED sets."""
    counts = index.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    return np.sort(counts.filter(F.col("n") > CROWDED).select("band").toArrow()["band"].to_numpy())


def _keys(bands_: Column, crowded: np.ndarray) -> Column:
    """32 bits of each band, or of a crowded band together with the band after it, which parts what is alike by chance.

    Of two sets without a common band, three in 100 million pairs agree in a key.
    """

    def run(sets: pd.Series) -> pd.Series:
        if not len(sets):
            return pd.Series([], dtype=object)
        own = np.stack(sets.to_numpy()).view(np.uint64)
        joined = _mix(own * np.uint64(0x9E3779B97F4A7C15) + np.roll(own, -1, axis=1))
        return pd.Series(list(np.where(np.isin(own.view(np.int64), crowded), joined, own).astype(np.uint32).view(np.int32)))

    return F.pandas_udf(run, "array<int>")(bands_)


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r): keys of sets that share a band and whose sizes allow the threshold, each pair once.

    These are the pairs that :func:`best_in_index` scores. Their number grows with the product of both sides.
    """
    crowded = _crowded(right)
    cells = lambda df, side: df.select(F.col("key").alias(side), F.col("size").alias(f"{side}n"), F.explode(_keys(F.col("bands"), crowded)).alias("cell"))
    near = (F.least("ln", "rn") >= F.greatest("ln", "rn") * threshold - 1e-9)
    return cells(left, "l").join(cells(right, "r"), "cell").filter(near).select("l", "r").distinct()


def best_in_index(
    left: DataFrame, path: str, threshold: float, left_id: str, text: str, tokenise: Callable[[Column], Column]
) -> DataFrame:
    """(left_id, match, score): of the indexed sets that a row's text meets, the most similar with Jaccard >= ``threshold``.

    Scores are exact; missed are matches that share no band. Equal texts
    collapse on both sides, the match of equal ones is the least id. Null and
    empty texts match nothing.

    No pair moves: sets are kept as bits with their bands, the indexed ones go
    to the tasks a chunk at a time, and a task finds the pairs that share a
    band, counts their shared bits and returns one match per left set.
    """
    rows, sets = _sets(left, F.col(left_id), F.col(text), tokenise)
    index = read_index(left.sparkSession, path)
    crowded, frequent = _crowded(index), frequent_codes(index)
    number = F.monotonically_increasing_id()

    def packed(df: DataFrame, *columns: str) -> DataFrame:
        own = df.select(*columns, "size", packed_codes(F.col("codes"), frequent).alias("p"), _keys(F.col("bands"), crowded).alias("keys"))
        return own.select(*columns, "size", "p.bits", "p.others", "keys")

    l_sets = written(spread_sets(packed(sets, "key"), "key").select(number.alias("l"), "*"), "minhash-left")
    # A range sort puts the ids of later partitions behind: the number grows with the id.
    r_sets = written(packed(index, "id").orderBy("id").select(number.alias("r"), "*"), "minhash-right")
    best = best_in_blocks(l_sets.drop("key"), r_sets.drop("id"), threshold, BLOCK)
    best = best.join(r_sets.select("r", F.col("id").alias("match")), "r").join(l_sets.select("l", "key"), "l")
    return rows.join(best, "key").select(F.col("id").alias(left_id), "match", "score")
