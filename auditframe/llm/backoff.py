"""Stupid-backoff scores of documents from n-gram count tables of the whole corpus."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm._table import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value of the method.
DISCOUNT = 0.4
BLOCK_BYTES = 8 << 20
PART_GRAMS = 2_000_000


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: the upper ones of small numbers are nearly empty."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(words: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 the positions where such an n-gram ends, and its 64-bit hash.

    ``words`` has a hash per position and ``place`` the position in its document.
    """
    at, hashes = np.arange(len(words)), words
    for n in range(1, order + 1):
        if n > 1:
            longer = place[at] + 1 < np.append(place[1:], 0)[at] + 1
            before = at[longer]
            at, hashes = before + 1, _mix(hashes[longer] * np.uint64(0x9E3779B97F4A7C15) + words[before + 1] + np.uint64(n))
        yield at, hashes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block of documents: ids, sizes, the hashes of its different words and the words as numbers of those.

    The number of a block is a digest of its place and contents, so that counts are never given to a block made anew with other rows.
    """
    count = 0
    for whole in batches:
        for b in slices(whole, "text", BLOCK_BYTES):
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column(1), "")))
            flat = words.flatten()
            real = pc.not_equal(flat, "")
            ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[np.asarray(words.offsets) - words.offsets[0].as_py()]
            kinds = flat.filter(real).dictionary_encode()
            numbers = kinds.indices.to_numpy().astype(np.int64)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in kinds.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(kinds.dictionary))
            # Frequent words first, for small numbers; the many words of one frequency by hash, for small differences.
            often = np.lexsort((hashes, -np.bincount(numbers, minlength=len(hashes))))
            rank = np.empty_like(often)
            rank[often] = np.arange(len(often))
            kept, own = pack(np.diff(hashes[often], prepend=np.uint64(0))), pack(rank[numbers])
            digest = xxhash.xxh64(f"{TaskContext.get().partitionId()}:{count}:{b.column(0).to_pylist()}")
            digest.update(kept)
            digest.update(own)
            block = digest.intdigest() - (1 << 63)
            count += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()), "ids": pa.array([b.column(0)], pa.list_(pa.int64())), "sizes": pa.array([np.diff(ends)], pa.list_(pa.int64())),
                    "n_kinds": pa.array([len(often)], pa.int64()), "n_words": pa.array([len(numbers)], pa.int64()),
                    "kinds": pa.array([kept], pa.binary()), "words": pa.array([own], pa.binary()),
                }
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of each batch."""
    for b in batches:
        words = sum(len(t.split()) for t in b.column(0).cast(pa.binary()).to_pylist() if t)
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64())], ["n"])


_BLOCK = "block long, ids array<long>, sizes array<long>, n_kinds long, n_words long, kinds binary, words binary"


def _positions(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the word hash, the document number and the place in the document of every position."""
    sizes = np.asarray(block["sizes"], np.int64)
    words = np.cumsum(unpack(block["kinds"], block["n_kinds"]), dtype=np.uint64)[unpack(block["words"], block["n_words"]).astype(np.int64)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return words, doc, np.arange(len(words)) - (np.cumsum(sizes) - sizes)[doc]


def _requests(order: int, bits: int):
    """What each block holds of each order, cut by the leading bits of the hash: sorted different hashes and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                words, _, place = _positions(block)
                for n, (_, hashes) in enumerate(grams(words, place, order), 1):
                    keys, counts = np.unique(hashes, return_counts=True)
                    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                    rows = []
                    for part, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)):
                        if len(k):
                            rows.append((part, block["block"], n, len(k), pack(np.diff(k, prepend=np.uint64(0))), pack(c)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "block", "n", "size", "keys", "counts"])

    return run


def _totals(rows: pa.Table) -> pa.Table:
    """Counts of one part's n-grams over all blocks, returned to each block in the order it asked for them."""
    out = []
    for n in set(rows.column("n").to_pylist()):
        own = rows.filter(pc.equal(rows.column("n"), n)).to_pylist()
        keys = np.concatenate([np.cumsum(unpack(r["keys"], r["size"])) for r in own])
        counts = np.concatenate([unpack(r["counts"], r["size"]) for r in own])
        _, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts).astype(np.uint64)[place]
        ends = np.cumsum([r["size"] for r in own])
        out += [(r["block"], r["part"], n, r["size"], pack(t)) for r, t in zip(own, np.split(total, ends[:-1]), strict=True)]
    return pa.table([pa.array(c) for c in zip(*out, strict=True)], ["block", "part", "n", "size", "totals"])


def _scores(order: int, corpus_words: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        words, doc, place = _positions(block)
        told: dict[int, list] = {}
        for r in sorted(answers.to_pylist(), key=lambda r: r["part"]):
            told.setdefault(r["n"], []).append(unpack(r["totals"], r["size"]))
        sizes = np.asarray(block["sizes"], np.int64)
        elsewhere = corpus_words - sizes[doc]
        # An n-gram counts where other documents have it; contexts are n-grams one shorter that end one word earlier.
        score = -np.log(elsewhere + 1.0) + np.minimum(place, order - 1) * math.log(DISCOUNT)
        seen = np.zeros(len(words), np.int64)
        context = elsewhere.astype(np.float64)
        for n, (at, hashes) in enumerate(grams(words, place, order), 1):
            if not len(at):
                break
            _, kind = np.unique(hashes, return_inverse=True)
            total = np.concatenate(told[n]).astype(np.int64)[kind]
            _, mine, own = np.unique(doc[at] * (kind.max() + 1) + kind, return_inverse=True, return_counts=True)
            others = np.zeros(len(words))
            others[at] = total - own[mine]
            found = others > 0
            steps = np.minimum(place, order - 1) - (n - 1)
            score[found] = (np.log(others[found]) - np.log(context[found])) + steps[found] * math.log(DISCOUNT)
            seen[found] = n
            context = np.concatenate([[0.0], others[:-1]])
        total = np.bincount(doc, score, len(sizes)).astype(np.float64)
        short = np.bincount(doc, seen < np.minimum(place + 1, order), len(sizes)).astype(np.int64)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(sizes > 0, total / sizes, np.nan)
        return pa.table(
            {"doc_id": pa.array(block["ids"], pa.int64()), "n_words": sizes, "n_backed_off": short, "log_score": total, "mean_log_score": pa.array(mean, from_pandas=True)}
        )

    return run


def score(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_backed_off``, ``log_score`` and ``mean_log_score`` of every row.

    A word's score is the relative frequency of the longest n-gram of up to
    ``order`` words that ends with it and that other documents have, times 0.4
    for every order below; a word that no other document has counts as one of
    the others' words and one. Natural logarithms are added over the document;
    its own n-grams are taken off the counts. Words are parted by ASCII white
    space, ASCII letters in lower case, and n-grams stay within documents.

    All is equality on 64-bit hashes. One pass counts the words. Documents
    are then dealt out as blocks of word numbers, once: the same exchange
    serves the requests and the scores. Each block sends its different n-grams with
    counts to the part of the hash range they belong to; there counts of all
    blocks are added, and each block gets the sums in the order it asked. So
    occurrences are combined before they move, a frequent n-gram is one entry
    per block, and no group exceeds a part or a block, both of fixed size.

    Null texts and texts without words have score 0 and no mean; repeated rows
    count as documents of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.select("text").mapInArrow(_count, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = rows.mapInArrow(_blocks, _BLOCK).repartition("block")
    bits = max(0, math.ceil(math.log2(max(1, total * order / PART_GRAMS))))
    asked = blocks.mapInArrow(_requests(order, bits), "part long, block long, n long, size long, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_totals, "block long, part long, n long, size long, totals binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scores(order, total), "doc_id long, n_words long, n_backed_off long, log_score double, mean_log_score double"
    )


def score_sql(order: int = 2) -> str:
    """DuckDB SQL of the registered query."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = lambda n: "g.w" if n == 1 else "concat_ws(' ', " + ", ".join(f"lag(g.w, {k}) OVER d" for k in range(n - 1, 0, -1)) + ", g.w)"
    counted = ", ".join(
        f"(sum(1) OVER (PARTITION BY g{n}) - sum(1) OVER (PARTITION BY doc, g{n})) * (i >= {n})::INT AS c{n}" for n in range(1, order + 1)
    )
    cases = "".join(
        f" WHEN c{n} > 0 THEN ln(c{n}::DOUBLE) - ln({'elsewhere' if n == 1 else f'x{n - 1}'}::DOUBLE) + (least(i, {order}) - {n}) * ln({DISCOUNT})" for n in range(order, 0, -1)
    )
    contexts = ", ".join(f"lag(c{n}) OVER d AS x{n}" for n in range(1, order)) or "0 AS x0"
    top = "CASE " + " ".join(f"WHEN c{n} > 0 THEN {n}" for n in range(order, 0, -1)) + " ELSE 0 END"
    return f"""
    WITH base AS (SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    g AS (SELECT doc, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM base),
    grams AS (SELECT doc, i, {', '.join(f'CASE WHEN i >= {n} THEN {gram(n)} ELSE doc || chr(32) || chr(32) || i END AS g{n}' for n in range(1, order + 1))}
        FROM g WINDOW d AS (PARTITION BY doc ORDER BY i)),
    counted AS (SELECT doc, i, (SELECT count(*) FROM g) - count(*) OVER (PARTITION BY doc) AS elsewhere, {counted} FROM grams),
    placed AS (SELECT *, {contexts} FROM counted WINDOW d AS (PARTITION BY doc ORDER BY i)),
    scored AS (SELECT doc, CASE{cases} ELSE -ln(elsewhere + 1.0) + (least(i, {order}) - 1) * ln({DISCOUNT}) END AS s, ({top} < least(i, {order}))::BIGINT AS b FROM placed),
    summed AS (SELECT doc, avg(s) AS mean, sum(b)::BIGINT AS backed FROM scored GROUP BY 1)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(backed, 0)::BIGINT AS n_backed_off, round(mean, 6) AS mean_log_score
    FROM base LEFT JOIN summed USING (doc)"""
