"""Token counts of documents from the pieces of their distinct pre-tokens."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written
from auditframe.llm._table import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What the library writes for a space, and a character that no longer piece holds.
SPACE, APART = "▁", "\n"
BLOCK_BYTES = 8 << 20
# Pre-tokens found in at least this share of all (document, pre-token) pairs, of at most so many characters, meet the
# documents without a shuffle. The share bounds their number.
FREQUENT, LONGEST = 1 / (1 << 22), 64


class Pieces:
    """A sentencepiece model and the places where it can never join two characters."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        encode = self.processor.encode
        if "".join(encode(" a  b ", out_type=str)) != f" {' a  b '}".replace(" ", SPACE) or encode("Ａ") == encode("A"):
            raise ValueError("the model rewrites its texts; pre-tokens are cut from texts as they are")
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        pairs = {(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        if any(ord(APART) in p for p in pairs):
            raise ValueError("a piece joins a line break to other characters")
        kinds = sorted({c for p in pairs for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[kinds] = np.arange(1, len(kinds) + 1)
        self.parted = np.ones((len(kinds) + 1, len(kinds) + 1), bool)
        for a, b in pairs:
            self.parted[self.kind[a], self.kind[b]] = False
        self.apart = len(encode(APART))

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text: it is cut wherever no piece holds the two characters side by side."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        cuts, last = [0], None
        for lo in range(0, len(text), 1 << 20):
            kind = self.kind[np.frombuffer(text[lo : lo + (1 << 20)].encode("utf-32-le"), np.uint32)]
            before = np.concatenate([[kind[0] if last is None else last], kind[:-1]])
            at = np.flatnonzero(self.parted[before, kind]) + lo
            cuts += at[at > 0].tolist()
            last = kind[-1]
        cuts.append(len(text))
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def count(self, pre_tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token, wherever it stands in a text."""
        return [len(ids) - self.apart for ids in self.processor.encode([APART + p for p in pre_tokens], num_threads=1)]


def _vocabulary(model: bytes):
    """The different pre-tokens of each batch and the number of documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for whole in batches:
            found: Counter[str] = Counter()
            for b in slices(whole, "text", BLOCK_BYTES):
                for text in b.column("text").to_pylist():
                    found.update(set(pieces.cut(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pre", "n_docs"])

    return run


def _counted(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for whole in batches:
            for b in slices(whole, "pre", BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces.count(b.column(0).to_pylist()), pa.int64())], ["pre", "n_docs", "n_pieces"])

    return run


def _frequencies(model: bytes, frequent):
    """Of every document a row with the pieces of its frequent pre-tokens, and a row for each other pre-token with its times.

    The document's row has a key of its own, which starts with a space and so
    is no pre-token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = Pieces(model), frequent.value
        for whole in batches:
            for b in slices(whole, "text", BLOCK_BYTES):
                rows: list[list] = [[], [], [], [], []]
                ids, marks, keys, times, sums = rows
                for i, mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    total = 0
                    for pre, n in Counter(pieces.cut(text or "")).items():
                        if (size := known.get(pre)) is not None:
                            total += n * size
                        else:
                            ids.append(i)
                            marks.append(mark)
                            keys.append(pre)
                            times.append(n)
                            sums.append(None)
                    ids.append(i)
                    marks.append(mark)
                    keys.append(f" {i} {mark}")
                    times.append(None)
                    sums.append(total)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["id", "mark", "pre", "times", "known"])

    return run


def pre_tokens(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``pre``, ``n_docs`` and ``n_pieces`` of every distinct pre-token, whose pieces are counted once."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_vocabulary(model), "pre string, n_docs long")
    distinct = found.groupBy("pre").agg(F.sum("n_docs").alias("n_docs"))
    return distinct.mapInArrow(_counted(model), "pre string, n_docs long, n_pieces long")


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row: what the sentencepiece model gives for the whole text.

    A text is cut wherever no piece of the vocabulary holds the two
    characters side by side. No merge can cross such a place, so the pieces
    of a text are those of its pre-tokens, each encoded by itself. Every
    distinct pre-token is encoded once; documents meet the counts by
    pre-token and sum them, and no ids of a document exist anywhere.

    Pre-tokens in at least the FREQUENT share of all pairs of document and
    pre-token number at most the inverse of that share; they reach the
    documents as a table of that bound. The other pairs are joined by
    equality, where a hot key (a long pre-token) is split by adaptive execution.

    Null and empty texts have no bytes and no tokens. Rows are told apart by
    id and text: repeated rows and null ids keep a row each. The model's file
    is read on the driver and travels with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    Pieces(model)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    vocabulary = written(pre_tokens(rows, model), "pre-tokens")
    pairs = vocabulary.agg(F.sum("n_docs")).first()[0] or 0
    often = (F.col("n_docs") >= F.lit(pairs * FREQUENT)) & (F.length("pre") <= LONGEST)
    frequent = {r[0]: r[1] for r in vocabulary.filter(often).select("pre", "n_pieces").toLocalIterator()}
    told = rows.mapInArrow(_frequencies(model, spark.sparkContext.broadcast(frequent)), "id long, mark long, pre string, times long, known long")
    joined = told.join(vocabulary.filter(~often).select("pre", "n_pieces"), "pre", "left")
    # Repeated rows come to one group, which holds each pair as often as there are rows.
    totals = joined.groupBy("id", "mark").agg(
        F.sum(F.coalesce("known", F.col("times") * F.col("n_pieces"))).alias("all_tokens"), F.count("known").alias("copies")
    )
    totals = totals.select(F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), F.expr("all_tokens div copies").alias("n_tokens"))
    every = rows.select("id", "mark", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    same = every["id"].eqNullSafe(totals["own_id"]) & (every["mark"] == totals["own_mark"])
    return every.join(totals, same).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens")
