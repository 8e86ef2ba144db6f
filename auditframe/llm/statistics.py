"""Counts of a text that the quality operators decide on."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auditframe.llm._table import bounded_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
    "n_digits", "n_marks", "n_distinct", "n_top_word", "n_same_word", "n_ended_lines",
]
_BLANK = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b".,;:!?\"'()-"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    count = reach = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            count += i + 3 - max(i, reach)
            reach = i + 3
    return count


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a whole text; all zero for null and for a text without words.

    Words are runs without ASCII white space, lines are parted by \\n. Upper
    case, digits and marks are those of ASCII; letters are the other characters
    of words but symbols, digits and marks.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    chars = len(text) - left(_BLANK)
    symbols, digits, marks = left(_SYMBOLS), left(b"0123456789"), left(_MARKS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    times = Counter(words)
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), left(_UPPER),
        chars - symbols - digits - marks, digits, marks, len(times), max(times.values()),
        sum(map(eq, words, words[1:])), sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines),
    )


def text_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row with the COUNTS of its text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t.as_py()) for t in b.column(b.num_columns - 1)]
            own = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], [*b.schema.names[:-1], *COUNTS])

    kept = docs.select(*keep, F.col(text_col).alias("_text"))
    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], *[StructField(c, LongType()) for c in COUNTS]]))


def labelled_counts(docs: DataFrame, labels: DataFrame, target: str, rows: int, seed: int = 5) -> DataFrame:
    """COUNTS and ``target`` of at most ``rows`` labelled documents, those of the smallest seeded hash.

    ``rows`` bounds what is broadcast and what a learner gets; labels without
    id or target are left out, repeated ones count once, the larger target.
    """
    known = labels.filter(f"doc_id IS NOT NULL AND {target} IS NOT NULL").groupBy("doc_id").agg(F.max(target).alias("_target"))
    chosen = bounded_sample(known, None, rows, seed)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_target").alias("_target"))
    return text_counts(found, "text", ["_target"])
