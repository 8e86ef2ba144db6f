"""Benchmark passages in documents: pigeonhole pieces found exactly, verified by bit-parallel edit distance."""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written
from auditframe.llm._table import packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
# Benchmark characters that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 1_000_000


def plain(text: str) -> str:
    """ASCII letters in lower case, ASCII white space as spaces; every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").translate(_TO).decode("utf-8", "surrogatepass")


def _advance(pattern: str, text: str, anchored: bool) -> Iterator[int]:
    """Myers' bit-parallel distances of a pattern to the best substring that ends at each character (or to the prefix)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    where.default_factory = None
    plus, minus, distance = full, 0, m
    for c in text:
        eq = where.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = (up << 1) & full | anchored
        plus = (down << 1) & full | (full & ~(vertical | up))
        minus = up & vertical
        yield distance


def best_match(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the substring closest to ``item`` within ``most`` edits; the first end of the least distance."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    least, end = most + 1, -1
    for i, d in enumerate(_advance(item, text, False)):
        if d < least:
            least, end = d, i + 1
    if end < 0:
        return None
    for length, d in enumerate(_advance(item[::-1], text[:end][::-1], True), 1):
        if d == least:
            return least, end - length, end
    return least, end, end


def pieces(item: str, most: int) -> list[tuple[int, str, str, bool]]:
    """Parts to find exactly: (offset, part, its other half, whether it is the left one).

    The item is cut into pairs of parts, half as many pairs as the budget plus
    one. Text within the budget holds a pair with one edit at most, and so one
    part of that pair unchanged.
    """
    pairs = max(1, -(-(most + 1) // 2))
    cuts = [i * len(item) // (2 * pairs) for i in range(2 * pairs + 1)]
    out = []
    for a, b, c in zip(cuts[::2], cuts[1::2], cuts[2::2], strict=False):
        out += [(a, item[a:b], item[b:c], True), (b, item[b:c], item[a:b], False)]
    return out


def one_edit(half: str, text: str) -> bool:
    """Whether a prefix of ``text`` lies within one edit of ``half``."""
    n = len(half)
    i = next((i for i, (x, y) in enumerate(zip(half, text, strict=False)) if x != y), min(n, len(text)))
    if i >= n - 1:
        return True
    rest = half[i + 1 :]
    return text.startswith(rest, i + 1) or text.startswith(half[i:], i + 1) or text.startswith(rest, i)


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of a part of a text."""
    joined = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not joined(start) and not joined(end)


def matches(text: str, automaton, budgets: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Best match of every item that occurs in a text."""
    windows = defaultdict(list)
    best = {}
    for last, found in automaton.iter(text):
        for item, offset, length, half, left in found:
            start = last + 1 - length
            if half is None:
                if item not in best and stands_alone(text, start, last + 1):
                    best[item] = (0, start, last + 1)
                continue
            near = text[last + 1 : last + 2 + len(half)] if left else text[max(0, start - len(half) - 1) : start][::-1]
            if one_edit(half if left else half[::-1], near):
                windows[item].append((start - offset - budgets[item], start - offset + len(item) + budgets[item]))
    for item, spans in windows.items():
        joined = []
        for lo, hi in sorted(spans):
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = max(hi, joined[-1][1])
            else:
                joined.append([max(lo, 0), hi])
        for lo, hi in joined:
            hit = best_match(item, text[lo:hi], budgets[item])
            if hit and (item not in best or hit[0] < best[item][0]):
                best[item] = (hit[0], lo + hit[1], lo + hit[2])
    return best


def _search(items: dict[str, list[int]], rate: float):
    """``items`` gives the keys of each plain text; those without a budget are one piece without another half."""
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            import ahocorasick

            automaton, places = ahocorasick.Automaton(), defaultdict(list)
            budgets = {item: int(rate * len(item)) for item in items}
            for item, most in budgets.items():
                for offset, piece, half, left in pieces(item, most) if most else [(0, item, None, True)]:
                    places[piece].append((item, offset, len(piece), half, left))
            for piece, found in places.items():
                automaton.add_word(piece, found)
            automaton.make_automaton()
            state.update(automaton=automaton, budgets=budgets)
        for b in batches:
            out = [], [], [], [], []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                if text.as_py():
                    for item, hit in matches(plain(text.as_py()), **state).items():
                        for key in items[item]:
                            for column, value in zip(out, (doc.as_py(), key, *hit), strict=True):
                                column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "distance", "start", "end"])

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``start``, ``end`` for every document and test item it holds.

    An item matches where a substring lies within ``rate`` * its length edits
    (insertions, deletions, substitutions), letters compared without ASCII
    case and white space as spaces; offsets are code points of the text. An
    item is cut into at least one piece more than its budget, so a match keeps
    one piece intact. One scan finds all pieces; where the neighbouring piece
    follows with one edit at most, the text around is verified. Documents stay where they are read. Items travel to them in
    passes of ``pass_chars`` characters, a documented bound, each of which is
    written before the next one's items are fetched, so a larger benchmark
    costs more scans and not more memory, on the driver neither. An item too
    short for an edit (under 1 / ``rate`` characters) matches word for word:
    where no word goes on over its ends, white space at which does not count. Null and blank items are not looked for. Null and empty texts match nothing; repeated rows repeat
    their matches, and items with equal text all match.
    """
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item IS NOT NULL")
    # Equal texts are looked for once; their ids join what was found.
    texts = wanted.select("item", F.xxhash64("item").alias("key")).distinct()
    total = texts.agg(F.sum(F.length("item"))).first()[0] or 0
    passes = max(1, math.ceil(total / pass_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for number in range(passes):
        items = defaultdict(list)
        for r in texts.filter(F.pmod("key", F.lit(passes)) == number).toLocalIterator():
            text = plain(r.item)
            # White space at the ends of an item without a budget does not count.
            if text := text if int(rate * len(text.strip(" "))) else text.strip(" "):
                items[text].append(r.key)
        if items:
            hits = rows.mapInArrow(_search(dict(items), rate), "doc_id long, key long, distance int, start long, end long")
            found.append(hits if passes == 1 else written(hits, "edit-matches"))
    if not found:
        return rows.selectExpr("doc_id", "0L item_id", "0 distance", "0L start", "0L end").limit(0)
    ids = wanted.select("item_id", F.xxhash64("item").alias("key"))
    return reduce(DataFrame.unionAll, found).join(ids, "key").select("doc_id", "item_id", "distance", "start", "end")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1) -> DataFrame:
    """The rows of ``docs`` that hold no test item; all columns stay. Rows without an id are judged by their text."""
    keyed = packed(docs, key=F.xxhash64(id_col, text_col), text=F.col(text_col))
    leaks = written(find_leaks(keyed, benchmark, "key", "text", rate).select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return keyed.join(leaks, "key", "left_anti").select("row.*")
