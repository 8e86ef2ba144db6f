"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and itself."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words, and their characters, that one initial state may lead to; a state that leads to more is parted.
CROWDED, CROWDED_CHARS = 50_000, 8_000_000
BATCH_ROWS = 10_000

Arcs = dict[str, tuple[str, int]]


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Acceptor:
    """Minimal acyclic acceptor of sorted different words.

    States without a choice are kept inside the labels of arcs, so a long
    word costs its characters once. States that accept the same endings are
    one state. ``places`` lists where the words branch or end before others
    do: a word's number, how many of its characters are read, and the state.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[Arcs] = []
        self.final: list[bool] = []
        self.places: list[tuple[int, int, int]] = []
        known: dict[tuple, int] = {}
        path: list[tuple[int, bool, Arcs]] = [(0, False, {})]

        def close(number: int, depth: int, final: bool, arcs: Arcs) -> int:
            key = (final, *arcs.values())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            if len(arcs) + final > 1:
                self.places.append((number, depth, state))
            return state

        def fold(number: int, depth: int) -> None:
            """Close what the word of this number reads beyond a depth."""
            while path[-1][0] > depth:
                at, final, arcs = path.pop()
                state = close(number, at, final, arcs)
                if path[-1][0] < depth:
                    path.append((depth, False, {}))
                label = words[number][path[-1][0] : at]
                path[-1][2][label[0]] = (label, state)

        for i, word in enumerate(words):
            if i:
                fold(i - 1, _shared(words[i - 1], word))
            path.append((len(word), True, {}))
        if words:
            fold(len(words) - 1, 0)
            close(0, *path[0])

    def both(self, a: tuple[str, int], b: tuple[str, int], most: int | None = None) -> Iterator[str]:
        """The endings, of up to ``most`` characters, that two places accept: the rest of an arc's label and the state behind it."""
        todo = [(*a, *b, "")]
        while todo:
            left, p, right, q, read = todo.pop()
            n = min(len(left), len(right))
            if left[:n] != right[:n]:
                continue
            read, left, right = read + left[:n], left[n:], right[n:]
            if most is not None and len(read) > most:
                continue
            if left or right:
                rest, state, other = (left, q, p) if left else (right, p, q)
                if arc := self.arcs[state].get(rest[0]):
                    todo.append((rest, other, *arc, read))
                continue
            if self.final[p] and self.final[q]:
                yield read
            few, many = sorted((self.arcs[p], self.arcs[q]), key=len)
            todo += [(*few[c], *many[c], read) for c in few if c in many]

    def edits(self, state: int, most: int | None = None) -> list[tuple[str, str]]:
        """Pairs of endings of a state that one edit at their first character makes equal.

        A deleted character differs from the next one, so that each pair of
        words has one place, the end of what they share.
        """
        found = []
        arcs = list(self.arcs[state].items())
        if self.final[state]:
            found += [(c, "") for c, (label, to) in arcs if len(label) == 1 and self.final[to]]
        for i, (c, (label, to)) in enumerate(arcs):
            for d, arc in arcs[:i]:
                found += [(c + end, d + end) for end in self.both((label[1:], to), (arc[0][1:], arc[1]), most)]
                found += [(c + end, end) for end in self.both((label[1:], to), arc, most)]
                found += [(d + end, end) for end in self.both((arc[0][1:], arc[1]), (label, to), most)]
        return found


def near_in(words: list[str], low: int = 0, high: int | None = None, most: int | None = None) -> Iterator[tuple[str, str]]:
    """Pairs of sorted different words at one edit, each once, that share ``low`` to ``high`` first characters and no more.

    The composition starts in a pair of equal states, walks with both tapes
    equal to a place, edits there, and goes on where both sides accept the
    same. What a state's endings give is found once for all words that reach it.
    """
    machine = Acceptor(words)
    found: dict[int, list[tuple[str, str]]] = {}
    for number, depth, state in machine.places:
        if depth < low or (high is not None and depth > high):
            continue
        if state not in found:
            found[state] = machine.edits(state, most)
        start = words[number][:depth]
        for a, b in found[state]:
            yield start + a, start + b


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[int]]]:
    """Rows of one initial state together; they come sorted."""
    key, reads, counts = None, [], []
    for b in batches:
        for *own, read, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != key:
                if key is not None:
                    yield key, reads, counts
                key, reads, counts = own, [], []
            reads.append(read)
            counts.append(n)
    if key is not None:
        yield key, reads, counts


def _pairs(group: tuple[list, list[str], list[int]], k: int) -> tuple[dict[str, int], Iterator[tuple[str, str]]]:
    """The counts of a group's words and its pairs, as they are read: in a mirror from the end."""
    (mirrored, length, low, high, _), reads, counts = group
    # In a mirror, words that share their k first characters are left to the other side.
    found = near_in(reads, low, None if high < 0 else high, k - 1 if mirrored else None) if len(reads) > 1 else iter(())
    return dict(zip(reads, counts, strict=True)), (
        (a, b) for a, b in found if not (mirrored and a[-k:] == b[-k:]) and (length < 0 or min(len(a), len(b)) == length)
    )


def _emit(k: int):
    """Rows ``mirrored``, ``word``, ``near``, ``near_n``: every pair in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            n_of, pairs = _pairs(group, k)
            while some := list(islice(pairs, BATCH_ROWS)):
                words, near = zip(*some, strict=True)
                words, near = words + near, near + words
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0][0]] * len(words)), pa.array(words), pa.array(near), pa.array([n_of[w] for w in near], pa.int64())],
                    ["mirrored", "word", "near", "near_n"],
                )

    return run


def _summary(k: int):
    """Rows ``word``, ``n_near``, ``near``, ``near_n``: for every word of a group how many are near, and the best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            mirrored = group[0][0]
            best: dict[str, list] = {}
            n_of, pairs = _pairs(group, k)
            for a, b in pairs:
                for word, near in ((a, b), (b, a)):
                    own = near[::-1] if mirrored else near
                    rank = (-n_of[near], own)
                    if word in best:
                        best[word][0] += 1
                        best[word][1] = min(best[word][1], rank)
                    else:
                        best[word] = [1, rank]
            if best:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([mirrored] * len(best)), pa.array(list(best), pa.string()), pa.array([b[0] for b in best.values()], pa.int64()),
                        pa.array([b[1][1] for b in best.values()], pa.string()), pa.array([-b[1][0] for b in best.values()], pa.int64()),
                    ],
                    ["mirrored", "word", "n_near", "near", "near_n"],
                )

    return run


_STATE = ["mirrored", "length", "low", "high", "state"]


def _part(rows: DataFrame, zones: str) -> DataFrame:
    """Rows sent to the states of narrower zones; words of a zone share what lies before it and behind it."""
    cut = rows.select("mirrored", "read", "n", F.explode(F.expr(zones)).alias("z"))
    cut = cut.select("mirrored", F.col("z.length").alias("length"), F.col("z.low").alias("low"), F.col("z.high").alias("high"), "read", "n")
    behind = F.expr("right(read, greatest(0, length - 1 - high))")
    return cut.withColumn("state", F.xxhash64("mirrored", "length", "low", "high", F.expr("left(read, low)"), behind)).select(*_STATE, "read", "n")


def _states(words: DataFrame, least: int, crowded: int) -> DataFrame:
    """Every word under the initial states from which its pairs are enumerated.

    Two words at one edit share their first or their last ``least // 2``
    characters, so each word starts in the state of its first ones, and its
    mirror image in that of its last ones. A state that leads to more than
    ``crowded`` words is parted: pairs of one length (of the shorter word) and
    with the edit in one zone of places share all outside the zone, and zones
    are halved until no state is crowded. A zone of one place holds
    words that differ in two characters at most, so a state's words are
    bounded by the alphabet whatever the corpus.
    """
    k = least // 2
    both = words.select(F.explode(F.expr("array(struct(false AS mirrored, word AS read), struct(true AS mirrored, reverse(word) AS read))")).alias("s"), "n")
    rows = both.select(
        "s.mirrored", F.lit(-1).alias("length"), F.lit(k).alias("low"), F.lit(-1).alias("high"),
        F.xxhash64("s.mirrored", F.left("s.read", F.lit(k))).alias("state"), "s.read", "n",
    )
    done = []
    while True:
        rows = written(rows, "spelling-states")
        size = rows.groupBy(*_STATE).agg(F.count("*").alias("n_words"), F.sum(F.length("read")).alias("n_chars"))
        full = (F.col("n_words") > crowded) | ((F.col("n_chars") > CROWDED_CHARS) & (F.col("n_words") > 2))
        hot = written(size.filter(full & ((F.col("low") < F.col("high")) | (F.col("length") < 0))).select(*_STATE), "spelling-crowded")
        if hot.isEmpty():
            return _all([*done, rows])
        done.append(rows.join(hot, _STATE, "left_anti").select(rows.columns))
        rows = rows.join(hot, _STATE, "left_semi").select(rows.columns)
        # Whole states are parted by length first; what was parted is halved.
        first = (
            "transform(filter(array(char_length(read), char_length(read) - 1), l -> l >= {least}), l -> struct(l AS length,"
            " if(mirrored, greatest({k}, l - {k}), {k}) AS low, l AS high))"
        ).format(least=least, k=k)
        middle = "cast((low + high) div 2 AS int)"
        half = f"array(struct(length, low, {middle} AS high), struct(length, {middle} + 1 AS low, high))"
        rows = _part(rows.filter("length < 0"), first).unionByName(_part(rows.filter("length >= 0"), half))


def _all(frames: list[DataFrame]) -> DataFrame:
    union = frames[0]
    for other in frames[1:]:
        union = union.unionByName(other)
    return union


def _dealt(words: DataFrame, least: int, crowded: int) -> DataFrame:
    rows = _states(words, least, crowded)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *_STATE).sortWithinPartitions(*_STATE, "read").select(*_STATE, "read", "n")


def _checked(least: int) -> int:
    if least < 2:
        raise ValueError("words of one character share neither a beginning nor an end")
    return least // 2


def near_pairs(words: DataFrame, least: int = 7, crowded: int = CROWDED) -> DataFrame:
    """``word``, ``near``, ``near_n`` for all pairs, in both directions, of distinct ``word`` that one edit parts; ``n`` is a word's count."""
    k = _checked(least)
    found = _dealt(words, least, crowded).mapInArrow(_emit(k), "mirrored boolean, word string, near string, near_n long")
    turn = [F.expr(f"if(mirrored, reverse({c}), {c})").alias(c) for c in ("word", "near")]
    return found.select(*turn, "near_n")


def spelling_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = r"a-zÀ-ÿ", least: int = 7, least_n: int = 2, noise: int | None = None
) -> DataFrame:
    """``word`` and ``n``: the lower-cased runs of letters of at least ``least`` characters that occur ``least_n`` times.

    Only A to Z are lower-cased. With ``noise``, a run whose hash under the
    document's id is divisible by it loses the character that the hash points
    at, which plants misspellings. A null text has no runs; a null id counts
    as an empty one.
    """
    upper = "".join(map(chr, range(65, 91)))
    text = F.translate(F.col(text_col), upper, upper.lower())
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"([{letters}]{{{least},}})"))).alias("word"))
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary"))).withColumn("at", F.expr("cast(h % char_length(word) AS int)"))
        cut = F.expr("concat(left(word, at), substring(word, at + 2))")
        runs = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of the forms that a word's form leads to.

    Rounds double what is followed, until a round changes nothing. Forms grow
    in count by a factor, so a chain has no more links than a count has digits.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = written(moved, "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_forms(words: DataFrame, least: int = 7, factor: int = 10, crowded: int = CROWDED) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every distinct ``word`` with its count ``n``.

    Words are near at exactly one inserted, deleted or replaced character. A
    word's form is its near word of the largest count, the smallest of equals,
    if that is at least ``factor`` times its own; its root is the last of the
    forms that follow, or itself.

    The words of an initial state are read into a minimal acceptor, which is
    composed with a one-edit transducer and with itself; the accepted pairs
    are counted where they are found, so a word sends one row from each of its states.
    No words give no rows.
    """
    k = _checked(least)
    words = written(words.select("word", "n"), "spelling-words")
    found = _dealt(words, least, crowded).mapInArrow(_summary(k), "mirrored boolean, word string, n_near long, near string, near_n long")
    found = found.select(F.expr("if(mirrored, reverse(word), word)").alias("word"), F.lit(None).cast("long").alias("n"), "n_near", "near", "near_n")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    summed = own.union(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    more = F.col("best.rank") * -1 >= F.col("n") * factor
    placed = written(
        summed.select("word", "n", "n_near", F.when(more, F.col("best.near")).alias("form"), F.when(more, -F.col("best.rank")).alias("form_n")), "spelling-forms"
    )
    roots = _roots(placed.filter("form IS NOT NULL"))
    return placed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
