"""Many patterns against many texts, both as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written

GRAM = 3
PIECE = 4096
# What may stand beside a whole word.
EDGE = "[^a-z0-9_]"


def _grams(c: str, width: int) -> Column:
    """The different substrings of a width, NULL for shorter strings; an empty string for width 0."""
    if not width:
        return F.array(F.lit(""))
    # Whole arrays are zipped: a substring by position would count from the start of the text each time.
    chars, n = F.split(c, ""), F.greatest(F.char_length(c) - (width - 1), F.lit(0))
    out = F.slice(chars, 1, n)
    for k in range(2, width + 1):
        out = F.zip_with(out, F.slice(chars, k, n), lambda a, b: F.concat(a, b))
    return F.when(F.char_length(c) >= width, F.array_distinct(out))


def _pieces(c: str) -> Column:
    """A text in overlapping pieces of one size, which hold all its substrings of up to GRAM characters."""
    starts = F.sequence(F.lit(0), F.char_length(c), F.lit(PIECE))
    return F.transform(starts, lambda i: F.substring(F.col(c), i + 1, F.lit(PIECE + GRAM - 1)))


def _holds(whole: Column) -> Column:
    """Whether ``text`` holds ``pattern``, for ``whole`` with no letter, digit or underscore beside it."""
    quoted = F.concat(F.lit(r"\Q"), F.replace("pattern", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    bounded = F.concat(F.lit(f"(?s)(^|{EDGE})"), quoted, F.lit(f"({EDGE}|$)"))
    return F.contains("text", "pattern") & (~whole | F.rlike("text", bounded))


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The different pairs ``text``, ``pattern``, ``whole`` of which the text holds the pattern.

    ``texts`` has ``text``; ``patterns`` has ``pattern`` and ``whole``: whether
    it must stand between characters that are no ASCII letter, digit or
    underscore. Case counts; callers fold it. An empty pattern is in every
    text, a null text or pattern in none. Equal rows count once.

    A pattern meets the texts by one of its substrings of three characters
    (fewer if it is shorter), the one that fewest texts hold, and every pair
    that meets is checked in full. So the plan does not grow with the patterns,
    nothing is compared with everything, and a pattern with a substring that
    no text holds costs no more. Long texts are read in pieces of one size. Texts travel under a 64-bit hash; texts of one
    hash are told apart by the check.
    """
    known = written(texts.select("text").filter("text IS NOT NULL").distinct().withColumn("id", F.xxhash64("text")), "pattern-texts")
    wanted = written(
        patterns.select("pattern", F.col("whole").cast("boolean").alias("whole")).filter("pattern IS NOT NULL").distinct()
        .withColumn("width", F.least(F.lit(GRAM), F.char_length("pattern"))),
        "patterns",
    )
    widths = [r.width for r in wanted.select("width").distinct().collect()]  # at most four values
    if not widths:
        return known.join(wanted, known.text == wanted.pattern).select("text", "pattern", "whole")
    own = wanted.withColumn("gram", F.explode(F.coalesce(*[F.when(F.col("width") == w, _grams("pattern", w)) for w in widths])))
    pieces = known.select("id", F.explode(_pieces("text")).alias("piece"))
    held = pieces.select("id", F.explode(F.flatten(F.array_compact(F.array(*[_grams("piece", w) for w in widths])))).alias("gram"))
    # Only substrings of patterns move on; the others end at this semi-join.
    held = written(held.distinct().join(own.select("gram").distinct(), "gram", "left_semi"), "pattern-grams")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    anchors = (
        own.join(often, "gram", "left")
        .groupBy("pattern", "whole")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .filter("rarest.n > 0")
        .select("pattern", "whole", F.col("rarest.gram").alias("gram"))
    )
    met = held.join(anchors, "gram").select("id", "pattern", "whole")
    return known.join(met, "id").filter(_holds(F.col("whole"))).select("text", "pattern", "whole")
