"""Text normal forms as column expressions. Every function reads the whole text."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words left out when questions are compared as token sets.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "did",
    "do", "does", "for", "from", "give", "has", "have", "how",
    "i", "in", "is", "it", "me", "my", "of", "on", "or", "our",
    "over", "per", "please", "show", "tell", "that", "the", "their",
    "there", "these", "this", "those", "to", "us", "was", "we",
    "were", "what", "whats", "when", "where", "which", "who",
    "will", "with", "would", "you", "your",
]
# Literals masked in a question template.
ISO_DATE = r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b"
NUMBER = r"(?U)(?<!\w)[+-]?(?:\d[\d,]*)(?:\.\d+)?(?!\w)"


def squeeze(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case with the sharp s opened, the fold of plain and accented Latin text."""
    return F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))


def unicode_fold(c: Column) -> Column:
    """NFKC and full case folding.

    Spark has no NFKC, so rows with non-ASCII text pass through an Arrow UDF;
    ASCII rows send NULL there and are folded in place.
    """

    def nfkc(texts: pd.Series) -> pd.Series:
        import unicodedata

        folded = [unicodedata.normalize("NFKC", t).casefold() if isinstance(t, str) else None for t in texts]
        return pd.Series(folded, dtype=object)

    foreign = c.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, F.pandas_udf(nfkc, "string")(F.when(foreign, c))).otherwise(F.lower(c))


def template_key(c: Column, unicode: bool = True) -> Column:
    """Question template: folded, dates and numbers masked, spaces squeezed, final ``?!.`` dropped."""
    text = F.coalesce(c, F.lit(""))
    text = unicode_fold(text) if unicode else F.lower(text)
    text = F.regexp_replace(text, ISO_DATE, " dateliteral ")
    text = F.regexp_replace(text, NUMBER, " numberliteral ")
    return F.trim(F.regexp_replace(squeeze(text), r"[?!.]+$", ""))


def question_key(c: Column, prefix: str = "") -> Column:
    """Dedup key of a question: trimmed, an optional label cut off, squeezed, folded."""
    text = squeeze(F.coalesce(c, F.lit("")))
    if prefix:
        cut = F.substring(text, F.lit(len(prefix) + 1), F.length(text))
        text = squeeze(F.when(F.startswith(F.lower(text), F.lit(prefix.lower())), cut).otherwise(text))
    return fold(text)


def digest(c: Column) -> Column:
    """SHA-256 of a text: what travels in a shuffle instead of the text.

    Never NULL, so that a join on it adds no null filter that would hash every text twice.
    """
    return F.coalesce(F.sha2(c.cast("binary"), 256), F.lit(""))


def plain_statement(c: Column) -> Column:
    """A statement without comments, final semicolons and quoted aliases, squeezed and lower-cased."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"--[^\n]*", " ")
    text = F.regexp_replace(text, r";+\s*$", "")
    text = F.regexp_replace(text, r"(?i)\bAS\s+`[^`]+`", "AS _alias")
    return F.lower(squeeze(text))


def statement_fingerprint(c: Column) -> Column:
    """SHA-256 of :func:`plain_statement`, empty for an empty statement."""
    plain = plain_statement(c)
    return F.when(plain == "", F.lit("")).otherwise(digest(plain))


def canonical_question(c: Column) -> Column:
    """Lower case without punctuation, squeezed; order and stopwords kept."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]+", " "))


def token_set(c: Column) -> Column:
    """Distinct words of a question without stopwords."""
    words = F.array_distinct(F.split(canonical_question(c), " "))
    return F.array_except(words, F.array(F.lit(""), *map(F.lit, STOPWORDS)))


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the squeezed lower-cased text; none for shorter texts.

    A look-ahead match reads each start position once, so the cost is linear.
    """
    text = squeeze(F.lower(F.coalesce(c, F.lit(""))))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def shape_hash(c: Column) -> Column:
    """Hash of a statement with its literals masked.

    Literals are masked by pattern, not by parsing: beyond case, white space
    and comments, differences in formatting give different shapes.
    """
    masked = F.regexp_replace(plain_statement(c), r"'(?:''|[^'])*'", "?")
    masked = F.regexp_replace(masked, r"(?<![\w.])\d+(?:\.\d+)?(?!\w)", "?")
    return digest(masked)
