"""Personal data: base patterns, and terms that the corpus shows to reveal the entities they find."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written
from auditframe.llm._table import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Kinds in the order they are listed, and their patterns. Possessive runs change no match, only the
# time that a failing run of digits takes.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")

# Letters of a general form. Texts elsewhere that may hold a term although none is seen: where none of many does, the
# number to expect lies below three with a confidence of 95 per cent.
PREFIX, UNSEEN = 4, 3.0
# Words of 64 bits of the filter through which terms are counted.
FILTER_WORDS = 1 << 20


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What precedes an @ is the whole run of its characters since the last match or @, so each character is looked at once."""
    after, at = 0, text.find("@")
    while at >= 0:
        before = text[after:at]
        start = after + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        after = domain.end() if domain else at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, normal form) of every match that holds, by start, then kind; offsets are code points."""
    out = []
    if "@" in text:
        out += [(s, 0, e, text[s:e].lower()) for s, e in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end(), d))
    if "+" in text:
        out += [(m.start(), 3, m.end(), d) for m in _PHONE.finditer(text) if 10 <= len(d := _digits(m[0])) <= 15]
    return sorted(out)


def contexts(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words of a text; a word that a match goes through has the places -1, since it is masked anyway."""
    out, inside, at = [], set(), 0
    taken: list[list[int]] = []
    for start, _, end, _ in spans:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            inside.add(m[0].lower())
        else:
            out.append((m[0].lower(), m.start(), m.end()))
    return out + [(t, -1, -1) for t in sorted(inside)]


def _entity(kind: int, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}".encode(), 1) - (1 << 63)


_CONTEXT = "array<struct<term: string, start: int, stop: int>>"
_SPANS = "array<struct<start: int, kind: int, stop: int>>"
_MARKED = "array<struct<start: int, kind: int, stop: int, action: string>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"spans": ("start", "kind", "stop"), "context": ("term", "start", "stop")}
    types = {k: pa.list_(pa.struct([(n, pa.string() if n == "term" else pa.int32()) for n in v])) for k, v in names.items()}
    for b in batches:
        found: dict[str, list] = {"spans": [], "context": []}
        held = []
        for t in b.column(3):
            text = t.as_py() or ""
            spans = base_spans(text)
            held.append(sorted({_entity(kind, value) for _, kind, _, value in spans}))
            found["spans"].append([dict(zip(names["spans"], s, strict=False)) for s in spans])
            found["context"].append([dict(zip(names["context"], c, strict=True)) for c in contexts(text, spans)] if spans else [])
        held = pa.array(held, pa.list_(pa.int64()))
        text = pc.if_else(pc.greater(pc.list_value_length(held), 0), b.column(3), pa.scalar(None, b.column(3).type))
        columns = [*b.columns[:3], held, *(pa.array(found[k], types[k]) for k in names), text]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "body", "held", *names, "text"])


def _different(values: np.ndarray) -> np.ndarray:
    """Sorted different values, none negative; sorting them takes less time than numpy's hash table."""
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


def _places(terms: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for each term, or general form."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode(), g) for t, g in terms), np.uint64, len(terms))
    return tuple((hashes >> np.uint64(s) & np.uint64(64 * FILTER_WORDS - 1)).astype(np.int64) for s in (0, 32))


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the filter in which a task's terms and their general forms set bits."""
    bits = np.zeros(FILTER_WORDS, np.uint64)
    for b in batches:
        terms = pc.unique(b.column(0).flatten()).to_pylist()
        for at in _places([*((t, False) for t in terms), *((t, True) for t in {t[:PREFIX] for t in terms})]):
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    used = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(bits[used].view(np.int64))], ["word", "bits"])


def term_filter(texts: DataFrame) -> np.ndarray:
    """A Bloom filter, of one size whatever the corpus, of all ``terms`` of the texts and of their general forms."""
    words = texts.select("terms").mapInArrow(_set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def _count_terms(wanted):
    """Texts of a batch that hold each term and each general form that passes the filter; different words are taken apart once."""

    def passing(terms: list[tuple[str, bool]]) -> np.ndarray:
        if wanted is None:
            return np.ones(len(terms), bool)
        return np.logical_and.reduce([wanted.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0 for at in _places(terms)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                words = pc.utf8_split_whitespace(pc.fill_null(b.column(0), ""))
                row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(words.offsets)))
                kinds = words.flatten().dictionary_encode()
                number: dict[tuple[str, bool], int] = {}
                parts = []
                for word in kinds.dictionary.to_pylist():
                    terms = [word.lower()] if word.isalpha() else [t.lower() for t in _TERM.findall(word)]
                    parts.append([number.setdefault(k, len(number)) for t in terms for k in ((t, False), (t[:PREFIX], True))])
                size = np.array([len(p) for p in parts], np.int64)
                flat = np.array([n for p in parts for n in p], np.int64)
                pairs = _different(row * max(len(parts), 1) + kinds.indices.to_numpy())
                row, word = np.divmod(pairs, max(len(parts), 1))
                many = size[word]
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                held, row = flat[np.repeat((np.cumsum(size) - size)[word], many) + within], np.repeat(row, many)
                counted = passing(list(number))
                held, row = held[counted[held]], row[counted[held]]
                held = _different(row * max(len(number), 1) + held) % max(len(number), 1)
                times = np.bincount(held, minlength=len(number))[counted].tolist()
                terms = [("", False), *(k for k, c in zip(number, counted.tolist(), strict=True) if c)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in terms], pa.string()), pa.array([g for _, g in terms], pa.bool_()), pa.array([b.num_rows, *times], pa.int64())], ["term", "general", "n"]
                )

    return run


def term_counts(docs: DataFrame, text_col: str = "text", wanted: np.ndarray | None = None) -> DataFrame:
    """``term``, ``general``, ``n``: the number of rows that hold every term and, as general ones, first letters of terms.

    The empty term stands for all rows. Counts are combined before they are
    shuffled. With a filter of ``wanted`` terms only those are counted that
    pass it: all wanted ones and a few others, each count exact.
    """
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_terms(sent), "term string, general boolean, n long")
    return counted.groupBy("term", "general").agg(F.sum("n").alias("n"))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key`` of the row, ``body`` of the text, the entities ``held``, base ``spans`` and, where there are any, all words as ``context`` and the ``text``: a written table."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.xxhash64(text).alias("body"), text.alias("text"))
    return written(rows.mapInArrow(_find, f"doc_id long, key long, body long, held array<long>, spans {_SPANS}, context {_CONTEXT}, text string"), "entities")


def _texts(found: DataFrame) -> DataFrame:
    """The different texts that hold an entity: ``body``, ``copies``, ``held`` and their different ``terms``; a written table."""
    terms = F.array_distinct(F.transform("context", lambda c: c["term"]))
    rows = found.filter("size(held) > 0").select("body", "held", terms.alias("terms"))
    return written(rows.groupBy("body").agg(F.count("*").alias("copies"), F.first("held").alias("held"), F.first("terms").alias("terms")), "entity-texts")


def _judged(texts: DataFrame, counts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``set``, ``term``, ``action``; the entities of each set; the texts of each set.

    Entities that the same texts hold share all terms and are judged as one
    set, so that a long list of addresses is no burden.
    """
    rows = float((counts.filter("term = ''").agg(F.sum("n")).first()[0]) or 1)
    holds = texts.select("body", "copies", F.explode("held").alias("entity"))
    sizes = holds.groupBy("entity").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("rows"), F.bit_xor("body").alias("one"), F.bit_xor(F.xxhash64("body")).alias("two")
    ).withColumn("set", F.struct("texts", "one", "two"))
    reach = holds.join(sizes, "entity").select("body", "copies", "set", "rows").distinct()
    in_texts = texts.select("body", F.explode("terms").alias("term"))

    def strength(together, elsewhere):
        # 1 - log(1 / p(entity | term)) / log(1 / p(entity)); an entity that fills the corpus reveals nothing by its words.
        return F.lit(1.0) - F.log((together + elsewhere + UNSEEN) / together) / F.greatest(F.log(F.lit(rows) / F.col("set.texts")), F.lit(1e-9))

    others = lambda n, own: F.greatest(F.col(n) - F.col(own), F.lit(0))
    front = F.substring("term", 1, PREFIX)
    # No term of more rows can pass for any entity, and no pair whose term would not pass if all texts of the entity held it.
    most = sizes.agg(F.max(F.col("rows") + F.col("texts") * F.pow(F.lit(rows) / F.col("texts"), F.lit(1 - threshold)))).first()[0] or 0.0
    rare = counts.filter(~F.col("general") & (F.col("n") <= most)).select("term", "n")
    pairs = in_texts.join(rare, "term").join(reach, "body").filter(strength(F.least("set.texts", "n"), others("n", "rows")) > threshold)
    pairs = pairs.groupBy("set", "term").agg(F.count("*").alias("together"), F.sum("copies").alias("own"), F.first("n").alias("n"))
    strong = written(pairs.filter(strength(F.col("together"), others("n", "own")) > threshold).select("set", "term", front.alias("front")), "strong")
    fronts = in_texts.select("body", front.alias("front")).distinct()
    general = strong.select("set", "front").distinct().join(reach, "set").join(fronts, ["body", "front"])
    general = general.groupBy("set", "front").agg(F.count("*").alias("together"), F.sum("copies").alias("own"))
    general = general.join(counts.filter("general").select(F.col("term").alias("front"), "n"), "front")
    vague = (F.length("term") > PREFIX) & (strength(F.col("together"), others("n", "own")) <= threshold)
    judged = strong.join(general, ["set", "front"]).select("set", "term", F.when(vague, "generalise").otherwise("remove").alias("action"))
    return judged, sizes.select("set", "entity"), reach.select("set", "body")


def disclosing(found: DataFrame, counts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``entity``, ``term``, ``action``: the terms that reveal an entity, to ``generalise`` or to ``remove``.

    How strongly a term reveals an entity is the pointwise mutual information
    of the two over the entity's own information, from the texts of the whole
    corpus that hold them: 1 when the term stands in no other text, 0 when it
    says nothing. Different texts are evidence, so copies of a text that holds
    both count once; all rows without the entity count against the term, and
    UNSEEN more, which makes the strength one that holds with confidence: the
    less evidence, the rarer an entity has to be. Above ``threshold`` the term
    discloses, however often the entity is mentioned. Such a term is
    generalised to its first letters if those, counted over all terms that
    begin with them, stay at or below the threshold, and removed otherwise.
    """
    judged, members, _ = _judged(_texts(found), counts, threshold)
    return judged.join(members, "set").select("entity", "term", "action")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and the places of the marked terms of a text, in order."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("action", pa.string())]))
    for b in batches:
        rows = []
        for spans, text, terms, actions in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
            own = [(s["start"], s["kind"], s["stop"], "remove") for s in spans]
            if terms:
                action = dict(zip(terms, actions, strict=True))
                # Only where the matches lie counts for the words.
                places = contexts(text, [(start, k, stop, "") for start, k, stop, _ in own])
                own += [(start, 4, stop, action[t]) for t, start, stop in places if start >= 0 and t in action]
            rows.append([dict(zip(("start", "kind", "stop", "action"), s, strict=True)) for s in sorted(own)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, kind)], ["doc_id", "key", "spans"])


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``doc_id``, ``key`` and ``spans`` (start, kind, stop, action) of every row: base matches and disclosing terms.

    A term is a span wherever it stands in a text that holds the entity that
    it reveals. Null texts have no spans; repeated rows have the same ones.

    Only terms of texts that hold an entity can matter, so only what passes a
    filter of them is counted over the corpus.
    """
    found = entities(docs, id_col, text_col)
    texts = _texts(found)
    # Three steps read the counts, which one pass over all texts makes.
    judged, _, reach = _judged(texts, written(term_counts(docs, text_col, term_filter(texts)), "terms"), threshold)
    # A term that reveals two entities is one span; to remove it is the stronger action.
    terms = judged.join(reach, "set").groupBy("body", "term").agg(F.max("action").alias("action"))
    marks = terms.groupBy("body").agg(F.collect_list(F.struct("term", "action")).alias("marks"))
    # Texts without an entity are many, and alike ones would meet; they join nothing by the key of their row.
    body = F.when(F.size("held") > 0, F.col("body")).otherwise(F.col("key")).alias("body")
    joined = found.select("doc_id", "key", body, "spans", "text").join(marks, "body", "left")
    return joined.select("doc_id", "key", "spans", "text", F.col("marks.term").alias("terms"), F.col("marks.action").alias("actions")).mapInArrow(
        _mark, f"doc_id long, key long, spans {_MARKED}"
    )


def mask(text: str | None, spans: list) -> str | None:
    """The text with base matches as [KIND], removed terms as [TERM] and generalised ones cut to their first letters and a star."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            kind = KINDS[s["kind"]].upper()
            out += [text[at : s["start"]], f"{text[s['start'] : s['start'] + PREFIX]}*" if s["action"] == "generalise" else f"[{kind}]"]
            at = s["stop"]
        else:
            at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with entities masked and disclosing terms generalised or removed in ``text_col``; all other columns stay."""
    spans = all_spans(docs, id_col, text_col, threshold).filter("size(spans) > 0").select(F.col("key").alias("_key"), F.col("spans").alias("_spans")).distinct()

    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else mask(t, s) for t, s in zip(texts, found, strict=True)], dtype="object")

    joined = docs.withColumn("_key", F.xxhash64(id_col, text_col)).join(spans, "_key", "left")
    return joined.withColumn(text_col, F.pandas_udf(run, "string")(text_col, "_spans")).select(*docs.columns)


