"""Fingerprints of configuration documents, as digests of their leaves, and counts over their tables."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Keys that mark a configuration, fields that wrap one, keys whose string lists are one text, default
# version, and quotes at the edge of a word.
DOCUMENT_KEYS = ["data_sources", "instructions", "config", "benchmarks"]
WRAPPERS = ["serialized_space", "_parsed_space"]
TEXT_LIST_KEYS = ["content", "sql"]
DEFAULT_VERSION = 2
EDGE_QUOTE = re.compile(r"(?<![A-Za-z0-9])'|'(?![A-Za-z0-9])")
# What `.` and `$` are in a pattern of the JVM, whose line ends are more than \n.
NO_LINE_END = r"[^\n\r\u0085\u2028\u2029]"
LAST = r"(?:(?<!\r)(?=\n\Z)|(?=(?:\r\n|[\r\u0085\u2028\u2029])?\Z))"
TABLE_COUNTS = ["told_tables", "n_cols", "told_cols", "noisy", "widest", "matched", "assisted"]


def configuration(document: Column) -> Column:
    """The JSON text of the configuration inside a stored document, NULL when there is none.

    A wrapper field may hold it as an object or as text; a document that has
    one of the known keys is a configuration itself. Empty objects are none.
    """
    filled = lambda c: F.when(F.size(F.json_object_keys(c)) > 0, c)
    # A text without the letters of a wrapper's name, plain or escaped, has no such field and is not parsed for it.
    inside = [F.when(document.contains(name) | document.contains("\\u"), filled(F.get_json_object(document, f"$.{name}"))) for name in WRAPPERS]
    known = F.arrays_overlap(F.json_object_keys(document), F.array(*[F.lit(k) for k in DOCUMENT_KEYS]))
    return F.coalesce(*inside, F.when(known, document))


def _leaves(root, loose_quotes: bool) -> dict[str, str]:
    """The value of each scalar or empty container by its path.

    A step is a key, a position, or the ``id`` of an element where all
    elements have one, so neither key order nor the order of such elements
    shows; equal ids are told apart by their turn.
    """
    found = {}
    open_nodes = [("", "", root)]
    while open_nodes:
        path, key, node = open_nodes.pop()
        kind = type(node)
        if kind is list and key in TEXT_LIST_KEYS and node and all(isinstance(x, str) for x in node):
            node, kind = "".join(node), str
        if kind is str:
            found[path] = f'"{EDGE_QUOTE.sub("", node) if loose_quotes and "'" in node else node}'
        elif not node or kind not in (dict, list):
            found[path] = json.dumps(node)
        elif kind is dict:
            open_nodes += [(f"{path}/{k.replace('/', '//')}/", k, v) for k, v in node.items()]
        else:
            turn: Counter = Counter()
            named = all(isinstance(x, dict) and isinstance(x.get("id"), str) for x in node)
            for place, x in enumerate(node):
                step = x["id"].replace("/", "//") if named else ""
                turn[step] += 1
                open_nodes.append((f"{path}/{step}/{turn[step] if named else place}/", key, x))
    return found


def _blocks(text: str | None) -> tuple[dict | None, dict | None]:
    """A configuration without its benchmark block, and that block; None for what cannot be read.

    Keys of the top level that begin with an underscore are internal. A block
    without questions equals one with an empty list; questions that are no
    list cannot be read.
    """
    try:
        found = json.loads(text) if text else None
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return None, None
    visible = {"version": DEFAULT_VERSION, **{k: v for k, v in found.items() if k[:1] != "_"}}
    block = visible.pop("benchmarks", None)
    if block is not None and not isinstance(block, dict):
        return visible, None
    block = {"questions": [], **{k: v for k, v in (block or {}).items() if k != "questions" or v is not None}}
    return visible, block if isinstance(block["questions"], list) else None


def parts(text: str | None) -> tuple[dict[str, str] | None, dict[str, str] | None]:
    """Leaves of both blocks of a configuration; None for what cannot be read."""
    return tuple(None if block is None else _leaves(block, loose) for block, loose in zip(_blocks(text), (True, False)))


# Levels that a normal form may have, far below what the writer of JSON can nest; what goes deeper is compared by its leaves.
DEEP = 200
# Stands before the ids of a list whose loosened ids say less than they do; texts that begin with it get one more.
MARK = "\0"
_written = json.JSONEncoder(sort_keys=True, ensure_ascii=False, check_circular=False).encode


def _settle(root: dict, loose_quotes: bool, plain: bool) -> bool:
    """Bring a block into a normal form, in place: two forms are equal exactly where the leaves are. False where it is too deep.

    Lists of texts under TEXT_LIST_KEYS become one text, lists whose elements
    all have an ``id`` are sorted by it, texts lose loose quotes. ``plain``
    says that no text of the block holds a quote or MARK.
    """

    def text(t: str) -> str:
        t = EDGE_QUOTE.sub("", t) if loose_quotes and "'" in t else t
        return MARK + t if t[:1] == MARK else t

    def entries(node: dict | list, items, key: str | None = None) -> None:
        for at, x in items:
            kind = type(x)
            if kind is str:
                if not plain:
                    node[at] = text(x)
            elif kind is dict:
                dicts.append(x)
            elif kind is list and x:
                own = at if key is None else key
                if own in TEXT_LIST_KEYS and all(type(y) is str for y in x):
                    node[at] = text("".join(x))
                else:
                    lists.append((own, x))

    dicts, lists = [root], []
    for _ in range(DEEP):
        if not dicts and not lists:
            return True
        level, level_lists, dicts, lists = dicts, lists, [], []
        for node in level:
            entries(node, node.items())
        for key, node in level_lists:
            ids = []
            if all(type(x) is dict and type(x.get("id")) is str for x in node):
                node.sort(key=_id)
                if loose_quotes and not plain and any("'" in x["id"] for x in node):
                    ids = [MARK, *[x["id"] for x in node]]
            entries(node, enumerate(node), key)
            node[:0] = ids
    return False


def _id(node: dict) -> str:
    return node["id"]


def fingerprints_column(document: Column) -> Column:
    """struct(config_fp, benchmark_fp) of a JSON document, a batch of documents at a time."""

    def digest(leaves: dict[str, str] | None) -> str | None:
        return None if leaves is None else hashlib.sha256(json.dumps(leaves, sort_keys=True).encode()).hexdigest()

    def both(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[digest(x) for x in parts(t)] for t in texts], columns=["config_fp", "benchmark_fp"], dtype="object")

    return F.pandas_udf(both, "config_fp STRING, benchmark_fp STRING")(configuration(document))


def leaves_column(document: Column) -> Column:
    """struct(config, benchmarks): digests of both parts that are equal exactly where the leaves are; NULL for what cannot be read."""

    # Lone surrogates keep a form of their own, so that different leaves never share a text.
    digest = lambda form: hashlib.sha256(_written(form).encode("utf-8", "surrogatepass")).digest()

    def one(text: str | None) -> list[bytes | None]:
        plain = text is None or "'" not in text and "\\u" not in text
        blocks = _blocks(text)
        settled = [block is None or _settle(block, loose, plain) for block, loose in zip(blocks, (True, False))]
        if not all(settled):
            blocks = [[MARK, leaves] if not ok else block for ok, leaves, block in zip(settled, parts(text), blocks)]
        return [None if block is None else digest(block) for block in blocks]

    def both(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["config", "benchmarks"], dtype="object")

    return F.pandas_udf(both, "config BINARY, benchmarks BINARY")(configuration(document))


def _each(values: pa.Array, make) -> tuple[np.ndarray, list]:
    """The number of each row's value, and ``make`` of each distinct value."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), [make(x) for x in coded.dictionary.to_pylist()]


def table_counts(tables: pa.Array, views: pa.Array, vague: set[str], noise: re.Pattern) -> pa.StructArray:
    """TABLE_COUNTS of each document of a batch, from its lists of tables and views.

    The shown columns of a table are one per name: the first entry with a
    description, else the first. All entries of a batch are counted at once.
    """
    n = len(tables)

    def told(text: str) -> bool:
        t = text.strip(" ")
        return len(t) >= 8 and len(re.findall("[A-Za-z0-9]+", t)) >= 2 and re.sub(r"[ \t\n\x0b\f\r]+", " ", t).lower() not in vague

    def texts(of: pa.Array) -> pa.Array:
        first = pc.struct_field(of, "description")
        return pc.coalesce(pc.if_else(pc.equal(first, ""), None, first), pc.struct_field(of, "comment"), "")

    def entries(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Tables, the document of each, entries of columns (those of ``columns`` before those of ``column_configs``), the table of each."""
        flat, parts = pc.list_flatten(lists), [pc.struct_field(pc.list_flatten(lists), f) for f in ("columns", "column_configs")]
        owner = np.concatenate([pc.list_parent_indices(p).to_numpy(zero_copy_only=False) for p in parts])
        return flat, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pa.concat_arrays([pc.list_flatten(p) for p in parts]), owner

    def true(of: pa.Array, flag: str, missing: bool = False) -> np.ndarray:
        return pc.fill_null(pc.struct_field(of, flag), missing).to_numpy(zero_copy_only=False)

    per = lambda docs: np.bincount(docs, minlength=n)
    flat, doc, columns, owner = entries(tables)
    _, view_doc, view_columns, view_owner = entries(views)
    matched, assisted = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for of, docs in ((columns, doc[owner]), (view_columns, view_doc[view_owner])):
        matched += per(docs[true(of, "enable_entity_matching")])
        assisted += per(docs[true(of, "enable_format_assistance") | true(of, "format_assistance_enabled")])

    codes, good = _each(texts(flat), told)
    told_tables = per(doc[np.array(good, bool)[codes]])
    shown = ~true(columns, "exclude") & true(columns, "visible", True)
    columns, owner = columns.filter(pa.array(shown)), owner[shown]
    names, both = _each(
        pc.utf8_trim(pc.coalesce(pc.struct_field(columns, "column_name"), pc.struct_field(columns, "name"), ""), " "),
        lambda x: (x.lower(), noise.search(x) is not None),
    )
    number: dict[str, int] = {}
    keys = np.array([number.setdefault(k, len(number)) for k, _ in both], np.int64)[names]
    nameless = keys == number.get("", -1)
    keys[nameless] = len(number) + np.flatnonzero(nameless)
    written, good = _each(texts(columns), lambda x: (x == "", told(x)))
    blank, good = np.array(good, bool).reshape(-1, 2)[written].T
    # In order of table and name, entries with a text first, then as given: the first entry of each name stays.
    groups = owner * (len(number) + len(keys) + 1) + keys
    order = np.argsort(groups * 2 + blank, kind="stable")
    groups = groups[order]
    stay = order[np.r_[True, groups[1:] != groups[:-1]][: len(order)]]
    widths = np.bincount(owner[stay], minlength=len(flat))
    widest = np.zeros(n, np.int64)
    np.maximum.at(widest, doc, widths)
    docs, noisy = doc[owner[stay]], np.array([x for _, x in both], bool)[names]
    counts = [told_tables, per(docs), per(docs[good[stay]]), per(docs[noisy[stay]]), widest, matched, assisted]
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in counts], TABLE_COUNTS)


def table_counts_column(tables: Column, views: Column, vague: list[str], noise: str) -> Column:
    """struct of TABLE_COUNTS, a batch of documents at a time; ``noise`` is a pattern of the JVM for names."""
    pattern = re.compile(re.sub(r"(?<!\\)\.", lambda _: NO_LINE_END, re.sub(r"(?<!\\)\$", lambda _: LAST, noise)), re.ASCII)
    words = set(vague)

    def counted(tables: pa.Array, views: pa.Array) -> pa.Array:
        return table_counts(tables, views, words, pattern)

    return F.arrow_udf(counted, ", ".join(f"{n} INT" for n in TABLE_COUNTS))(tables, views)
