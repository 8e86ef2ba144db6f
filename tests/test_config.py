"""Fingerprints of configurations against a plain recursive normal form."""

import json
import random
import re

import pytest

from auditframe.functions import config
from auditframe.functions.config import fingerprints_column
from auditframe.operators import catalog

EDGE = re.compile(r"(?<![A-Za-z0-9])'|'(?![A-Za-z0-9])")


def normal(node, key, loose):
    """Nested tuples that are equal exactly where two documents say the same."""
    if isinstance(node, dict):
        return ("{}", tuple(sorted((k, normal(v, k, loose)) for k, v in node.items())))
    if isinstance(node, list):
        if node and key in ("content", "sql") and all(isinstance(x, str) for x in node):
            return normal("".join(node), key, loose)
        inside = [normal(x, key, loose) for x in node]
        if node and all(isinstance(x, dict) and isinstance(x.get("id"), str) for x in node):
            places = sorted(range(len(node)), key=lambda k: (node[k]["id"], k))
            return ("ids", tuple(inside[k] for k in places))
        return ("[]", tuple(inside))
    return (type(node).__name__, EDGE.sub("", node) if loose and isinstance(node, str) else node)


def expected(doc):
    top = {"version": 2} | {k: v for k, v in doc.items() if k[0] != "_" and k != "benchmarks"}
    block = doc.get("benchmarks")
    if block is not None and not isinstance(block, dict):
        return normal(top, "", True), None
    block = {k: v for k, v in (block or {}).items() if k != "questions" or v is not None}
    block.setdefault("questions", [])
    return normal(top, "", True), normal(block, "", False) if isinstance(block["questions"], list) else None


def made(rng, depth):
    """A small random value; few different parts, so that many documents are nearly or truly equal."""
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return rng.choice([None, True, 1, 1.0, 0.5, "a", "'a'", "1", "null", "", "a/b", [], {}])
    if kind == 6:
        return {k: made(rng, depth - 1) for k in rng.sample(["a", "content", "sql", "id", "a/b", "0"], rng.randrange(1, 3))}
    if kind == 7:
        return [{"id": rng.choice("xy"), "v": rng.randrange(2)} for _ in range(rng.randrange(1, 4))]
    return [made(rng, depth - 1) for _ in range(rng.randrange(1, 3))]


def test_equal_where_the_normal_forms_are(spark):
    rng = random.Random(5)
    docs = []
    for _ in range(1500):
        doc = {"config": made(rng, 3)}
        if rng.random() < 0.4:
            doc["benchmarks"] = rng.choice([None, 3, {}, {"questions": None}, {"questions": []}, {"questions": "x"}, {"n": "'q'"}, {"n": "q"}, {"questions": [made(rng, 1)]}])
        if rng.random() < 0.2:
            doc |= rng.choice([{"version": 2}, {"version": None}, {"version": 3}, {"_note": 1}])
        docs.append(doc)
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string")
    got = {r.i: tuple(r.f) for r in frame.select("i", fingerprints_column(frame.d).alias("f")).collect()}
    for part in (0, 1):
        forms, digests = {}, {}
        for i, doc in enumerate(docs):
            form, digest = expected(doc)[part], got[i][part]
            assert (form is None) == (digest is None), doc
            assert forms.setdefault(form, digest) == digest, doc
            assert digests.setdefault(digest, form) == form, doc
        assert len(forms) < len(docs)


def test_deep_and_wide(spark):
    deep = lambda end: '{"config": ' + '{"a":' * 60 + '[{"id":"x","v":' + end + "}]" + "}" * 60 + "}"
    many = lambda ids: json.dumps({"config": {"rows": [{"id": str(x % 700), "v": x} for x in ids]}})
    order = list(range(1400))
    turned = sorted(order, key=lambda x: (-(x % 700), x))
    texts = [deep("1"), deep("2"), many(order), many(turned), many(order[::-1]), '{"config": {"a": 1.0}}', '{"config": {"a": 1.00}}', '{"config": {"a": 1}}']
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, document string")
    got = [r.config_fp for r in catalog.fingerprints(frame).orderBy("doc_id").collect()]
    assert got[0] and got[1] and got[0] != got[1]
    assert got[2] == got[3] != got[4]
    assert got[5] == got[6] != got[7]


@pytest.mark.parametrize("document", ["", "null", "[]", "{}", "{", "3"])
def test_nothing_to_read(spark, document):
    frame = spark.createDataFrame([(1, document), (2, None)], "doc_id int, document string")
    assert [tuple(r)[2:] for r in catalog.fingerprints(frame).collect()] == [(None, None)] * 2


def test_digests_are_equal_where_the_leaves_are(spark):
    """Drift digests against the leaves, with quoted ids, marks, nested lists and texts under text keys at several depths."""
    rng = random.Random(8)

    def node(depth):
        kind = rng.randrange(10 if depth else 5)
        if kind < 5:
            return rng.choice([None, True, 1, 1.0, "a", "'a'", "a'", "\0", "\0\0", "\ud83d'", "1", "", [], {}, ["a", "'b"], ["a'b"]])
        if kind < 8:
            return {k: node(depth - 1) for k in rng.sample(["a", "content", "sql", "id", "b"], rng.randrange(1, 4))}
        if kind == 8:
            return [{"id": rng.choice(["x", "'x'", "x'", "\0", "y"]), "v": node(depth - 1)} for _ in range(rng.randrange(1, 4))]
        return [node(depth - 1) for _ in range(rng.randrange(1, 3))]

    docs = [{"config": node(3)} | ({"benchmarks": {"questions": node(2)}} if rng.random() < 0.5 else {}) for _ in range(1500)]
    docs += [{"config": [["a", "b"], ["c"]], "content": [["a", "b"], "c"]}, {"config": [["ab"], ["c"]], "content": ["ab", "c"]}]
    deep = lambda n, end: json.loads('{"config": ' + '{"a":' * n + json.dumps(end) + "}" * n + "}")
    docs += [deep(n, end) for n in (150, 198, 199, 200, 250) for end in ("a", "'a'", ["a"], {"content": ["a", "b"]}, {"content": "ab"}, [{"id": "2"}, {"id": "1"}], [{"id": "1"}, {"id": "2"}])]
    texts = [json.dumps(d) for d in docs] + ['{"config": 1', '{"config": 1, "benchmarks": 3}', "3"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    got = {r.i: r.f for r in frame.select("i", config.leaves_column(frame.d).alias("f")).collect()}
    for part in (0, 1):
        forms, digests = {}, {}
        for i, text in enumerate(texts):
            leaves = config.parts(text if i < len(docs) else None if text == "3" else text)[part]
            form, digest = None if leaves is None else json.dumps(leaves, sort_keys=True), got[i][part]
            assert (form is None) == (digest is None), text
            assert forms.setdefault(form, digest) == digest, text
            assert digests.setdefault(digest, form) == form, text
        assert len(forms) < len(texts)
