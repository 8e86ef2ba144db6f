import random
import re
import zlib
from collections import Counter

import pytest
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import queries, spelling


def one_edit(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) - len(v) == 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def neighbours(words):
    """Near words by brute force: every word under itself and itself less one character."""
    under = {}
    for w in words:
        for key in {(w, -1)} | {(w[:i] + w[i + 1 :], i) for i in range(len(w))} | {(w[:i] + w[i + 1 :], -1) for i in range(len(w))}:
            under.setdefault(key, set()).add(w)
    near = {w: set() for w in words}
    for group in under.values():
        for w in group:
            near[w] |= {o for o in group if one_edit(w, o)}
    return near


def forms(counts, factor=10):
    """What the contract says, word by word."""
    near, out = neighbours(counts), {}
    for w, own in near.items():
        best = min(own, key=lambda o: (-counts[o], o), default=None)
        out[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while out[root]:
            root = out[root]
        rows.append((w, n, len(near[w]), out[w], counts[out[w]] if out[w] else None, root))
    return sorted(rows)


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_composition_finds_each_pair_once(letters):
    rng = random.Random(letters)
    for _ in range(150):
        words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        want = sorted((u, v) for i, v in enumerate(words) for u in words[:i] if one_edit(u, v))
        assert sorted(tuple(sorted(p)) for p in spelling.near_in(words)) == want


def test_acceptor_is_minimal():
    machine = spelling.Acceptor(sorted(["walking", "talking", "walked", "talked", "walk", "talk"]))
    # The root, what "walk" and "talk" share, and the end.
    assert len(machine.arcs) == 3


@pytest.mark.parametrize("crowded", [50_000, 20, 4])
def test_pairs_of_crowded_states(spark, crowded):
    rng = random.Random(7)
    words = {"aaa" + "".join(rng.choices("ab", k=rng.randint(4, 8))) for _ in range(200)} | {"".join(rng.choices("ab", k=rng.randint(4, 7))) + "bbb" for _ in range(200)}
    words |= {w + "é" for w in list(words)[:30]} | {"a" * n for n in range(7, 40)} | {"x" * 3000, "x" * 2999, "y" + "x" * 2999}
    counts = {w: rng.choice([2, 3, 20, 21, 250]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.near_pairs(df, 7, crowded).collect()
    want = neighbours(counts)
    assert sorted((r.word, r.near) for r in got) == sorted((w, o) for w, own in want.items() for o in own)
    assert all(r.near_n == counts[r.near] for r in got)
    rows = spelling.spelling_forms(df, crowded=crowded).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, rows)) == forms(counts)


def test_forms_of_the_documents(spark, table):
    counts = Counter()
    for r in table("documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if not (h := zlib.crc32(f"{r.doc_id}:{run}".encode())) % 31:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = queries.op12_spelling_forms(spark, "/root/testdata/sf0.001").select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == forms(counts)
    assert any(r.root not in (r.word, r.form) for r in got) or any(r.form for r in got)


def test_chains_lead_to_the_last_form(spark):
    counts = {"letters": 1, "lettersa": 10, "lettersab": 100, "lettersabc": 1000, "lettersabcd": 10_000, "lettersabcde": 100_000}
    rows = spelling.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r.word: r.root for r in rows} == dict.fromkeys(counts, "lettersabcde")


def test_odd_texts_and_names(docs_of):
    texts = [*ODD, "ÉCOLIERS École-s ×÷écoliers", "spelling Spelling", "z" * 30_000, "z" * 30_000]
    docs = docs_of(texts).withColumns({"word": F.lit(1), "h": F.lit(2), "at": F.lit(3), "a.b": F.lit(4)}).withColumn("id", F.lit(5))
    rows = {r.word: r.n for r in spelling.spelling_words(docs).collect()}
    assert rows == {"spelling": 2, "z" * 30_000: 2}
    found = spelling.spelling_forms(spelling.spelling_words(docs)).collect()
    assert sorted((r.n_near, r.form, r.root == r.word) for r in found) == [(0, None, True)] * 2
    assert spelling.spelling_forms(spelling.spelling_words(docs.limit(0))).collect() == []
    nulls = docs_of([(None, "spelling spelling", None, None, None)])
    assert [tuple(r) for r in spelling.spelling_words(nulls, noise=31).collect()] in ([("spelling", 2)], [])
    with pytest.raises(ValueError):
        spelling.spelling_forms(spelling.spelling_words(docs), least=1)
