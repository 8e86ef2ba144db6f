import random

from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import decontaminate as d


def substring_distance(item, text):
    """Least edits to any substring, by the table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=30), st.integers(0, 5))
def test_best_match_is_that_of_the_table(item, text, most):
    most = min(most, len(item) - 1)
    want, got = substring_distance(item, text), d.best_match(item, text, most)
    assert (got is None) == (want > most)
    if got:
        assert got[0] == want == distance(item, text[got[1] : got[2]])


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=6, max_size=18), st.text("abc", max_size=40), st.integers(0, 3))
def test_pieces_lose_no_match(item, text, most):
    import ahocorasick

    automaton, places = ahocorasick.Automaton(), {}
    for offset, piece, half, left in d.pieces(item, most):
        places.setdefault(piece, []).append((item, offset, len(piece), half, left))
    for piece, found in places.items():
        automaton.add_word(piece, found)
    automaton.make_automaton()
    want = substring_distance(item, text)
    got = d.matches(text, automaton, {item: most})
    assert (item in got) == (want <= most)
    assert not got or got[item][0] == want


ITEM = "The quick brown fox jumps over the lazy dog and runs far away."


def edited(item, edits, seed):
    r = random.Random(seed)
    out = list(item)
    for _ in range(edits):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        out[i : i + (kind != 0)] = [] if kind == 1 else [r.choice("xyz")]
    return "".join(out)


def leaks(spark, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.distance) for r in d.find_leaks(docs, bench, **kw).collect())


def test_planted_passages_are_found_and_clean_ones_left(spark, docs_of):
    rng = random.Random(1)
    texts = []
    for i in range(40):
        filler = " ".join("".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(60))
        texts.append(f"{filler}\n{edited(ITEM, i % 10, i)} {filler}" if i % 2 else filler)
    docs = docs_of(texts)
    most = int(0.1 * len(ITEM))
    want = [(i, 1, x) for i, t in enumerate(texts) if (x := substring_distance(d.plain(ITEM), d.plain(t))) <= most]
    assert len(want) > 10
    assert leaks(spark, docs, [(1, ITEM)]) == want
    assert leaks(spark, docs, [(1, ITEM), (2, "Something else that nobody wrote down")], pass_chars=50) == want


def test_case_white_space_places_and_equal_items(spark, docs_of):
    text = "é " + ITEM.upper().replace(" ", "\n") + " end"
    assert leaks(spark, docs_of([text, "no"]), [(1, ITEM), (2, ITEM.lower()), (3, None), (4, ""), (5, "short")]) == [(0, 1, 0), (0, 2, 0)]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    row = d.find_leaks(docs_of([text]), bench).first()
    assert text[row.start : row.end] == ITEM.upper().replace(" ", "\n")


def test_odd_rows_and_empty_tables(spark, docs_of):
    assert leaks(spark, docs_of(ODD), [(1, ITEM)]) == []
    assert leaks(spark, docs_of([]), [(1, ITEM)]) == []
    assert leaks(spark, docs_of([ITEM]), []) == []
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = docs_of([(None, ITEM, None, None, None), (1, ITEM, "en", "s", 1), (1, ITEM, "en", "s", 1), (2, None, "en", "s", 1), (3, "fine", "en", "s", 1)])
    kept = d.drop_leaking(docs.withColumns({"item_id": F.lit(1), "start": F.lit(2)}), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and "start" in kept.columns


def test_query_against_plain_search(spark):
    from auditframe.llm.queries import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_edit_matches"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    exact = {(x.doc_id, y.item_id) for x in docs for y in items if d.plain(y.text) in d.plain(x.text)}
    assert exact <= got
    for doc, item in got - exact:
        text, want = (next(r.text for r in rows if r[0] == i) for rows, i in ((docs, doc), (items, item)))
        assert d.best_match(d.plain(want), d.plain(text), int(0.1 * len(want)))


def test_items_of_ten_to_nineteen_characters_take_an_edit(spark, docs_of):
    texts = ["so the amber rivals win", "so the amber rivels win", "so the amber rxvels win", "the ambr rivals", "nothing"]
    assert leaks(spark, docs_of(texts), [(1, "the amber rivals"), (2, "amber rival")]) == [(0, 1, 0), (0, 2, 0), (1, 1, 1), (1, 2, 1), (3, 1, 1), (3, 2, 1)]


def test_passes_are_written_one_by_one(spark, docs_of):
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM[::-1]), (3, "amber rival")], "item_id long, text string")
    docs = docs_of([ITEM, "an amber rival", ITEM[::-1] + " amber rival"])
    got = [sorted(map(tuple, d.find_leaks(docs, bench, pass_chars=n).collect())) for n in (10, 1_000_000)]
    assert got[0] == got[1] and len(got[0]) == 4


def test_short_items_match_word_for_word(spark, docs_of):
    texts = ["It was Forty\nTwo.", "forty twos", "forty two", "forty tw", "xforty two", "forty twos, forty two", None, ""]
    items = [(1, "forty two"), (2, " Forty two "), (3, "  "), (4, ""), (5, None), (6, "tw")]
    assert leaks(spark, docs_of(texts), items) == [(0, 1, 0), (0, 2, 0), (2, 1, 0), (2, 2, 0), (3, 6, 0), (5, 1, 0), (5, 2, 0)]
    bench = spark.createDataFrame(items[:1], "item_id long, text string")
    assert [(r.start, r.end) for r in d.find_leaks(docs_of(texts[5:6]), bench).collect()] == [(12, 21)]
    assert sorted(r.doc_id for r in d.drop_leaking(docs_of(texts), bench).collect()) == [1, 3, 4, 6, 7]
