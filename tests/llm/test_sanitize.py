import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import sanitize
from auditframe.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def reference_spans(text):
    """Leftmost matches of the plain patterns, failing ones dropped."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 10 <= len(d) <= 15,
            }[kind]
            if good(m, d):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text("a1@.-_+ (4é", max_size=40) | st.text("1234.", max_size=40) | st.text("0123456789 -", min_size=14, max_size=40) | st.text("+1 (02)-.", max_size=30))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s[:3] for s in sanitize.base_spans(text)] == reference_spans(text)


def test_base_spans_of_documents(table):
    assert sum(len(reference_spans(r.text)) for r in table("documents").collect()) > 5
    for r in [*table("documents").collect()]:
        assert [s[:3] for s in sanitize.base_spans(r.text)] == reference_spans(r.text)


def test_runs_cost_linear_time():
    for text in ("a" * 200_000 + " x@y", "1" * 200_000, "@" * 100_000, "1." * 100_000, "+1 " * 50_000):
        sanitize.base_spans(text)
    began = time.process_time()
    assert sanitize.base_spans("a@" * 500_000) == [] and sanitize.base_spans("@a" * 500_000) == []
    assert time.process_time() - began < 10


def test_parts_of_an_address_may_have_any_number_of_zeros(docs_of):
    text = "0" * 5000 + ".1.1.1"
    assert [s[:3] for s in sanitize.base_spans(text)] == [(0, 1, len(text))] and sanitize.base_spans("1" * 5000 + ".1.1.1") == []
    assert [s[:3] for s in sanitize.base_spans("00256.1.1.1 x 000255.0.0.00")] == [(14, 1, 27)]
    assert [(s.start, s.stop) for r in sanitize.all_spans(docs_of([text])).collect() for s in r.spans] == [(0, len(text))]


def test_filter_keeps_the_counts_of_what_passes(docs_of):
    texts = ["Zebra zebu write to ann@example.org", *["zebra crossing number"] * 3, "nothing wanted", None]
    docs = docs_of(texts)
    wanted = sanitize.term_filter(sanitize._texts(sanitize.entities(docs)))
    every = {(r.term, r.general): r.n for r in sanitize.term_counts(docs).collect()}
    passed = {(r.term, r.general): r.n for r in sanitize.term_counts(docs, wanted=wanted).collect()}
    assert set(passed) == {("", False), *((t, False) for t in ("zebra", "zebu", "write", "to", "ann", "example", "org")), *((t, True) for t in ("zebr", "zebu", "writ", "to", "ann", "exam", "org"))}
    assert all(every[k] == n for k, n in passed.items())


FILLER = ["the weather was fine on that day", "people walked along the river bank", "nothing else happened in town", "birds sang over old roofs"]


def corpus():
    """One phone number that stands near the word `zanzibar` in different passages; the word stands nowhere else."""
    texts = [f"{FILLER[i % 4]} zanzibar {'abcdefgh'[i]} call +1 (202) 555-0188 {FILLER[(i + 1) % 4]}" for i in range(6)]
    texts += [f"{FILLER[i % 4]} number {i} {FILLER[i % 3]}" for i in range(300)]
    return [*texts, "write me at ann@example.org or bob@example.org", "192.168.1.7 and 4111 1111 1111 1111"]


def test_a_term_that_reveals_a_number_is_found(docs_of):
    docs = docs_of(corpus())
    rows = {r.doc_id: r.spans for r in sanitize.all_spans(docs).collect()}
    texts = corpus()
    for i in range(6):
        terms = [texts[i][s.start : s.stop] for s in rows[i] if s.kind == 4]
        assert "zanzibar" in terms and "river" not in terms and "weather" not in terms
        assert [(s.start, s.kind, s.stop) for s in rows[i] if s.kind < 4] == reference_spans(texts[i])
    assert all(not rows[i] for i in range(6, 306))
    clean = {r.doc_id: r.text for r in sanitize.sanitise(docs).collect()}
    assert "zanzibar" not in clean[0] and "555-0188" not in clean[0] and "[PHONE]" in clean[0] and FILLER[0] in clean[0]
    assert clean[306] == "write me at [EMAIL] or [EMAIL]" and clean[307] == "[IP] and [CARD]" and clean[50] == texts[50]


def test_strength_is_its_definition(docs_of, spark):
    """p(entity | term) and the entity's share, counted by hand, decide at the threshold."""
    texts = corpus() + ["zanzibar is an island"] * 12
    found = sanitize.entities(docs_of(texts))
    around = found.select(F.explode("context")).count()
    total = sum(len(re.findall(r"[^\W\d_]+", t)) for t in texts)
    import math

    strength = 1 - math.log(18 / 6) / math.log(total / around)
    counts = sanitize.term_counts(docs_of(texts))
    terms = lambda t: {r.term for r in sanitize.disclosing(found, counts, threshold=t).collect()}
    assert found.select(F.explode("context").alias("c")).filter("c.term = 'zanzibar'").count() == 6
    assert "zanzibar" in terms(strength - 0.05) and "zanzibar" not in terms(strength + 0.05)


def test_general_forms_stay_and_copies_are_no_evidence(docs_of):
    texts = [f"{FILLER[i % 4]} zanzibar {'abcdefgh'[i]} call +1 (202) 555-0188" for i in range(6)] + ["zanzara zanzotto"] * 40 + [f"{FILLER[i % 4]} {i}" for i in range(200)]
    clean = {r.doc_id: r.text for r in sanitize.sanitise(docs_of(texts)).collect()}
    assert "zanz*" in clean[0]
    copies = ["secretword here call +1 (202) 555-0188 now"] * 30 + [f"{FILLER[i % 4]} {i}" for i in range(200)]
    assert all(len(r.spans) <= 1 for r in sanitize.all_spans(docs_of(copies)).collect())


def test_odd_rows(docs_of):
    docs = docs_of([*ODD, (None, "a@b.c", None, None, None), (None, None, None, None, None)]).withColumns({"key": F.lit(1), "spans": F.lit("old"), "_key": F.lit(2)})
    assert sanitize.all_spans(docs).count() == len(ODD) + 2
    got = sanitize.sanitise(docs)
    assert got.count() == len(ODD) + 2 and got.columns == docs.columns
    assert {r.text for r in got.filter("doc_id IS NULL").collect()} == {"[EMAIL]", None}
    assert sanitize.all_spans(docs_of([])).count() == 0 and sanitize.sanitise(docs_of([])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_disclosure"](spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = reference_spans(text[r.doc_id])
        base = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term:")) == base


def test_one_mention_and_distant_terms_disclose(docs_of):
    """In a corpus large enough, a term of one text, or of copies of one passage, reveals its entity wherever it stands there."""
    far = " ".join(FILLER * 12)
    one, copied = f"quixotry {far} write to ann@example.org", f"call +1 (202) 555-0188 {far} secretword"
    # A word that clean texts hold as well says nothing, near as it may be.
    texts = [one, *[copied] * 5, f"{far} public bob@example.org", *["public"] * 30, *[f"{FILLER[i % 4]} write to call {i}" for i in range(2500)]]
    spans = {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.spans if s.kind == 4] for r in sanitize.all_spans(docs_of(texts)).collect()}
    assert spans[0] == ["quixotry"] and all(spans[i] == ["secretword"] for i in range(1, 6))
    assert not any(spans[i] for i in range(6, len(texts)))


def test_rows_that_hold_a_term_are_counted(docs_of):
    texts = ["Zebra zebra zebu, (zebra)", "zebrano", "zebra a@zebu.org", None, "", "zebra a@zebu.org"]
    got = {(r.term, r.general): r.n for r in sanitize.term_counts(docs_of(texts)).collect()}
    assert got == {("", False): 6, ("zebra", False): 3, ("zebu", False): 3, ("zebrano", False): 1, ("a", False): 2, ("org", False): 2, ("zebr", True): 4, ("zebu", True): 3, ("a", True): 2, ("org", True): 2}
