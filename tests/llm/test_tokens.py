import public_tokenizers
import pytest
import sentencepiece
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import queries, tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    " ", "  two  spaces  ", "▁literal ▁ mark", "<s> </s> <unk> <0x41>", "tab\tand\nline\r\n", "日本語のテキスト 混ぜた text", "😀😀 a\x00b", "é combining",
    "1234567 12.5%", "a" * 5000, "né" * 2000, "\n" * 300, "  　", "x" * 200_000 + " y",
]


@pytest.fixture(scope="module")
def whole():
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda text: len(processor.encode(text or ""))


def test_counts_equal_the_library(docs_of, whole):
    texts = ODD + MORE + MORE[:3]
    got = sorted(tokens.count_tokens(docs_of(texts), PATH).collect())
    assert [tuple(r) for r in got] == [(i, len((t or "").encode()), whole(t)) for i, t in enumerate(texts)]


def test_counts_of_the_documents(spark, table, whole):
    want = {r.doc_id: whole(r.text) for r in table("documents").collect()}
    got = queries.op11_piece_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_without_frequent_pre_tokens_all_meet_by_the_join(docs_of, whole, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", 2.0)
    texts = ODD + MORE
    assert sorted(r.n_tokens for r in tokens.count_tokens(docs_of(texts), PATH).collect()) == sorted(map(whole, texts))


def test_repeated_rows_null_ids_and_clashing_names(docs_of, whole):
    rows = [(1, "one two", "en", "s", 1), (1, "one two", "en", "s", 1), (1, "three", "en", "s", 1), (None, "one two", "en", "s", 1), (None, None, None, None, None)]
    docs = docs_of(rows).withColumns({"pre": F.lit(1), "mark": F.lit(2), "n_tokens": F.lit(3), "a.b": F.lit(4)})
    got = tokens.count_tokens(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), whole(t)) for i, t, *_ in rows)
    assert tokens.count_tokens(docs.limit(0), PATH).collect() == []


def test_pre_tokens_are_encoded_once(docs_of):
    found = tokens.pre_tokens(docs_of(["a b a", "b a", None]), open(PATH, "rb").read()).collect()
    assert sorted(map(tuple, found)) == [("▁a", 2, 1), ("▁b", 2, 1)]
