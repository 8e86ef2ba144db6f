import itertools
import zlib

import numpy as np
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import crf, language
from auditframe.llm.queries import QUERIES


def paths(chain, scores):
    """Every label sequence of one chain with its score."""
    k = len(chain.start)
    for y in itertools.product(range(k), repeat=len(scores)):
        yield y, chain.start[y[0]] + sum(scores[i, a] for i, a in enumerate(y)) + sum(chain.moves[a, b] for a, b in itertools.pairwise(y))


def random_chain(rng, k=3):
    return crf.Chain(np.zeros((1, k)), 2 * rng.normal(size=(k, k)), rng.normal(size=k))


def test_forward_backward_and_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(15):
        chain, lengths = random_chain(rng), rng.integers(1, 6, 5)
        first = np.cumsum(lengths) - lengths
        scores = 3 * rng.normal(size=(lengths.sum(), 3))
        gamma, best = crf.posteriors(chain, scores, first), crf.viterbi(chain, scores, first)
        for f, n in zip(first, lengths, strict=True):
            want, ranked = np.zeros((n, 3)), list(paths(chain, scores[f : f + n]))
            for y, s in ranked:
                want[np.arange(n), y] += np.exp(s)
            assert np.allclose(gamma[f : f + n], want / want.sum(1, keepdims=True))
            assert tuple(best[f : f + n]) == max(ranked, key=lambda r: r[1])[0]


def test_long_chains_keep_exact_messages():
    """Strips give what one pass over the whole chain gives."""
    rng = np.random.default_rng(1)
    chain, n = random_chain(rng), 5000
    scores = 5 * rng.normal(size=(n, 3))
    local, moves = np.exp(scores - scores.max(1, keepdims=True)), np.exp(chain.moves)
    alpha, beta = np.empty((n, 3)), np.ones((n, 3))
    alpha[0] = np.exp(chain.start) * local[0]
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] / alpha[t - 1].sum()) @ moves * local[t]
    for t in range(n - 2, -1, -1):
        beta[t] = moves @ (local[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    want = alpha * beta
    assert np.allclose(crf.posteriors(chain, scores, np.array([0])), want / want.sum(1, keepdims=True))


def test_fitting_raises_likelihood_and_learns_moves():
    rng = np.random.default_rng(2)
    labels = np.repeat(rng.integers(0, 2, 200), 10)
    items = np.where(rng.random(2000) < 0.8, labels, 1 - labels)
    features = crf.Features.of(np.array([[0, 1], [0, 2]]))
    chain = crf.fit(features, items, np.arange(0, 2000, 50), labels, 2, 3, rounds=150)
    assert chain.moves[0, 0] > chain.moves[0, 1] and chain.moves[1, 1] > chain.moves[1, 0]
    gamma = crf.posteriors(chain, features.sums(chain.weights)[items], np.arange(0, 2000, 50))
    assert (gamma.argmax(1) == labels).mean() > 0.9 > (items == labels).mean() + 0.05


EN = "the house stands near the river where people walk with their dogs every morning"
DE = "das haus steht nahe dem fluss und die leute gehen dort jeden morgen mit ihren hunden"


def test_words_of_code_switched_text(docs_of):
    model = language.fit([EN, DE] * 3, ["en", "de"] * 3)
    switched = "the people walk every morning und die leute gehen jeden morgen 42"
    row = language.predict(docs_of([switched]), model, with_words=True).first()
    assert row.word_langs == ["en"] * 5 + ["de"] * 6 + ["und"] and row.n_switches == 1 and row.n_words == 11


def test_odd_rows(docs_of):
    model = language.fit([EN, DE] * 3, ["en", "de"] * 3)
    docs = docs_of([*ODD, "Die Leute gehen", (None, "the people", None, None, None)]).withColumns({"lang_pred": F.lit("old"), "_key": F.lit(1)})
    rows = language.predict(docs, model).collect()
    assert [r.lang_pred for r in rows[:4]] == ["und"] * 4 and [r.score for r in rows[:4]] == [0.0] * 4
    assert all(r.lang_pred in ("en", "de") and 0.5 <= r.score <= 1 for r in rows[4:])
    assert (rows[7].lang_pred, rows[7].score) == (rows[8].lang_pred, rows[8].score)
    assert rows[-2].lang_pred == "de" and rows[-1].doc_id is None
    assert language.predict(docs_of([]), model).count() == 0


def test_nothing_to_learn_from(docs_of):
    model = language.learn(docs_of([(1, None, "en", "s", 1), (2, EN, None, "s", 1)]))
    assert {(r.lang_pred, r.score) for r in language.predict(docs_of([EN, None]), model).collect()} == {("und", 0.0)}
    one = language.learn(docs_of([(1, EN, "en", "s", 1)]))
    assert language.predict(docs_of([DE]), one).first().lang_pred == "en"


def test_the_sample_is_bounded(docs_of):
    from auditframe.llm._table import bounded_sample

    docs = docs_of([(i % 50, f"text {i % 60}", "en" if i % 9 else "de", "s", 1) for i in range(900)]).select("text", "lang")
    got = bounded_sample(docs, "lang", 7, 1).collect()
    assert sorted(r.lang for r in got) == ["de"] * 7 + ["en"] * 7 and len({(r.lang, r.text) for r in got}) == 14


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_crf_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.97


def test_lexicon_features_do_not_depend_on_other_words():
    """A known short word has its lexicon feature alone and beside words of any length."""
    lexicon = np.unique(language._whole(["house", "haus"]))
    for others in ([], ["a"], ["riverbank"], ["x" * language.LONGEST]):
        features = language.word_features(["house", "unknown", *others], lexicon)
        of = np.split(features.flat, features.first[1:])
        assert [f for f in of[0] if f >= language.BUCKETS] == [language.BUCKETS + np.searchsorted(lexicon, language._whole(["house"])[0])]
        assert all((f < language.BUCKETS).all() for f in of[1:])


def test_a_text_scores_alike_alone_and_in_any_batch(docs_of):
    model = language.fit([EN, DE] * 3, ["en", "de"] * 3)
    assert np.abs(model.chain.weights[language.BUCKETS :]).max(1).all()
    texts = [EN, DE, "the house und das haus", "x" * language.LONGEST + " river", "a"]
    together = {r.doc_id: r.score for r in language.predict(docs_of(texts).coalesce(1), model).collect()}
    for i, t in enumerate(texts):
        assert abs(language.predict(docs_of([t]), model).first().score - together[i]) < 1e-12


def test_letters_are_those_of_unicode_with_their_marks(docs_of):
    assert language.letters("½²①") == "" and language.letters("हिन्दी!") == "हिन्दी" and language.letters("n\u0303o2") == "n\u0303o" and language.letters("\u0301") == ""
    model = language.fit(["the river of the town", "der fluss in der stadt"] * 3, ["en", "de"] * 3)
    rows = {r.doc_id: r.lang_pred for r in language.predict(docs_of(["½ ² ①", "\u0301 12", "the river"]), model).collect()}
    assert rows[0] == rows[1] == "und" and rows[2] in ("en", "de")


def test_all_letters_of_long_words_are_read(docs_of):
    """Unspaced texts whose middle differs from both ends, and one that switches within a run."""
    han, kana = "".join(map(chr, range(0x4E00, 0x4E40))), "".join(map(chr, range(0x3042, 0x3082)))
    model = language.fit([han * 20, kana * 20] * 3, ["zh", "ja"] * 3)
    texts = [han[:12] + kana * 6 + han[:12], han * 6 + "9 " + kana * 3, kana[:24], "12345678901234567890123456789", kana * 3 + " " + han[:5]]
    rows = {r.doc_id: r for r in language.predict(docs_of(texts).coalesce(1), model, with_words=True).collect()}
    assert [rows[i].lang_pred for i in range(5)] == ["ja", "zh", "ja", "und", "ja"]
    assert [rows[i].n_words for i in range(5)] == [-(-(24 + 6 * 64) // 24), 16 + 8, 1, 0, 8 + 1]
    assert rows[1].n_switches == 1 and rows[1].word_langs == ["zh", "ja"] and rows[4].word_langs == ["ja", "zh"] and rows[3].word_langs == ["und"]
    # A long run is cut before it reaches the driver's sample.
    assert language.learn(docs_of([(1, han * 2000, "zh", "s", 1), (2, kana * 2000, "ja", "s", 1)])).labels == ["ja", "zh"]
