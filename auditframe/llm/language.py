"""Language of words in code-switched text by a linear-chain conditional random field, and of whole documents."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm import crf
from auditframe.llm._table import bounded_sample, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Longer words, as in scripts without spaces, are read in consecutive pieces.
LONGEST = 24
# A letter with the marks on it; numbers such as ½ and ① are none.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
BUCKETS = 1 << 17
# Sample for learning: documents a language, words of each, words of a training chain.
DOCUMENTS, WORDS, CHAIN = 150, 240, 60
_BATCH_BYTES = 4 << 20
_MOST_WORDS = 1_000_000


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    """One hash per row of character codes."""
    h = np.full(len(codes), np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for column in codes.T:
        h = (h ^ column) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h


def word_features(words: list[str], lexicon: np.ndarray) -> crf.Features:
    """Affixes of one to four letters, character n-grams of two and three with word edges, and the place in the lexicon.

    Affixes and n-grams are hashed into BUCKETS; ``lexicon`` has sorted hashes
    of whole words, whose features follow.
    """
    n = len(words)
    if not n:
        return crf.Features(np.zeros(0, np.int64), np.zeros(0, np.int64))
    length = np.array([len(w) for w in words])
    wide = int(length.max())
    codes = np.array(words, dtype=f"<U{wide}").view(np.uint32).reshape(n, wide).astype(np.uint64)
    edged = np.zeros((n, wide + 2), np.uint64)
    edged[:, 0], edged[:, 1:-1] = 1, codes
    edged[np.arange(n), length + 1] = 2
    columns = [np.zeros(n, np.int64)]  # shared by all words

    def add(hashes: np.ndarray, valid: np.ndarray) -> None:
        columns.append(np.where(valid, (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, -1))

    for order in (2, 3):
        for i in range(wide + 3 - order):
            add(_mixed(edged[:, i : i + order], order), i + order <= length + 2)
    for size in range(1, min(4, wide) + 1):
        add(_mixed(codes[:, :size], 10 + size), length > size)
        ends = np.take_along_axis(codes, np.maximum(length[:, None] - size + np.arange(size), 0), 1)
        add(_mixed(ends, 20 + size), length > size)
    if len(lexicon):
        whole = _whole(words)
        place = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        columns.append(np.where(lexicon[place] == whole, BUCKETS + place, -1))
    return crf.Features.of(np.column_stack(columns))


def _whole(words: list[str]) -> np.ndarray:
    """Hashes of whole words, as the lexicon holds them. Trailing zeros change a hash, so widths are those of LONGEST."""
    codes = np.array(words, dtype=f"<U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST).astype(np.uint64)
    return _mixed(codes, 30)


@dataclass
class Model:
    labels: list[str]
    lexicon: np.ndarray
    chain: crf.Chain | None


def letters(word: str) -> str:
    """The letters of a word with their marks."""
    return word if word.isalpha() else "".join(_LETTERS.findall(word))


def pieces(word: str) -> list[str]:
    """The letters of a word in consecutive pieces of LONGEST at most."""
    kept = letters(word)
    return [kept[i : i + LONGEST] for i in range(0, len(kept), LONGEST)]


def words_of(text: str | None) -> list[str]:
    return [p for w in (text or "").lower().split() for p in pieces(w)]


def fit(texts: list[str], langs: list[str], seed: int = 3) -> Model:
    """A field over words, from texts with their language.

    Training chains are code-switched: fragments of up to 20 words, each from
    any document, follow one another, so that transitions are learned from
    changes within a text. The lexicon has the words of three or more texts.
    Without texts the model knows no language.
    """
    labels = sorted(set(langs))
    docs = [(words_of(t), labels.index(lang)) for t, lang in zip(texts, langs, strict=True)]
    rng = np.random.default_rng(seed)
    fragments = []
    for words, label in docs:
        at = 0
        while at < len(words):
            size = int(rng.integers(3, 21))
            fragments.append((words[at : at + size], label))
            at += size
    if not fragments:
        return Model(labels, np.zeros(0, np.uint64), None)
    seen = Counter(w for words, _ in docs for w in set(words))
    lexicon = np.unique(_whole(common)) if (common := [w for w, c in seen.items() if c >= 3]) else np.zeros(0, np.uint64)
    tokens: list[str] = []
    truth: list[int] = []
    first = [0]
    for i in rng.permutation(len(fragments)):
        if len(tokens) - first[-1] >= CHAIN:
            first.append(len(tokens))
        tokens += fragments[i][0]
        truth += [fragments[i][1]] * len(fragments[i][0])
    kinds = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    items = np.array([kinds[w] for w in tokens])
    chain = crf.fit(word_features(list(kinds), lexicon), items, np.array(first), np.array(truth), len(labels), BUCKETS + len(lexicon), rounds=40)
    return Model(labels, lexicon, crf.Chain(chain.weights.astype(np.float32), chain.moves, chain.start))


def learn(docs: DataFrame, documents: int = DOCUMENTS, words: int = WORDS) -> Model:
    """A model from at most ``documents`` texts a language and ``words`` consecutive words of each, from a hashed place.

    Words longer than LONGEST count as the pieces that they are read in, so of words without end a cut of as many characters is taken.
    Rows without text or language are left out. Only this sample reaches the driver.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    parts = F.split("text", r"\s+")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.size(parts) - words, F.lit(0)) + 1) + 1
    run, most = F.array_join(F.slice(parts, start.cast("int"), words), " "), words * (LONGEST + 1)
    cut = F.substring(run, (F.pmod(F.xxhash64("text"), F.greatest(F.length(run) - most, F.lit(0)) + 1) + 1).cast("int"), F.lit(most))
    sample = bounded_sample(known, "lang", documents, 3).select("lang", cut.alias("text")).orderBy("lang", "text").collect()
    return fit([r.text for r in sample], [r.lang for r in sample])


class _Scores:
    """Label scores of words, remembered from batch to batch up to a number of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.at, self.rows = model, {}, np.zeros((0, len(model.labels)), np.float32)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word, and whether it has a letter."""
        if len(self.at) > _MOST_WORDS:
            self.at, self.rows = {}, self.rows[:0]
        at = self.at
        new = list(dict.fromkeys(w for w in words if w not in at))
        if new:
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *(self._added(new[i : i + 8192]) for i in range(0, len(new), 8192))])
        rows = self.rows[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]
        return rows.astype(np.float64), ~np.isnan(rows[:, 0])

    def _added(self, words: list[str]) -> np.ndarray:
        kept = [letters(w) for w in words]
        rows = np.full((len(words), len(self.model.labels)), np.nan, np.float32)
        some = np.array([bool(w) for w in kept])
        rows[some] = word_features([w for w in kept if w], self.model.lexicon).sums(self.model.chain.weights)
        return rows


def _predict(model: Model, with_words: bool):
    names = np.array([*model.labels, UNKNOWN], dtype=object)

    def items(kinds: pa.DictionaryArray, scores: _Scores) -> tuple[np.ndarray, ...]:
        """Scores of different words and pieces of long ones, and whether they have a letter; of every item in the texts that number and its word's."""
        known, tokens = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
        many, at = np.ones(len(known), np.int64), np.arange(len(known))
        for i in np.flatnonzero(pc.utf8_length(kinds.dictionary).to_numpy() > LONGEST):
            parts = pieces(known[i]) or [""]
            known[i] = parts[0]
            if len(parts) > 1:
                many[i], at[i] = len(parts), len(known)
                known += parts
        size = many[tokens]
        word = np.repeat(np.arange(len(tokens)), size)
        return *scores(known), at[tokens][word] + np.arange(len(word)) - (np.cumsum(size) - size)[word], word

    def label(texts: pa.Array, scores: _Scores) -> tuple[np.ndarray, ...]:
        """Per text: label, score, words with letters, switches; then ends and labels of all words."""
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        ends = np.asarray(words.offsets) - words.offsets[0].as_py()
        kinds = words.flatten().dictionary_encode()
        rows, lettered, tokens, word = items(kinds, scores)
        n_words, word_ends = len(kinds), ends
        ends = np.searchsorted(word, ends)
        own = np.flatnonzero(lettered[tokens])
        place = np.searchsorted(own, ends)
        sizes = np.diff(place)
        some = np.flatnonzero(sizes)
        lang, points, switches = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        labels = np.full(n_words, -1)
        if len(own):
            first = place[:-1][some]
            gamma = crf.posteriors(model.chain, rows[tokens[own]], first)
            share = np.add.reduceat(gamma, first, axis=0) / sizes[some][:, None]
            lang[some], points[some] = share.argmax(1), np.clip(share.max(1), 0, 1)
            best = gamma.argmax(1)
            begin = np.flatnonzero(np.diff(word[own], prepend=-1))
            labels[word[own][begin]] = best if len(begin) == len(own) else np.add.reduceat(gamma, begin, axis=0).argmax(1)
            change = np.diff(best, prepend=best[0]) != 0
            change[first] = False
            switches[some] = np.add.reduceat(change.astype(np.int64), first)
        return lang, points, sizes.astype(np.int64), switches, word_ends, labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for whole in batches:
            for b in slices(whole, "text", _BATCH_BYTES):
                if model.chain:
                    lang, points, sizes, switches, ends, labels = label(b.column(1), scores)
                else:
                    lang, points, sizes = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
                    switches, ends, labels = sizes, np.zeros(b.num_rows + 1), sizes[:0]
                columns = [b.column(0), pa.array(names[lang], pa.string()), pa.array(points), pa.array(sizes), pa.array(switches)]
                if with_words:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(names[labels], pa.string())))
                yield pa.RecordBatch.from_arrays(columns, ["_key", "lang_pred", "score", "n_words", "n_switches", "word_langs"][: len(columns)])

    return run


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text", with_words: bool = False) -> DataFrame:
    """``key``, ``lang_pred``, ``score``, ``n_words``, ``n_switches`` and on demand the language of every word.

    Words are parted by white space; those with letters form one chain per
    whole document, and the others are `und`. A word of more than LONGEST
    letters is as many items of the chain, and words in ``n_words``, as it has
    pieces of that length; its language is that of its highest mean. The document has the language
    of the highest mean word probability, its ``score``; of equal ones the
    first by name. Null texts and texts without letters are `und` at score 0,
    as all are when the model knows no language. No shuffle; repeated rows repeat.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text_col).alias("text"))
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, lang_pred string, score double, n_words long, n_switches long" + (", word_langs array<string>" if with_words else "")
    return rows.mapInArrow(_predict(model, with_words), schema).withColumnRenamed("_key", key)
