"""Quality classifier: a generalised additive model with pairwise interactions over binned statistics."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.statistics import COUNTS, labelled_counts, text_counts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = [
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct",
    "top_word", "same_word", "line_words", "ended_lines", "letters",
]
# Labelled documents that a model learns from at most.
SAMPLE = 8000


def features(counts: pd.DataFrame) -> np.ndarray:
    """One row of FEATURES a document; a text without words gives zeros."""
    c = counts[COUNTS].to_numpy(dtype=np.float64)
    at = {name: c[:, i] for i, name in enumerate(COUNTS)}
    words, lines, chars = (np.maximum(at[x], 1) for x in ("n_words", "n_lines", "word_chars"))
    return np.column_stack([
        np.log1p(at["n_words"]), at["word_chars"] / words, at["n_symbols"] / words, at["n_dup_lines"] / lines,
        at["n_repeat_words"] / words, at["n_upper"] / chars, at["n_digits"] / chars, at["n_marks"] / chars,
        at["n_distinct"] / words, at["n_top_word"] / words, at["n_same_word"] / words, at["n_words"] / lines,
        at["n_ended_lines"] / lines, at["n_letters"] / chars,
    ])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Additive:
    """Intercept, bin edges, a lookup table per feature and one per pair of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: bins are looked up and added, column by column."""
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return _sigmoid(total)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins with gradient and curvature sums."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values of a tree with two levels of cuts over ordered bins."""
    values = np.zeros(len(g))
    _, middle = _cut(g, h, ridge)
    for lo, hi in ((0, middle), (middle, len(g))):
        _, cut = _cut(g[lo:hi], h[lo:hi], ridge)
        for a, b in ((lo, lo + cut), (lo + cut, hi)):
            if b > a:
                values[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return values


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree over two features: a cut of one, then a cut of the other on either side."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            gain, values = 0.0, np.zeros_like(a)
            for rows in (slice(0, cut), slice(cut, len(a))):
                gs, hs = a[rows].sum(0), b[rows].sum(0)
                more, at = _cut(gs, hs, ridge)
                gain += more + gs.sum() ** 2 / (hs.sum() + ridge)
                for cols in (slice(0, at), slice(at, a.shape[1])):
                    if gs[cols].size:
                        values[rows, cols] = gs[cols].sum() / (hs[cols].sum() + ridge)
            if gain > best[0]:
                best = (gain, values.T if turned else values)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.2, bins: int = 32, pairs: int = 4, pair_rounds: int = 30, ridge: float = 2.0
) -> Additive:
    """Cyclic boosting: in every round each feature in turn adds one shallow tree over its bins; then the pairs that gain most do.

    Without rows, or with one class only, the model is a constant.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model

    def grid(n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1])) for column in x.T]

    model.edges, model.coarse = grid(bins), grid(8)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, column, "right") for e, column in zip(model.edges, x.T, strict=True)]
    wide = [np.searchsorted(e, column, "right") for e, column in zip(model.coarse, x.T, strict=True)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for at, table in zip(fine, model.tables, strict=True):
            p = _sigmoid(total)
            step = rate * _tree(*(np.bincount(at, v, len(table)) for v in (y - p, p * (1 - p))), ridge)
            table += step
            total += step[at]
    p = _sigmoid(total)

    def sums(f: int, g: int, p: np.ndarray) -> list[np.ndarray]:
        shape = len(model.coarse[f]) + 1, len(model.coarse[g]) + 1
        return [np.bincount(wide[f] * shape[1] + wide[g], v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))]

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda fg: -_pair_tree(*sums(*fg, p), ridge)[0])
    for f, g in ranked[:pairs]:
        model.pairs[f, g] = np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1))
    for _ in range(pair_rounds):
        for (f, g), table in model.pairs.items():
            step = rate * _pair_tree(*sums(f, g, _sigmoid(total)), ridge)[1]
            table += step
            total += step[wide[f], wide[g]]
    return model


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE) -> Additive:
    """A model of ``target`` (0 or 1) from at most ``rows`` labelled documents."""
    sample = labelled_counts(docs, labels, target, rows).toPandas().sort_values([*COUNTS, "_target"])
    return fit(features(sample), sample["_target"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Additive, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` but the text, with ``score`` and ``predicted``.

    The whole text counts. Null texts and texts without words are scored as
    having no words; repeated rows repeat; columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in (text_col.lower(), "score", "predicted")]
    counted = text_counts(docs.withColumn("_key", F.struct(*[F.col(f"`{c}`") for c in keep])), text_col, ["_key"])
    points = F.pandas_udf(lambda *cols: pd.Series(model.score(features(pd.concat(cols, axis=1, keys=COUNTS)))), "double")
    scored = counted.select(*[F.col(f"_key.`{c}`") for c in keep], points(*COUNTS).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
