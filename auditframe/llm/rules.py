"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering with pruning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.statistics import labelled_counts, text_counts

# What rules may ask of a text, as SQL over its counts.
STATISTICS = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "top_word": "n_top_word / greatest(n_words, 1)",
    "same_word": "n_same_word / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "ended_lines": "n_ended_lines / greatest(n_lines, 1)",
}
# Labelled documents that rules are learned from at most.
SAMPLE = 20_000


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        values = table[self.statistic].to_numpy()
        return values > self.threshold if self.above else values <= self.threshold

    def sql(self) -> str:
        return f"({STATISTICS[self.statistic]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: pd.DataFrame) -> np.ndarray:
    return np.logical_and.reduce([c.holds(table) for c in rule]) if rule else np.ones(len(table), bool)


def _best_condition(table: pd.DataFrame, bad: np.ndarray) -> Condition | None:
    """The threshold with the largest information gain for the rows that are left, weighted by the bad ones it keeps.

    Of thresholds that gain alike the one in the widest gap is taken, as a
    share of the range of its statistic: it is the one that new texts cross least.
    """
    p, n = bad.sum(), (~bad).sum()
    before = np.log2(p / (p + n))
    best: tuple[tuple[float, float], Condition | None] = ((1e-9, 0.0), None)
    for name in STATISTICS:
        values = table[name].to_numpy()
        order = np.argsort(values, kind="stable")
        v, y = values[order], bad[order]
        ends = np.flatnonzero(np.diff(v))
        below_p = np.cumsum(y)[ends].astype(float)
        below = ends + 1.0
        for above, kept_p, kept in ((False, below_p, below), (True, p - below_p, len(v) - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(kept_p > 0, kept_p * (np.log2(kept_p / kept) - before), 0)
            if len(gain):
                wide = (v[ends + 1] - v[ends]) / (v[-1] - v[0])
                i = int(np.lexsort((wide, gain.round(9)))[-1])
                if (worth := (float(gain[i].round(9)), float(wide[i]))) > best[0]:
                    best = (worth, Condition(name, above, float((v[ends[i]] + v[ends[i] + 1]) / 2)))
    return best[1]


def learn_rules(table: pd.DataFrame, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 3, seed: int = 2) -> list[Rule]:
    """An ordered list of conjunctions that reject: each is grown on two thirds of what earlier ones leave and pruned on the rest.

    Growing adds the condition of the largest gain until no good row is
    covered. Pruning drops last conditions for the best share of bad over
    good rows. A rule enters the list when it covers ``least`` bad rows and
    ``precision`` of what it covers is bad in either part; else learning ends.
    """
    grow = np.random.default_rng(seed).permutation(len(table)) % 3 != 0
    left = np.ones(len(table), bool)
    rules: list[Rule] = []

    def tally(rule: Rule, part: np.ndarray) -> tuple[int, int]:
        hit = covers(rule, table[part])
        return int((hit & bad[part]).sum()), int((hit & ~bad[part]).sum())

    while len(rules) < most_rules:
        mine = left & grow
        rule: Rule = ()
        while len(rule) < most_conditions:
            rows = np.flatnonzero(mine)[covers(rule, table[mine])]
            if not bad[rows].any() or bad[rows].all():
                break
            condition = _best_condition(table.iloc[rows], bad[rows])
            if condition is None:
                break
            rule = (*rule, condition)
        if not rule:
            break

        def worth(size: int, rule: Rule = rule) -> float:
            p, n = tally(rule[:size], left & ~grow)
            return (p - n) / (p + n) if p + n else -1.0

        rule = rule[: max(range(len(rule), 0, -1), key=worth)]
        (p, n), (q, m) = tally(rule, left & grow), tally(rule, left & ~grow)
        if p + q < least or p < precision * (p + n) or q < precision * (q + m):
            break
        rules.append(rule)
        left &= ~covers(rule, table)
    return rules


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE) -> list[Rule]:
    """Rules for label 0 of ``target`` from at most ``rows`` labelled documents; no labels, no rules."""
    statistics = [F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()]
    sample = labelled_counts(docs, labels, target, rows).select("_target", *statistics).toPandas().sort_values(["_target", *STATISTICS], ignore_index=True)
    return learn_rules(sample[list(STATISTICS)].astype(float), sample["_target"].to_numpy() == 0)


def first_rule(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression over COUNTS: the number of the first rule that holds, else null."""
    out: Column | None = None
    for number, rule in enumerate(rules, 1):
        holds = F.expr(" AND ".join(c.sql() for c in rule))
        out = F.when(holds, F.lit(number)) if out is None else out.when(holds, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", base: str = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words") -> DataFrame:
    """All columns of ``docs`` but the text, the COUNTS of the whole text, ``base_failed``, ``rule`` and ``kept``.

    A text that fails ``base`` is not kept; of the others those that no rule
    rejects are. Null texts count as empty ones and fail; repeated rows
    repeat; columns of the input with these names are replaced. No shuffle.
    """
    counted = text_counts(docs.withColumn("_key", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])), text_col, ["_key"])
    judged = counted.withColumn("base_failed", F.expr(base)).withColumn("rule", first_rule(rules))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    own = {c.lower() for c in judged.columns if c != "_key"}
    kept = [F.col(f"_key.`{c}`") for c in docs.columns if c != text_col and c.lower() not in own]
    return judged.select(*kept, *[c for c in judged.columns if c != "_key"])
