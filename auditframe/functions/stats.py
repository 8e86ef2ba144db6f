"""Small numeric helpers on aggregated rows."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship the helpers inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sign_tail(wins: int, discordant: int) -> float:
    """P(X >= wins) for X ~ Binomial(discordant, 1/2).

    Sums the short tail from its largest term down, so it needs about
    sqrt(discordant) steps whatever the counts.
    """
    if discordant <= 0 or wins <= 0:
        return 1.0
    if 2 * wins <= discordant:
        return 1.0 - sign_tail(discordant - wins + 1, discordant)
    log_first = (
        math.lgamma(discordant + 1) - math.lgamma(wins + 1) - math.lgamma(discordant - wins + 1)
        - discordant * math.log(2)
    )
    ratio, total, k = 1.0, 1.0, wins
    while k < discordant and ratio > 1e-18 * total:
        ratio *= (discordant - k) / (k + 1)
        total += ratio
        k += 1
    return math.exp(log_first) * total


def sign_tail_column(wins: str, discordant: str) -> Column:
    """:func:`sign_tail` over two count columns of an already aggregated frame."""

    def tail(w: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([sign_tail(int(x), int(y)) for x, y in zip(w, d)], dtype="float64")

    return F.pandas_udf(tail, "double")(wins, discordant)
