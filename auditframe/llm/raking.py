"""Mixing to target weights: iterative proportional fitting over cells, then calibrated sampling."""

from __future__ import annotations

import hashlib
import itertools
import re
import sys
import warnings
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written
from auditframe.llm._table import packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
_LONG = re.compile(rb"[a-z]{6,}")


def topic(text: str | None) -> tuple[int, str]:
    """(words, topic) of a whole text.

    The topic stands for the most frequent run of six or more ASCII letters,
    compared without case, the first in order among equally frequent ones: a
    hash puts it into one of TOPICS. Texts without such a run have topic `none`.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    times = Counter(_LONG.findall(raw))
    most = max(times.values(), default=0)
    word = min((w for w, n in times.items() if n == most), default=None)
    return len(raw.split()), "none" if word is None else f"t{int(hashlib.md5(word).hexdigest()[0], 16) % TOPICS}"


def measured(text: Column) -> Column:
    """struct(tokens, topic) of a text; null texts have no tokens and topic `none`."""

    def both(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([topic(t) for t in texts], columns=["tokens", "topic"])

    return F.pandas_udf(both, "tokens long, topic string")(text)


def _category(name: str) -> Column:
    """A dimension's value; null and empty are one category."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def tempered(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Target shares per dimension: each category's tokens to a power, scaled to sum to one."""
    out = {}
    for name, power in powers.items():
        raw = cells.groupBy(name).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("t", F.pow(F.col("t").cast("double"), F.lit(float(power))))
        total = raw.agg(F.sum("t")).first()[0] or 1.0
        out[name] = raw.select(name, (F.col("t") / F.lit(total)).alias("share"))
    return out


# Fitting ends when a round moves no category's sum by more than this share; a corpus whose targets contradict each
# other never gets there, and ends after MOST_ROUNDS with a warning that names the miss.
TOLERANCE, MOST_ROUNDS = 1e-9, 500


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (one row per combination, with ``tokens``) with ``weight``: the factor that fits all marginals.

    Each step scales the weighted tokens of every category of one dimension
    to its target share; a round takes all dimensions and is written to the
    shared folder. Sums are combined before they are shuffled, so a category
    that most cells share is no burden. Categories without tokens, and those
    that a target does not name, keep their weight. Rounds go on until one
    finds every marginal within ``tolerance`` of its target; where ``rounds``
    are over first, a warning says how far off the farthest one is.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    now = cells.withColumn("weight", F.lit(1.0))
    for name, shares in targets.items():
        now = now.join(shares.withColumnRenamed("share", f"_{name}"), name, "left")
    now = written(now, "cells")
    off = 0.0
    for _ in range(rounds):
        now = now.withColumn("_off", F.lit(0.0))
        for name in targets:
            sums = now.groupBy(name).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_sum")).filter("_sum > 0")
            factor = F.coalesce(F.col(f"_{name}") * total / F.col("_sum"), F.lit(1.0))
            # How far the category was off before this step.
            miss = F.when(F.col("_sum").isNotNull(), F.abs(1 / factor - 1)).otherwise(0.0)
            now = now.join(sums, name, "left").withColumn("_off", F.greatest("_off", miss)).withColumn("weight", F.col("weight") * factor).drop("_sum")
        now = written(now, "cells")
        off = now.agg(F.max("_off")).first()[0] or 0.0
        if off <= tolerance:
            break
    if off > tolerance:
        warnings.warn(f"a marginal is {off:.3g} of its target away from it after {rounds} rounds", stacklevel=2)
    return now.drop("_off", *[f"_{name}" for name in targets])


def calibrate(raked: DataFrame, keep: float, steps: int | None = None) -> float:
    """The factor that turns weights into probabilities, capped at one, of which ``keep`` of all tokens are expected.

    Cells whose probability reaches one are taken whole and the others share
    what is left, until no more cells reach it (or for so many ``steps``);
    each step is one sum over the cells. The factor only grows, so cells that
    reach one stay there and the steps end.
    """
    factor, reached = keep, -1
    for _ in itertools.count() if steps is None else range(steps):
        whole = F.col("weight") * factor >= 1
        sums = raked.agg(
            F.sum("tokens").cast("double"), F.sum(F.when(whole, F.col("tokens"))).cast("double"), F.sum(F.when(~whole, F.col("tokens") * F.col("weight"))),
            F.count_if(whole & (F.col("tokens") > 0)),
        ).first()
        total, taken, rest, n = (x or 0.0 for x in sums)
        if n == reached:
            break
        factor, reached = (keep * total - taken) / rest if rest else factor, n
    return factor


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the digest of a seed and a key; null keys share one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, powers: dict[str, float], keep: float = 0.5, id_col: str = "doc_id", text_col: str = "text", rounds: int = MOST_ROUNDS, seed: int = 11
) -> DataFrame:
    """All rows with ``tokens``, ``topic``, ``weight``, ``probability`` and ``sampled``.

    ``powers`` gives each of source, language and topic its target marginal:
    shares of tokens to that power (1 leaves the corpus, 0 makes categories
    equal). Probabilities are the raked weights times one factor, at which
    ``keep`` of all tokens are expected; cells that would exceed one are taken
    whole. A row is drawn when the number its id hashes to lies below its
    probability, so
    the draw does not depend on order and repeated rows are drawn together.
    Cells number at most sources times languages times topics; the rows join
    them by equality, where a hot cell splits. Columns of the input with these
    names are replaced. An empty table gives no rows; a corpus without tokens
    keeps weight 1 and probability ``keep``. Topics and cells are found once:
    the rows are written with them.
    """
    names = list(DIMENSIONS)
    made = ("tokens", "topic", "weight", "probability", "sampled")
    rows = packed(docs.drop(*made), key=F.col(id_col), measure=measured(F.col(text_col)), **{n: _category(n) for n in names[:2]})
    rows = written(rows.select("row", "key", "source", "lang", "measure.topic", "measure.tokens"), "measured")
    cells = written(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, tempered(cells, powers), rounds)
    odds_of_one = F.least(F.lit(1.0), F.col("weight") * calibrate(raked, keep))
    drawn = rows.join(raked.select(*names, "weight", odds_of_one.alias("probability")), names)
    return drawn.withColumn("sampled", uniform(F.col("key"), seed) < F.col("probability")).select("row.*", *made)


def mix_sql(powers: dict[str, float], keep: float = 0.5, rounds: int = 40, seed: int = 11, calibration: int = 12) -> str:
    """DuckDB SQL of the same result over table ``documents``, for the columns of the registered query.

    Rounds are unrolled; those after the one that ends the fit change nothing.
    """
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    names = list(powers)
    steps, last = [], "w0"
    for r in range(rounds):
        for i, name in enumerate(names):
            now = f"w{r * len(names) + i + 1}"
            fitted = f"(SELECT max(off) <= {TOLERANCE} FROM w{r * len(names)})" if r else "false"
            factor = "coalesce(s.share * (SELECT sum(tokens) FROM cells)::DOUBLE / f.total, 1.0)"
            steps.append(
                f"{now} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN {fitted} THEN c.weight ELSE c.weight * {factor} END AS weight,"
                f" greatest({'0.0' if i == 0 else 'c.off'}, CASE WHEN f.total IS NULL THEN 0.0 ELSE abs(1 / {factor} - 1) END) AS off"
                f" FROM {last} c LEFT JOIN (SELECT {name}, sum(tokens * weight) AS total FROM {last} GROUP BY 1 HAVING total > 0) f ON c.{name} = f.{name}"
                f" LEFT JOIN share_{name} s ON c.{name} = s.{name})"
            )
            last = now
    steps.append(f"f0 AS MATERIALIZED (SELECT {float(keep)}::DOUBLE AS f)")
    for k in range(calibration):
        steps.append(
            f"f{k + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(rest, 0) = 0 THEN f ELSE ({float(keep)} * total - coalesce(taken, 0)) / rest END AS f FROM f{k},"
            f" (SELECT sum(tokens)::DOUBLE AS total, sum(tokens) FILTER (weight * f >= 1)::DOUBLE AS taken, sum(tokens * weight) FILTER (weight * f < 1) AS rest FROM {last}, f{k}))"
        )
    shares = ", ".join(
        f"share_{n} AS MATERIALIZED (SELECT {n}, t / sum(t) OVER () AS share FROM (SELECT {n}, pow(sum(tokens)::DOUBLE, {float(p)}) AS t FROM cells GROUP BY 1 HAVING sum(tokens) > 0))"
        for n, p in powers.items()
    )
    return f"""
    WITH long AS (SELECT doc_id, unnest(regexp_extract_all({lower}, '[a-z]{{6,}}')) AS word FROM documents),
    best AS (SELECT doc_id, arg_min(word, (-n, word)) AS word FROM (SELECT doc_id, word, count(*) AS n FROM long GROUP BY ALL) GROUP BY 1),
    base AS MATERIALIZED (SELECT d.doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN b.word IS NULL THEN 'none' ELSE 't' || (('0x' || substr(md5(b.word), 1, 1))::INT % {TOPICS}) END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
        FROM documents d LEFT JOIN best b USING (doc_id)),
    cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM base GROUP BY ALL),
    {shares}, w0 AS (SELECT *, 1.0::DOUBLE AS weight FROM cells), {', '.join(steps)},
    odds AS (SELECT c.*, least(1.0, weight * f) AS p FROM {last} c, f{calibration})
    SELECT doc_id, b.source, b.lang, b.topic, b.tokens, round(weight, 6) AS weight, round(p, 6) AS probability,
        ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)} < p AS sampled
    FROM base b JOIN odds o ON b.source = o.source AND b.lang = o.lang AND b.topic = o.topic"""
