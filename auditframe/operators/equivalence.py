"""Result-set equivalence: exact bag difference, numeric multisets, verdicts.

Two bags are compared by one signed aggregate: rows of ``a`` count +1, rows of
``b`` count -1. Both directions come from one shuffle, and a row repeated many
times is reduced to one partial count per task before it travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions.columns import numeric_columns, quoted, union_all

DECIMALS = 6


def _positional(df: DataFrame) -> DataFrame:
    """Columns renamed by position; maps and variants become JSON so that they can be grouped."""
    out = []
    for k, f in enumerate(df.schema.fields):
        c = quoted(f.name)
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            c = F.to_json(c)
        out.append(c.alias(f"c{k}"))
    return df.select(*out)


def signed_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both sides by position with ``surplus`` = copies in ``a`` minus copies in ``b``."""
    left, right = _positional(a), _positional(b)
    both = left.withColumn("_d", F.lit(1)).union(right.withColumn("_d", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("_d").alias("surplus"))


def _direction(sign: int) -> Column:
    surplus = F.col("surplus") * sign
    return F.coalesce(F.sum(F.greatest(surplus, F.lit(0))), F.lit(0))


def setdiff_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of each side the other lacks, copies included."""
    return signed_bag(a, b).agg(_direction(1).alias("a_minus_b"), _direction(-1).alias("b_minus_a"))


def diff_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The unmatched rows with their side and number of unmatched copies, under the names of ``a``."""
    names = [F.col(f"c{k}").alias(n) for k, n in enumerate(a.columns)]
    return (
        signed_bag(a, b)
        .filter("surplus <> 0")
        .select(
            F.when(F.col("surplus") > 0, "a").otherwise("b").alias("side"),
            F.abs("surplus").alias("copies"),
            *names,
        )
    )


def _numbers(df: DataFrame, decimals: int) -> DataFrame:
    cells = F.array(*[quoted(c).cast("double") for c in numeric_columns(df)])
    values = df.select(F.explode(cells).alias("v")).filter("v IS NOT NULL")
    return values.select(F.round("v", decimals).alias("v"))


def numeric_equivalence(a: DataFrame, b: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """One row ``equivalent``: do both sides hold the same bag of numbers, whatever their shape?

    NULL when a side has no numeric column.
    """
    if not numeric_columns(a) or not numeric_columns(b):
        return a.sparkSession.range(1).select(F.lit(None).cast("boolean").alias("equivalent"))
    diff = setdiff_counts(_numbers(a, decimals), _numbers(b, decimals))
    return diff.select((F.col("a_minus_b") + F.col("b_minus_a") == 0).alias("equivalent"))


def compare(a: DataFrame, b: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """One row (method, equivalent): exact when the column counts match, else numbers, else none.

    The tier follows from the schemas alone, so only its plan is built.
    """
    if len(a.columns) == len(b.columns):
        diff = setdiff_counts(a, b)
        return diff.select(
            F.lit("exact").alias("method"),
            (F.col("a_minus_b") + F.col("b_minus_a") == 0).alias("equivalent"),
        )
    if numeric_columns(a) and numeric_columns(b):
        return numeric_equivalence(a, b, decimals).select(F.lit("numeric_multiset").alias("method"), "equivalent")
    return a.sparkSession.range(1).select(F.lit("none").alias("method"), F.lit(False).alias("equivalent"))


def reason_codes(generated: DataFrame, expected: DataFrame) -> DataFrame:
    """Why a generated result differs from the expected one, one code per row.

    Column codes compare names; row codes compare rows by position and apply
    when the column counts match; the type code applies to equal rows.
    """
    got, want = generated.columns, expected.columns
    same_width = len(got) == len(want)
    types_differ = same_width and [t for _, t in generated.dtypes] != [t for _, t in expected.dtypes]
    facts = [
        generated.agg(F.count("*").alias("n_got")),
        expected.agg(F.count("*").alias("n_want")),
    ]
    if same_width:
        facts.append(setdiff_counts(generated, expected))
    facts_row = union_all(facts, allow_missing=True)
    if not same_width:
        facts_row = facts_row.withColumn("a_minus_b", F.lit(None).cast("long")).withColumn(
            "b_minus_a", F.lit(None).cast("long")
        )
    facts_row = facts_row.agg(*[F.max(c).alias(c) for c in ("n_got", "n_want", "a_minus_b", "b_minus_a")])
    n_got, n_want = F.col("n_got"), F.col("n_want")
    extra, missing = F.col("a_minus_b"), F.col("b_minus_a")
    single = (n_got == 1) & (n_want == 1) & F.lit(len(got) == 1 and len(want) == 1)
    rules = {
        "EMPTY_RESULT": (n_got == 0) & (n_want > 0),
        "EMPTY_GOOD_SQL": n_want == 0,
        "RESULT_MISSING_ROWS": (missing > 0) & ~single,
        "RESULT_EXTRA_ROWS": (extra > 0) & ~single,
        "RESULT_MISSING_COLUMNS": F.lit(bool(set(want) - set(got))),
        "RESULT_EXTRA_COLUMNS": F.lit(bool(set(got) - set(want))),
        "SINGLE_CELL_DIFFERENCE": single & (extra > 0),
        "COLUMN_TYPE_DIFFERENCE": F.lit(types_differ) & (extra + missing == 0),
    }
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return facts_row.select(F.explode(codes).alias("code"))


def has_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, n, has_rows) per frame."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()]
    return union_all(counts).withColumn("has_rows", F.col("n") > 0)


def final_verdict(
    rows: DataFrame, native: str = "native", equivalent: str = "equivalent", reviewer: str = "reviewer_verdict"
) -> DataFrame:
    """Add ``final`` and ``decided_by``: native GOOD, then equal data, then the reviewer, else native or BAD."""
    verdict = F.upper(F.trim(F.coalesce(native, F.lit(""))))
    by_data = F.coalesce(F.col(equivalent), F.lit(False))
    by_reviewer = F.lower(F.trim(F.coalesce(reviewer, F.lit("")))) == "equivalent"
    good = F.lit("GOOD")
    return rows.withColumn(
        "final",
        F.when((verdict == good) | by_data | by_reviewer, good)
        .when(verdict == "", F.lit("BAD"))
        .otherwise(verdict),
    ).withColumn(
        "decided_by",
        F.when(verdict == good, "native").when(by_data, "data").when(by_reviewer, "reviewer").otherwise("native"),
    )


def run_rollup(verdicts: DataFrame, native: str = "native") -> DataFrame:
    """Per run: good, bad and review counts, native and final accuracy in percent."""
    raw = F.upper(F.trim(F.coalesce(native, F.lit(""))))
    label = F.when(raw == "", F.lit("NEEDS_REVIEW")).otherwise(raw)
    pct = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n")), F.lit(0.0)), 1)
    return (
        verdicts.groupBy("run_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(label == "GOOD").alias("good"),
            F.count_if(label == "NEEDS_REVIEW").alias("review"),
            F.count_if(~label.isin("GOOD", "NEEDS_REVIEW")).alias("bad"),
            F.count_if(F.col("final") == "GOOD").alias("final_good"),
        )
        .withColumn("accuracy_native", pct("good"))
        .withColumn("accuracy_final", pct("final_good"))
    )
