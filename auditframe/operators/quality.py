"""Data quality and integrity: null metrics, casing, keys, literals, filters, calendars, names."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.columns import (
    low_cardinality,
    scalar_columns,
    string_columns,
    value_counts,
)

# Literals read as booleans, names of pipeline and of noise columns, time phrases.
BOOLEAN_LITERALS = ["true", "false", "yes", "no", "y", "n"]
PIPELINE_NAME = (
    r"(?i)(^_etl|^_load|^_ingest|^_pipeline|^_batch|^_job_id$|^_run_id$|^_task_id$|^_execution_id$"
    r"|_created_at$|_updated_at$|_modified_at$|_inserted_at$|_loaded_at$"
    r"|^__[a-z]|^_dlt_|^_rescued_data$|^_metadata$|^dwh_|^stg_|^src_|^etl_)"
)
NOISE_NAME = (
    r"(?i)^(?:id|uuid|guid|hash|.*_hash|.*_key|etl_.*|ingest_.*|load_.*|raw_.*|.*_raw|.*_json"
    r"|debug_.*|audit_.*|col_\d+|field_\d+|fld_.*|attr_.*)$|^(?:created|updated|deleted)_at$"
)
TIME_PHRASE = (
    r"(?i)\b(this year|last \d+ months?|last \d+ days?|current year|year-to-date|ytd"
    r"|this month|this quarter|past \d+ months?)\b"
)

CASING_DISTINCT_LIMIT = 100
HIGH_NULL_RATE = 0.8
SUGGESTION_THRESHOLD = 0.85
CALENDAR_STALE_DAYS = 30
_SIMPLE_EQUALITY = re.compile(r"^\(?\s*[A-Za-z_]\w*\s*=\s*(?:'(?:[^']|'')*'|-?\d+(?:\.\d+)?)\s*\)?$")


# ---- null metrics, casing and recommendations ------------------------------


def null_metrics(df: DataFrame) -> DataFrame:
    """Per scalar column: rows, nulls, distinct values and, for strings, blanks."""
    text = string_columns(df)
    counts = value_counts(df, scalar_columns(df), whole_values=False)
    is_text = F.col("column").isin(text) if text else F.lit(False)
    blank = F.col("value").isNotNull() & (F.trim("value") == "")
    sums = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("_blank"),
    )
    rate = lambda c: F.round(F.try_divide(F.col(c), F.col("rows")), 4)
    return sums.select(
        "column", "rows", "null_count", "distinct_count",
        rate("null_count").alias("null_rate"),
        F.when(is_text, F.col("_blank")).alias("empty_count"),
        F.when(is_text, rate("_blank")).alias("empty_rate"),
    )


def casing_groups(df: DataFrame, limit: int = CASING_DISTINCT_LIMIT) -> DataFrame:
    """Lower-cased values of string columns that have several spellings or read as booleans.

    Columns with more than ``limit`` distinct values are left out; :func:`casing_skipped` names them.
    """
    kept = low_cardinality(df, string_columns(df), limit)
    return (
        kept.groupBy("column", F.lower("value").alias("normalized"))
        .agg(
            F.array_sort(F.collect_list("value")).alias("variants"),
            F.count("*").alias("variant_count"),
            F.sum("n").alias("rows"),
        )
        .withColumn("is_boolean", F.col("normalized").isin(BOOLEAN_LITERALS))
        .filter("variant_count > 1 OR is_boolean")
    )


def casing_skipped(df: DataFrame, limit: int = CASING_DISTINCT_LIMIT) -> DataFrame:
    """The string columns that have more than ``limit`` distinct values, with their number."""
    counts = value_counts(df, string_columns(df), whole_values=False)
    return counts.groupBy("column").agg(F.count("value").alias("distinct_count")).filter(F.col("distinct_count") > limit)


def casing_variants(groups: DataFrame) -> DataFrame:
    return groups.filter("variant_count > 1")


def boolean_columns(groups: DataFrame) -> DataFrame:
    """Columns that hold booleans as strings, and whether any literal comes in several casings."""
    return (
        groups.filter("is_boolean")
        .groupBy("column")
        .agg(F.max(F.col("variant_count") > 1).alias("several_casings"), F.sum("rows").alias("rows"))
    )


def recommendations(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per finding: (column, action, reason, confidence)."""
    flags = groups.groupBy("column").agg(
        F.max("is_boolean").alias("_bool"),
        F.max(F.col("is_boolean") & (F.col("variant_count") > 1)).alias("_bool_mixed"),
        F.max(~F.col("is_boolean") & (F.col("variant_count") > 1)).alias("_mixed"),
    )
    all_null = (F.col("rows") > 0) & (F.col("null_count") == F.col("rows"))
    finding = lambda action, reason, confidence: F.struct(
        F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")
    )
    rules = [
        (all_null, finding("exclude", "all_null", "high")),
        (~all_null & (F.col("null_rate") >= HIGH_NULL_RATE), finding("flag", "high_null_rate", "medium")),
        ((F.col("distinct_count") == 1) & ~all_null, finding("flag", "constant_value", "medium")),
        (F.col("_bool_mixed"), finding("flag", "inconsistent_boolean", "high")),
        (F.col("_bool") & ~F.col("_bool_mixed"), finding("flag", "boolean_as_string", "medium")),
        (F.col("_mixed"), finding("flag", "inconsistent_casing", "high")),
        (F.col("column").rlike(PIPELINE_NAME), finding("exclude", "etl_metadata", "high")),
    ]
    found = F.array_compact(F.array(*[F.when(cond, rec) for cond, rec in rules]))
    return metrics.join(flags, "column", "left").select("column", F.explode(found).alias("_r")).select("column", "_r.*")


def table_summary(metrics: DataFrame, recs: DataFrame) -> DataFrame:
    """One row: columns without findings, sparse, empty and constant columns."""
    flagged = recs.select("column").distinct().withColumn("_flagged", F.lit(True))
    rows = metrics.join(flagged, "column", "left")
    return rows.agg(
        F.count_if(F.col("_flagged").isNull()).alias("good_columns"),
        F.count_if((F.col("null_count") < F.col("rows")) & (F.col("null_count") > F.col("rows") * 0.5)).alias(
            "sparse_columns"
        ),
        F.count_if(F.col("null_count") == F.col("rows")).alias("empty_columns"),
        F.count_if(F.col("distinct_count") == 1).alias("constant_columns"),
    )


def global_summary(tables: DataFrame, recs: DataFrame) -> DataFrame:
    """One row over all tables: tables assessed and with issues, exclude and review findings.

    ``tables`` has one row per ``table``; ``recs`` carries a ``table`` column.
    """
    per_table = recs.groupBy("table").agg(
        F.count_if(F.col("action") == "exclude").alias("excludes"),
        F.count_if(F.col("action") == "flag").alias("reviews"),
    )
    return tables.join(per_table, "table", "left").agg(
        F.count("*").alias("tables_assessed"),
        F.count("excludes").alias("tables_with_issues"),
        F.coalesce(F.sum("excludes"), F.lit(0)).alias("total_recommended_excludes"),
        F.coalesce(F.sum("reviews"), F.lit(0)).alias("total_recommended_review"),
    )


# ---- keys ------------------------------------------------------------------


def fk_overlap(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row: distinct child keys, how many the parent holds, and their ratio (0 for no keys)."""
    left = child.select(F.col(fk).alias("k")).filter("k IS NOT NULL").distinct()
    right = parent.select(F.col(pk).alias("k")).distinct().withColumn("_hit", F.lit(1))
    sums = left.join(right, "k", "left").agg(
        F.count("*").alias("left_distinct"), F.count("_hit").alias("overlap")
    )
    ratio = F.coalesce(F.try_divide(F.col("overlap"), F.col("left_distinct")), F.lit(0.0))
    return sums.withColumn("overlap_ratio", F.round(ratio, 3))


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row: child rows whose key the parent lacks, NULL keys included.

    Child rows are counted per key before the join, so a hot key is one row.
    """
    counts = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    keys = parent.select(F.col(pk).alias("k")).distinct()
    return counts.join(keys, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


# ---- literals and filters --------------------------------------------------


def missing_literals(literals: DataFrame, dictionary: DataFrame, threshold: float = SUGGESTION_THRESHOLD) -> DataFrame:
    """Literals that a column's value dictionary lacks, with the closest value if close enough.

    ``dictionary`` is (column_name, values), the short lists of
    ``profile.value_lists``: each literal is compared inside its row with the
    list of its own column, so no pair of rows is built. Closeness is
    ``1 - levenshtein / longer length``.
    """
    wanted = literals.select("column_name", "literal").distinct().join(dictionary, "column_name")
    low = F.lower("literal")
    absent = wanted.filter(~F.exists("values", lambda v: F.lower(v) == low))

    def closeness(v: Column) -> Column:
        return F.lit(1.0) - F.levenshtein(low, F.lower(v)) / F.greatest(F.length("literal"), F.length(v))

    scored = F.transform("values", lambda v: F.struct(closeness(v).alias("score"), v.alias("value")))
    best = absent.select("column_name", "literal", F.array_max(scored).alias("b"))
    return best.select(
        "column_name", "literal",
        F.when(F.col("b.score") >= threshold, F.col("b.value")).alias("suggestion"),
        F.round("b.score", 3).alias("score"),
    )


def filter_selectivity(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Per filter: rows kept and a verdict, all filters in one scan.

    ``vacuous`` keeps every row; ``dead`` is a single ``column = literal`` that
    keeps none; an empty table proves neither.
    """
    names = list(filters)
    row = df.agg(
        F.count("*").alias("total"), *[F.count_if(F.expr(filters[n])).alias(f"f{k}") for k, n in enumerate(names)]
    )
    cells = [
        F.struct(
            F.lit(n).alias("name"),
            F.col(f"f{k}").alias("kept"),
            F.lit(bool(_SIMPLE_EQUALITY.match(filters[n].strip()))).alias("_eq"),
        )
        for k, n in enumerate(names)
    ]
    verdict = (
        F.when(F.col("total") == 0, "ok")
        .when(F.col("kept") >= F.col("total"), "vacuous")
        .when(F.col("_eq") & (F.col("kept") == 0), "dead")
        .otherwise("ok")
    )
    return (
        row.select("total", F.explode(F.array(*cells)).alias("_c"))
        .select("total", "_c.*")
        .withColumn("verdict", verdict)
        .drop("_eq")
    )


# ---- calendar --------------------------------------------------------------


def calendar_flags(calendar: DataFrame, as_of: dt.date, date: str = "date_key") -> DataFrame:
    """The seven calendar flags relative to ``as_of``.

    ``is_current_week`` pairs the ISO week with the calendar year, as the
    refresh statement this stands for does, so it is off around New Year.
    """
    d, today = F.col(date), F.lit(as_of)
    same_year = F.year(d) == F.year(today)
    upto = d <= today
    return calendar.withColumns(
        {
            "is_current_year": same_year,
            "is_current_month": same_year & (F.month(d) == F.month(today)),
            "is_current_week": same_year & (F.weekofyear(d) == F.weekofyear(today)),
            "is_last_12_months": (d >= F.add_months(today, -12)) & upto,
            "is_last_30_days": (d >= F.date_sub(today, 30)) & upto,
            "is_last_7_days": (d >= F.date_sub(today, 7)) & upto,
            "is_today": d == today,
        }
    )


def calendar_sanity(flagged: DataFrame, as_of: dt.date, date: str = "date_key") -> DataFrame:
    return flagged.agg(
        F.count_if("is_today").alias("today_rows"),
        F.count_if("is_current_year").alias("current_year_rows"),
        F.count_if("is_last_12_months").alias("last_12mo_rows"),
        F.max(F.when(F.col("is_current_year"), F.col(date))).alias("latest_current_year_date"),
    ).withColumn("today", F.lit(as_of))


def calendar_staleness(
    flagged: DataFrame, as_of: dt.date, max_days: int = CALENDAR_STALE_DAYS, date: str = "date_key"
) -> DataFrame:
    """One row: the newest current-year date, its age at ``as_of`` and the verdict."""
    latest = flagged.agg(F.max(F.when(F.col("is_current_year"), F.col(date))).alias("max_current_year_date"))
    aged = latest.withColumn("days_behind", F.datediff(F.lit(as_of), "max_current_year_date"))
    stale = F.col("days_behind").isNull() | (F.col("days_behind") > max_days)
    return aged.withColumn("status", F.when(stale, "stale").otherwise("ok"))


# ---- names and time phrases ------------------------------------------------


def name_flags(inventory: DataFrame, name: str = "column_name") -> DataFrame:
    return inventory.withColumn("is_pipeline", F.col(name).rlike(PIPELINE_NAME)).withColumn(
        "is_noise", F.trim(name).rlike(NOISE_NAME)
    )


def stale_temporal(questions: DataFrame, result_counts: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions with a relative time phrase whose expected result has no rows.

    ``result_counts`` is (key, n); a key it lacks has no rows.
    """
    timed = questions.filter(F.col("question").rlike(TIME_PHRASE))
    return timed.join(result_counts.filter("n > 0"), key, "left_anti")
