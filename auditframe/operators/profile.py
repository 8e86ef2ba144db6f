"""Column profiling: distinct counts, ranges, value lists, metric views, column classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions import sketches
from auditframe.functions.columns import (
    batches,
    first_values,
    low_cardinality,
    numeric_columns,
    quoted,
    scalar_columns,
    time_columns,
    union_all,
    value_counts,
)

MAX_AGGREGATES = 200
VALUE_LIST_LIMIT = 20

# Type names and measure prefixes that decide a column's kind.
NUMERIC_KIND_TYPES = [
    "DOUBLE", "FLOAT", "DECIMAL", "INT", "INTEGER", "BIGINT",
    "SMALLINT", "TINYINT", "LONG", "SHORT", "BYTE", "NUMBER",
]
MEASURE_PREFIXES = [
    "avg_", "sum_", "count_", "total_", "pct_", "ratio_",
    "min_", "max_", "num_", "mean_", "median_", "stddev_",
]
# Type names of the structural classes.
STRUCTURAL_NUMERIC = [
    "byte", "short", "smallint", "int", "integer", "long", "bigint",
    "float", "double", "decimal", "numeric", "number",
]
STRUCTURAL_DATE = ["date", "timestamp", "timestamp_ntz"]


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table"), "row_count") for n, df in frames.items()]
    )


def _ranges(df: DataFrame) -> DataFrame | None:
    """Least and greatest value of numeric and time columns, one aggregate pass per batch of columns."""
    num, time = numeric_columns(df), time_columns(df)
    out = []
    for names in batches(num + time, MAX_AGGREGATES // 2):
        row = df.agg(
            *[f(quoted(c)).alias(f"{p}{k}") for k, c in enumerate(names) for p, f in (("lo", F.min), ("hi", F.max))]
        )

        def cell(p: str, k: int, c: str, kind: list[str], to: str) -> Column:
            return (F.col(f"{p}{k}") if c in kind else F.lit(None)).cast(to)

        cells = [
            F.struct(
                F.lit(c).alias("column"),
                cell("lo", k, c, num, "double").alias("min_number"),
                cell("hi", k, c, num, "double").alias("max_number"),
                cell("lo", k, c, time, "timestamp").alias("min_time"),
                cell("hi", k, c, time, "timestamp").alias("max_time"),
            )
            for k, c in enumerate(names)
        ]
        out.append(row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*"))
    return union_all(out) if out else None


_RANGE_SCHEMA = "column STRING, min_number DOUBLE, max_number DOUBLE, min_time TIMESTAMP, max_time TIMESTAMP"


def column_profile(df: DataFrame) -> DataFrame:
    """Per scalar column: distinct count, and the range of numeric and time columns.

    Distinct counts come from one unpivot and two aggregations instead of one
    ``COUNT(DISTINCT)`` per column, which would multiply every row.
    """
    distinct = (
        value_counts(df, scalar_columns(df), whole_values=False)
        .groupBy("column")
        .agg(F.count("value").alias("distinct_count"))
    )
    ranges = _ranges(df)
    if ranges is None:
        ranges = df.sparkSession.createDataFrame([], _RANGE_SCHEMA)
    return distinct.join(ranges, "column", "left")


def column_profile_approx(df: DataFrame, rsd: float = sketches.ERROR) -> DataFrame:
    """As :func:`column_profile` from sketches, with quantiles and frequent values: one scan, no shuffle of values."""
    return sketches.profile(sketches.column_sketches(df, rsd))


def column_profile_parts(parts: dict[str, DataFrame], path: str) -> DataFrame:
    """The profile of a table from its parts, each read once and stored as sketches; later parts are added to those at ``path``."""
    for name, df in parts.items():
        sketches.append_part(df, path, name)
    return sketches.profile(sketches.read_parts(next(iter(parts.values())).sparkSession, path))


def _label_columns(df: DataFrame) -> list[str]:
    skip = set(numeric_columns(df)) | set(time_columns(df))
    return [c for c in scalar_columns(df) if c not in skip]


def value_lists(df: DataFrame, limit: int = VALUE_LIST_LIMIT) -> DataFrame:
    """Sorted values of label columns that have between 1 and ``limit`` of them.

    The columns are chosen first, so no list ever grows past the limit and the
    values of wide columns are never moved.
    """
    kept = low_cardinality(df, _label_columns(df), limit)
    return kept.groupBy("column").agg(
        F.count("*").alias("distinct_count"), F.array_sort(F.collect_list("value")).alias("values")
    )


def first_distinct_values(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """The first ``limit`` distinct values of each column in order, and whether there are more."""
    ordered = first_values(value_counts(df, columns), limit + 1)
    listed = ordered.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return listed.select(
        "column", F.slice("v", 1, limit).alias("values"), (F.size("v") > limit).alias("has_more")
    )


def metric_view(df: DataFrame, dimensions: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """A metric view as a plain aggregate: named dimensions and named measures."""
    return df.groupBy(*[c.alias(n) for n, c in dimensions.items()]).agg(
        *[c.alias(n) for n, c in measures.items()]
    )


def metric_view_profile(df: DataFrame, dimensions: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Profile of the dimensions over their grouped values; measures are listed and never evaluated."""
    grouped = df.select(*[c.alias(n) for n, c in dimensions.items()]).distinct()
    dims = column_profile(grouped).withColumn("role", F.lit("dimension"))
    named = F.explode(F.array(*[F.lit(m) for m in measures]))
    listed = df.sparkSession.range(1).select(named.alias("column"), F.lit("measure").alias("role"))
    return dims.unionByName(listed, allowMissingColumns=True)


def hash_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """A repeatable sample by key: the same keys whatever the partitioning, and no shuffle."""
    bound = f"{min(int(share * 16**8), 16**8 - 1):08x}"
    return df.filter(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8) < bound)


def exact_sample(df: DataFrame, keys: list[str], n: int, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows of each stratum ``by`` (of the whole table without it), or all where there are fewer.

    The rows with the smallest seeded hashes of ``keys`` are taken, equal
    hashes in the order of the rows as JSON, so the sample is the same whatever
    the partitioning. Hashes are counted in 65,536 cells first. Rows in cells
    below the one that completes the sample pass without being sorted; only
    that cell is ranked. NULL is a stratum of its own.
    """
    draw = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[quoted(k).cast("string") for k in keys]).cast("binary"))
    rows = df.select(
        F.struct(*[quoted(c) for c in df.columns]).alias("row"),
        F.struct(F.lit(0).alias("all"), *[quoted(c).alias(f"b{k}") for k, c in enumerate(by or [])]).alias("stratum"),
        draw.alias("draw"),
    ).withColumn("cell", F.conv(F.substring("draw", 1, 4), 16, 10).cast("int"))
    cells = rows.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    opened = cells.withColumn("before", F.coalesce(below, F.lit(0))).filter(F.col("before") < n)
    last = opened.groupBy(F.col("stratum").alias("s")).agg(F.max("cell").alias("last"), (n - F.max("before")).alias("left"))
    met = rows.join(last, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("cell") <= F.col("last")))
    order = Window.partitionBy("stratum").orderBy("draw", F.to_json("row"))
    ranked = met.filter("cell = last").withColumn("rank", F.row_number().over(order)).filter("rank <= left")
    return met.filter("cell < last").select("row.*").union(ranked.select("row.*"))


def _base_type(column: str) -> Column:
    return F.trim(F.substring_index(F.col(column), "(", 1))


def column_kind(inventory: DataFrame, in_metric_view: Column | None = None, matched: Column | None = None) -> DataFrame:
    """Add ``kind`` (key, measure or dimension) from the name, the type and two optional flags."""
    name = F.lower("column_name")
    in_metric_view = F.lit(False) if in_metric_view is None else F.coalesce(in_metric_view, F.lit(False))
    matched = F.lit(False) if matched is None else F.coalesce(matched, F.lit(False))
    numeric = F.upper(_base_type("data_type")).isin(NUMERIC_KIND_TYPES)
    prefixed = name.rlike("^(" + "|".join(MEASURE_PREFIXES) + ")")
    return inventory.withColumn(
        "kind",
        F.when(name.endswith("_key") | name.endswith("_id") | (name == "id"), "key")
        .when(numeric & (prefixed | (in_metric_view & ~matched)), "measure")
        .when(matched, "dimension")
        .when(numeric, "measure")
        .otherwise("dimension"),
    )


def structural_class(inventory: DataFrame, is_key: str = "is_key") -> DataFrame:
    """Add ``structural_class``: identifier, date, numeric, categorical or other."""
    base = F.lower(_base_type("data_type"))
    return inventory.withColumn(
        "structural_class",
        F.when(F.col(is_key), "identifier")
        .when(base.isin(STRUCTURAL_DATE), "date")
        .when(base.isin(STRUCTURAL_NUMERIC), "numeric")
        .when(base.isin("string", "boolean"), "categorical")
        .otherwise("other"),
    )
