"""Evidence-weighted ranking of columns and allocation of slots.

Per-table windows here run over column metadata: one row per column of a
table, after the log has been aggregated to columns.
"""

from __future__ import annotations

import datetime as dt
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.patterns import occurrences
from auditframe.operators.profile import STRUCTURAL_DATE, STRUCTURAL_NUMERIC
from auditframe.operators.text import age_in_days, recency

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_FREQUENCY_FACTOR = 3.0
IN_SCOPE_FACTOR = 2.0
LOOKBACK_DAYS = 30
EXTENDED_LOOKBACK_DAYS = 90
MIN_SHAPES = 20
MAX_ACTIVE = 50
CORE_TARGET = 40
EXPLORATION_TARGET = 5
INITIAL_TARGET = 45
VALUE_SLOTS = 120

# Weights of statement roles; reason priorities and the ones that require a column.
ROLE_WEIGHTS = {"join": 6.0, "filter": 5.0, "group": 4.0, "aggregate": 4.0, "order": 2.0, "projection": 1.0}
REASON_PRIORITY = {
    "REPAIR_FAILURE": 0,
    "BENCHMARK_SQL": 1,
    "CONFIG_SQL": 2,
    "JOIN_KEY": 2,
    "METRIC_FIELD": 3,
    "QUERY_HISTORY": 3,
    "COLUMN_BEHAVIOR": 4,
    "SEMANTIC_MATCH": 4,
    "STRUCTURAL_COVERAGE": 5,
    "EXPLORATION": 6,
}
HARD_REASONS = ["REPAIR_FAILURE", "BENCHMARK_SQL", "CONFIG_SQL", "JOIN_KEY"]
DEFAULT_PRIORITY = 3
UNKNOWN_PRIORITY = 99
CATEGORY_ORDER = ["identifier", "date", "numeric", "categorical", "other"]
# Words left out of column and corpus tokens, and words that name a concept.
TOKEN_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "how", "in", "is", "it", "of", "on", "or", "show", "that", "the",
    "to", "what", "when", "where", "which", "with",
]
CONCEPT_WORDS = [
    "date", "day", "month", "quarter", "year", "timestamp",
    "amount", "price", "revenue", "sales", "cost", "margin",
    "quantity", "qty", "count", "units",
    "status", "state", "stage",
    "country", "region", "city", "state", "location",
    "category", "type", "segment", "class",
    "id", "key", "identifier", "code",
]
# Name and description patterns of value-dictionary candidates.
CATEGORICAL_NAMES = [
    "industry", "type", "status", "state", "country", "region",
    "department", "category", "segment", "code", "tier", "level",
    "stage", "phase", "class", "group", "channel", "source", "priority",
    "currency", "unit", "role", "gender", "brand", "vendor", "supplier",
]
FREE_TEXT_NAMES = [
    "description", "comment", "notes", "address", "email", "url",
    "path", "body", "message", "content", "text", "summary", "detail",
    "narrative", "reason", "explanation",
]
PERSONAL_NAMES = [
    "email", "ssn", "social_security", "phone", "address_line",
    "dob", "date_of_birth", "tax_id", "credit_card", "passport",
    "driver_license", "account_number", "bank_account",
]
FLAG_NAMES = ["_flag", "_yn", "_bool", "is_", "has_", "can_", "should_"]
PERSONAL_HINTS = ["pii", "sensitive"]
POSITIVE_HINTS = ["enum", "category", "lookup", "one of", "valid values"]
NEGATIVE_HINTS = ["internal", "etl", "audit", "deprecated", "do not use"]
MIN_CARDINALITY, MAX_CARDINALITY, MAX_DISTINCT_RATIO = 2, 1024, 0.8
# Words that are never column names.
SQL_WORDS = [
    "SELECT", "FROM", "WHERE", "AND", "OR", "GROUP", "BY",
    "ORDER", "LIMIT", "JOIN", "ON", "AS", "IN", "NOT", "IS",
    "NULL", "CASE", "WHEN", "THEN", "ELSE", "END", "HAVING",
    "WITH", "UNION", "ALL", "DISTINCT", "COUNT", "SUM", "AVG",
    "MIN", "MAX", "LOWER", "UPPER", "TRIM", "CAST", "STRING",
    "INT", "BIGINT", "DATE", "TIMESTAMP", "TRUE", "FALSE",
    "BETWEEN", "LIKE", "EXISTS", "LEFT", "RIGHT", "INNER",
    "OUTER", "FULL", "CROSS", "ASC", "DESC", "OVER",
    "PARTITION", "ROW", "ROWS", "CURRENT", "PRECEDING",
    "FOLLOWING", "UNBOUNDED",
]
MENTION = r"(?m)`(\w+)`|(?:^|\.)(\w+)(?:\s|,|\)|$)"


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _lookup(c: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


# ---- history ------------------------------------------------------------------


def exclusion_reason(log: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``excluded``: the first rule a row meets, NULL when it meets none."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        reason = F.when(cond, name).otherwise(reason)
    return log.withColumn("excluded", reason)


def exclusion_counts(log: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return exclusion_reason(log, rules).filter("excluded IS NOT NULL").groupBy("excluded").agg(F.count("*").alias("n"))


def relevant_log(
    log: DataFrame, assets: list[str], as_of: dt.datetime, days: int = LOOKBACK_DAYS,
    target_space: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Finished statements of the window that belong to the target agent or name a configured asset.

    Qualified names match anywhere, leaf names as whole words. With ``limit``
    the target's own statements come first, then the newest; without one the
    rows have no order. The time filter is first: it is the one the scan can use.
    """
    text = F.lower(F.replace(F.coalesce("statement_text", F.lit("")), F.lit("`"), F.lit("")))
    parts = [a.lower().split(".") for a in assets]
    qualified = sorted({".".join(p) for p in parts if len(p) > 1} | {".".join(p[-2:]) for p in parts if len(p) > 1})
    leaves = sorted({p[-1] for p in parts})
    named = _any(text, qualified)
    if leaves:
        named = named | text.rlike("(^|[^a-z0-9_])(" + "|".join(map(re.escape, leaves)) + ")([^a-z0-9_]|$)")
    mine = F.coalesce(F.col("space_id") == target_space, F.lit(False)) if target_space else F.lit(False)
    rows = (
        log.filter(F.col("start_time") >= F.lit(as_of - dt.timedelta(days=days)))
        .filter("execution_status = 'FINISHED'")
        .filter(mine | named)
        .withColumn("in_scope", mine)
    )
    order = [F.desc("in_scope"), F.desc("start_time"), F.asc("statement_id")]
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def relevant_log_of(
    log: DataFrame, assets: DataFrame, as_of: dt.datetime, days: int = LOOKBACK_DAYS, target_space: str | None = None
) -> DataFrame:
    """The rows of ``relevant_log`` for any number of assets, a frame with ``asset``; null assets name nothing.

    Names and statements meet as relations, each different statement once, so
    the plan does not grow with the assets.
    """
    text = F.lower(F.replace(F.coalesce("statement_text", F.lit("")), F.lit("`"), F.lit("")))
    mine = F.coalesce(F.col("space_id") == target_space, F.lit(False)) if target_space else F.lit(False)
    rows = (
        log.filter(F.col("start_time") >= F.lit(as_of - dt.timedelta(days=days)))
        .filter("execution_status = 'FINISHED'")
        .withColumn("in_scope", mine)
    )
    others = rows.filter(~F.col("in_scope")).withColumn("_text", text)
    parts = F.split(F.lower("asset"), r"\.")
    # Who names an asset in full names its last two parts.
    qualified = F.when(F.size(parts) > 1, F.struct(F.concat_ws(".", F.slice(parts, -2, 2)).alias("pattern"), F.lit(False).alias("whole")))
    leaf = F.struct(F.element_at(parts, -1).alias("pattern"), F.lit(True).alias("whole"))
    names = assets.filter("asset IS NOT NULL").select(F.explode(F.array_compact(F.array(qualified, leaf))).alias("_n")).select("_n.*")
    named = occurrences(others.select(F.col("_text").alias("text")), names).select(F.col("text").alias("_text")).distinct()
    return rows.filter("in_scope").unionByName(others.join(named, "_text", "left_semi").drop("_text"))


def adaptive_lookback(
    log: DataFrame, keys: list[str], shape: str, as_of: dt.datetime, days: int = LOOKBACK_DAYS,
    extended: int = EXTENDED_LOOKBACK_DAYS, min_shapes: int = MIN_SHAPES,
) -> DataFrame:
    """Rows of the last ``days``, or of the longer window for keys with too few shapes; ``window_days`` says which.

    Both windows come from one filtered read; shapes are counted on a distinct
    (key, shape) frame and decide by a join on the key.
    """
    age = age_in_days("start_time", as_of)
    recent = log.filter(F.col("start_time") >= F.lit(as_of - dt.timedelta(days=extended))).withColumn("_age", age)
    shapes = recent.filter(F.col("_age") <= days).select(*keys, shape).distinct().groupBy(*keys).agg(F.count(shape).alias("_n"))
    few = F.coalesce(F.col("_n"), F.lit(0)) < min_shapes
    window = F.when(few, extended).otherwise(days)
    return (
        recent.join(shapes, keys, "left")
        .withColumn("window_days", window)
        .filter(F.col("_age") <= F.col("window_days"))
        .drop("_age", "_n")
    )


def history_score(usage: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Per column: the sum over statement shapes of role weight x recency x frequency x scope.

    Uses of a shape are counted first, so a busy shape is one row. A shape
    counts with its weightiest role, its newest use, a frequency factor of at
    most 3, and doubly when any use was in scope. Uses older than 90 days are
    dropped.
    """
    weight = _lookup(F.col("sql_role"), ROLE_WEIGHTS, 1.0)
    _, factor = recency(age_in_days("start_time", as_of))
    shapes = (
        usage.withColumn("_r", factor)
        .filter("_r IS NOT NULL")
        .groupBy("table_name", "column_name", "shape_id")
        .agg(
            F.max(weight).alias("weight"), F.max("_r").alias("recency"), F.count("*").alias("uses"),
            F.max("in_scope").alias("in_scope"), F.max("start_time").alias("last_used"),
        )
    )
    frequency = F.least(F.lit(MAX_FREQUENCY_FACTOR), 1 + F.log1p(F.col("uses") - 1))
    scope = F.when(F.col("in_scope"), IN_SCOPE_FACTOR).otherwise(1.0)
    return shapes.groupBy("table_name", "column_name").agg(
        F.sum(F.col("weight") * F.col("recency") * frequency * scope).alias("score"),
        F.sum("uses").alias("uses"),
        F.count("*").alias("shapes"),
        F.count_if("in_scope").alias("in_scope_shapes"),
        F.max("last_used").alias("last_used_at"),
    )


# ---- evidence and rank -----------------------------------------------------------


def tokens(c: Column) -> Column:
    """Words of a name or text in order: camel case and underscores split, short and stop words dropped."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    words = F.regexp_extract_all(F.lower(F.replace(spaced, F.lit("_"), F.lit(" "))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    stop = F.array(*map(F.lit, TOKEN_STOPWORDS))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def semantic_score(columns: DataFrame, texts: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Add ``semantic_score``: how well a column's name and description meet the text that describes its tables.

    8 when the whole name occurs, 2 per shared name word up to 8, 1 per shared
    description word up to 4, 2 when the name holds a concept word.
    """
    text = texts.select(key, F.array_join(tokens(F.col(body)), " ").alias("_text"), F.array_distinct(tokens(F.col(body))).alias("_words"))
    name, described = tokens(F.col("column_name")), tokens(F.col("description"))
    phrase = F.array_join(name, " ")
    whole = F.when((phrase != "") & F.coalesce(F.contains(F.col("_text"), phrase), F.lit(False)), 8.0).otherwise(0.0)
    words = F.coalesce("_words", F.array().cast("array<string>"))
    shared = lambda t: F.size(F.array_intersect(F.array_distinct(t), words))
    concept = F.when(F.arrays_overlap(name, F.array(*map(F.lit, dict.fromkeys(CONCEPT_WORDS)))), 2.0).otherwise(0.0)
    score = whole + F.least(F.lit(8.0), 2.0 * shared(name)) + F.least(F.lit(4.0), shared(described).cast("double")) + concept
    return columns.join(text, key, "left").withColumn("semantic_score", score).drop("_text", "_words")


def structural_score(columns: DataFrame, is_key: str = "is_key") -> DataFrame:
    """Add ``structural_score``: key 5, date 4, number 3, text or boolean 2, else 1."""
    base = F.lower(F.trim(F.substring_index("data_type", "(", 1)))
    return columns.withColumn(
        "structural_score",
        F.when(F.col(is_key), 5.0)
        .when(base.isin(STRUCTURAL_DATE), 4.0)
        .when(base.isin(STRUCTURAL_NUMERIC), 3.0)
        .when(base.isin("string", "boolean"), 2.0)
        .otherwise(1.0),
    )


def merged_evidence(sources: DataFrame) -> DataFrame:
    """(table, column, reason, score) rows of all sources as one row per column.

    ``reasons`` are ordered by priority, then name. ``priority`` and
    ``hard_score`` come from the hard reasons only; the other scores keep one
    column per reason for :func:`stable_rank`.
    """
    priority = _lookup(F.col("reason"), REASON_PRIORITY, 99)
    hard = F.col("reason").isin(HARD_REASONS)
    positive = sources.filter("score > 0").withColumn("_p", priority)
    per_reason = positive.groupBy("table_name", "column_name", "reason", "_p").agg(F.sum("score").alias("score"))

    def of(reason: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("reason") == reason, F.col("score"))), F.lit(0.0))

    per_column = per_reason.groupBy("table_name", "column_name").agg(
        F.array_sort(F.collect_list(F.struct("_p", "reason"))).alias("_reasons"),
        F.coalesce(F.min(F.when(hard, F.col("_p"))), F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.max(hard).alias("is_hard"),
        F.array_agg(F.when(hard, F.struct("_p", "score"))).alias("_hard"),
        of("QUERY_HISTORY").alias("history_score"),
        of("METRIC_FIELD").alias("metric_score"),
        of("COLUMN_BEHAVIOR").alias("behavior_score"),
        of("SEMANTIC_MATCH").alias("semantic_score"),
        of("STRUCTURAL_COVERAGE").alias("structural_score"),
        F.sum("score").alias("evidence_score"),
    )
    top_hard = F.aggregate(
        "_hard", F.lit(0.0), lambda acc, x: acc + F.when(x["_p"] == F.col("priority"), x["score"]).otherwise(0.0)
    )
    return (
        per_column.withColumn("hard_score", top_hard)
        .withColumn("reasons", F.col("_reasons.reason"))
        .drop("_reasons", "_hard")
    )


def stable_rank(evidence: DataFrame) -> DataFrame:
    """Add ``stable_rank`` per table: priority, then the scores from hard to structural, then the id."""
    w = Window.partitionBy("table_name").orderBy(
        F.asc("priority"), F.desc("hard_score"), F.desc("history_score"), F.desc("metric_score"),
        F.desc("behavior_score"), F.desc("semantic_score"), F.desc("structural_score"), F.asc("column_name"),
    )
    return evidence.withColumn("stable_rank", F.row_number().over(w))


def select_core(ranked: DataFrame, core: int = CORE_TARGET, max_active: int = MAX_ACTIVE) -> DataFrame:
    """Add ``selected``: every required column, then the best ranked up to ``core``; hidden ones never.

    The sequential rule "append until full" becomes two running counts: the
    place among the required columns and among the others.
    """
    visible = ~F.coalesce("hidden", F.lit(False))
    required = visible & F.col("is_hard")
    w = Window.partitionBy("table_name").orderBy("stable_rank")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranked.withColumn("_nth_required", F.sum(required.cast("int")).over(upto)).withColumn(
        "_direct", required & (F.col("_nth_required") <= max_active)
    )
    filler = visible & ~F.col("_direct") & (F.col("priority") != REASON_PRIORITY["EXPLORATION"])
    counted = counted.withColumn("_n_direct", F.sum(F.col("_direct").cast("int")).over(Window.partitionBy("table_name"))).withColumn(
        "_nth_filler", F.sum(filler.cast("int")).over(upto)
    )
    filled = filler & (F.col("_n_direct") + F.col("_nth_filler") <= core)
    return counted.withColumn("selected", F.col("_direct") | filled).drop("_nth_required", "_direct", "_n_direct", "_nth_filler")


def explore(selected: DataFrame, seed: str, slots: int = EXPLORATION_TARGET, initial: int = INITIAL_TARGET) -> DataFrame:
    """Add ``explored``: a few unselected columns per table, first one per class not yet present, then by hash.

    The hash of the seed and the column id makes the order repeatable.
    """
    pool = (~F.coalesce("hidden", F.lit(False))) & ~F.col("selected")
    per_table = Window.partitionBy("table_name")
    chosen = F.collect_set(F.when(F.col("selected"), F.col("structural_class"))).over(per_table)
    rows = (
        selected.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col("column_id")).cast("binary"), 256))
        .withColumn("_new", ~F.array_contains(chosen, F.col("structural_class")))
        .withColumn("_free", F.greatest(F.lit(0), F.least(F.lit(slots), F.lit(initial) - F.sum(F.col("selected").cast("int")).over(per_table))))
        .withColumn("_pool", pool)
    )
    in_class = Window.partitionBy("table_name", "structural_class", "_pool").orderBy("_h")
    rank = _lookup(F.col("structural_class"), {c: k for k, c in enumerate(CATEGORY_ORDER)}, len(CATEGORY_ORDER))
    first = F.col("_new") & (F.row_number().over(in_class) == 1)
    rows = rows.withColumn("_first", F.when(first, rank).otherwise(99))
    order = Window.partitionBy("table_name", "_pool").orderBy("_first", "_h")
    nth = rows.withColumn("_n", F.row_number().over(order))
    return nth.withColumn("explored", F.col("_pool") & (F.col("_n") <= F.col("_free"))).drop("_h", "_new", "_free", "_pool", "_first", "_n")


def activate(plan: DataFrame, requests: DataFrame, max_active: int = MAX_ACTIVE) -> DataFrame:
    """Activate one requested column per table, evicting the worst-ranked active one if the table is full.

    ``plan`` has (table_name, column_id, stable_rank, active, is_join_key,
    protected); ``requests`` (table_name, column_id, reason). Join keys,
    protected and requested columns are never evicted. ``eviction_reason`` and
    ``activation_reason`` say what changed; when no column can go, ``status``
    is ``full`` and nothing changes.
    """
    rows = plan.join(requests.select("table_name", F.col("column_id").alias("_want"), "reason"), "table_name", "left")
    wanted = F.coalesce(F.col("column_id") == F.col("_want"), F.lit(False))
    per_table = Window.partitionBy("table_name")
    evictable = F.col("active") & ~F.col("is_join_key") & ~F.col("protected") & ~wanted
    rows = (
        rows.withColumn("_is_want", wanted)
        .withColumn("_active_n", F.sum(F.col("active").cast("int")).over(per_table))
        .withColumn("_already", F.max(wanted & F.col("active")).over(per_table))
        .withColumn("_known", F.max(wanted).over(per_table))
        .withColumn("_victim", F.max(F.when(evictable, F.struct("stable_rank", "column_id"))).over(per_table))
    )
    asks = F.col("_known") & ~F.col("_already")
    must_evict = asks & (F.col("_active_n") >= max_active)
    full = must_evict & F.col("_victim").isNull()
    goes = must_evict & ~full & (F.col("column_id") == F.col("_victim.column_id"))
    comes = asks & ~full & F.col("_is_want")
    return rows.select(
        "table_name", "column_id", "stable_rank",
        F.when(goes, False).when(comes, True).otherwise(F.col("active")).alias("active"),
        F.when(goes, F.concat(F.lit("promoted:"), F.col("_want"))).alias("eviction_reason"),
        F.when(comes, F.lower("reason")).alias("activation_reason"),
        F.when(full, "full").when(F.col("_already"), "already_active").when(asks, "activated").otherwise("unchanged").alias("status"),
    )


def _fold_requests(max_active: int):
    """One table's requests in order over its columns; the state is a dictionary per column."""
    priority = dict(REASON_PRIORITY)

    def by_priority(codes) -> list[str]:
        return sorted(codes, key=lambda c: (priority.get(c, UNKNOWN_PRIORITY), c))

    def run(plan: pd.DataFrame, requests: pd.DataFrame) -> pd.DataFrame:
        rows = plan.to_dict("records")
        for r in rows:
            r["reason_codes"] = [] if r["reason_codes"] is None else list(r["reason_codes"])
            r["priority"] = min((priority.get(c, UNKNOWN_PRIORITY) for c in r["reason_codes"]), default=None)
            r |= {"eviction_reason": None, "activation_reason": None, "asked": 0, "refused": 0}
        columns = {r["column_id"]: r for r in rows}
        active = {c for c, r in columns.items() if r["active"]}
        fixed = {c for c, r in columns.items() if r["protected"]}
        for ask in requests.sort_values(["place", "column_id", "reason"], kind="stable").itertuples():
            target = columns.get(ask.column_id)
            if target is None:
                continue
            target["asked"] += 1
            if not target["hidden"] and ask.column_id in active:
                continue
            loose = [c for c in active if c not in fixed and "JOIN_KEY" not in columns[c]["reason_codes"]]
            if target["hidden"] or (len(active) >= max_active and not loose):
                target["refused"] += 1
                continue
            if len(active) >= max_active:
                out = max(loose, key=lambda c: (columns[c]["stable_rank"], c))
                active.remove(out)
                columns[out]["eviction_reason"] = f"promoted:{ask.column_id}"
            active.add(ask.column_id)
            target["reason_codes"] = by_priority({*target["reason_codes"], ask.reason})
            target["priority"] = min(priority.get(c, UNKNOWN_PRIORITY) for c in target["reason_codes"])
            target["activation_reason"] = ask.reason.lower()
        for r in rows:
            r["active"] = r["column_id"] in active
        return pd.DataFrame(rows, columns=_FOLDED).astype({"priority": "Int32"})

    return run


_FOLDED = [
    "table_name", "column_id", "stable_rank", "active", "eviction_reason", "activation_reason", "reason_codes", "priority", "asked", "refused",
]


def activate_in_order(plan: DataFrame, requests: DataFrame, max_active: int = MAX_ACTIVE) -> DataFrame:
    """Activate the requested columns of every table one after another, each on what the ones before left.

    ``plan`` has a row per column: (table_name, column_id, stable_rank, active,
    protected, hidden, reason_codes); ``requests`` (table_name, column_id,
    reason, place), taken by place, ties by column and reason. A request for an
    active column changes nothing. On a full table the active column with the
    last ``stable_rank`` (ties: last id; no rank: after all) goes that is neither
    protected nor a join key; if there is none, or the column is hidden, the
    request is refused. An activated column takes the reason into its
    ``reason_codes``, which then stand by priority, and the ``priority`` of the
    foremost. ``asked`` and ``refused`` count its requests.

    Null places come last. Null columns, and columns without a plan row, ask for
    nothing; a null reason is ``EXPLORATION``. The requests of one table are one
    sequence and are folded in one task, with its columns as the state; tables
    are spread. Columns are unique in a table.
    """
    named = plan.filter("table_name IS NOT NULL").select(
        "table_name", "column_id", F.coalesce("stable_rank", F.lit(999_999)).cast("int").alias("stable_rank"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("active", "protected", "hidden")], "reason_codes",
    )
    # New names inside, since requests may have been derived from the plan itself.
    asked = requests.filter("column_id IS NOT NULL").select(
        F.col("table_name").alias("table_name"), F.col("column_id").alias("column_id"), F.coalesce("reason", F.lit("EXPLORATION")).alias("reason"), F.col("place").cast("long").alias("place")
    )
    known = asked.join(named.select("table_name", "column_id").distinct(), ["table_name", "column_id"], "left_semi")
    schema = (
        "table_name string, column_id string, stable_rank int, active boolean, eviction_reason string, activation_reason string, "
        "reason_codes array<string>, priority int, asked long, refused long"
    )
    return named.groupBy("table_name").cogroup(known.groupBy("table_name")).applyInPandas(_fold_requests(max_active), schema)


# ---- value dictionaries ------------------------------------------------------------


def entity_score(columns: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``score`` (0 to 10) and ``reason``: does a column deserve a value dictionary?

    Rejections are checked in a fixed order and score 0. Columns without a
    profile (cardinality 0 or NULL) skip the cardinality checks.
    """
    name = F.lower("column_name")
    text = F.lower(F.coalesce("description", F.lit("")))
    card = F.coalesce("cardinality", F.lit(0))
    rows = F.coalesce("row_count", F.lit(0))
    profiled = card > 0
    rejects = [
        (F.col("verdict") == "tainted", "rls_tainted"),
        ((F.col("verdict") == "unknown") & F.lit(strict), "rls_unknown_strict"),
        (_any(name, PERSONAL_NAMES), "pii_name"),
        (_any(name, FREE_TEXT_NAMES), "free_text_name"),
        (_any(name, FLAG_NAMES), "boolean_flag"),
        (_any(text, PERSONAL_HINTS), "pii_description"),
        (profiled & (card < MIN_CARDINALITY), "cardinality_too_low"),
        (profiled & (card > MAX_CARDINALITY), "cardinality_too_high"),
        (profiled & (rows > 0) & (card / rows > MAX_DISTINCT_RATIO), "id_like_distinct_ratio"),
    ]
    reason = F.lit("ok")
    for cond, label in reversed(rejects):
        reason = F.when(cond, label).otherwise(reason)
    fit = (
        F.when(_any(name, CATEGORICAL_NAMES), 3.0).otherwise(1.0)
        + F.when(~profiled, 0.0).when(card.between(5, 200), 2.0).when((card > 200) & (card <= 1024), 1.0)
        .when(card.between(2, 4), 0.3).otherwise(0.0)
        + F.when(F.coalesce("referenced", F.lit(False)), 3.0).otherwise(0.0)
        + F.when(_any(text, POSITIVE_HINTS), 1.0).otherwise(0.0)
        - F.when(_any(text, NEGATIVE_HINTS), 2.0).otherwise(0.0)
    )
    scored = columns.withColumn("reason", reason)
    return scored.withColumn(
        "score", F.when(F.col("reason") == "ok", F.greatest(F.lit(0.0), F.least(fit, F.lit(10.0)))).otherwise(0.0)
    )


def slot_diff(scored: DataFrame, slots: int = VALUE_SLOTS) -> DataFrame:
    """Give the slots to the best columns and compare with the current state: enable, disable or keep.

    Rows without a score do not compete. The top rows come from a distributed
    top-k, never from a window over the whole frame.
    """
    target = (
        scored.filter("score > 0")
        .orderBy(F.desc("score"), F.lower("table_name"), F.lower("column_name"))
        .limit(slots)
        .select("table_name", "column_name", F.lit(True).alias("_target"))
    )
    current = scored.filter("enabled").select("table_name", "column_name", F.lit(True).alias("_current"))
    action = (
        F.when(F.col("_target") & F.col("_current"), "keep").when(F.col("_target"), "enable").otherwise("disable")
    )
    return target.join(current, ["table_name", "column_name"], "full").select("table_name", "column_name", action.alias("action"))


def column_mentions(log: DataFrame, statement: str = "statement_text", limit: int = 20) -> DataFrame:
    """The most mentioned column names: back-quoted, or qualified and followed by a separator."""
    quoted = F.regexp_extract_all(statement, F.lit(MENTION), F.lit(1))
    dotted = F.regexp_extract_all(statement, F.lit(MENTION), F.lit(2))
    both = F.zip_with(quoted, dotted, lambda q, d: F.when(q != "", q).otherwise(d))
    names = log.select(F.explode(both).alias("name"))
    return (
        names.filter((F.length("name") > 1) & ~F.upper("name").isin(SQL_WORDS))
        .groupBy("name")
        .agg(F.count("*").alias("mentions"))
        .orderBy(F.desc("mentions"), "name")
        .limit(limit)
    )
