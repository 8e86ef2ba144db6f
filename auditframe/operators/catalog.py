"""Catalog, lineage, governance and configuration analytics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.config import leaves_column, fingerprints_column, table_counts_column
from auditframe.operators.io import latest_wins
from auditframe.operators.quality import NOISE_NAME
from auditframe.operators.text import looks_like_sql

# Question terms, bands, descriptions that say nothing.
MEASURE_TERMS = [
    "revenue", "sales", "spend", "cost", "expense", "budget", "forecast", "amount",
    "quantity", "count", "growth", "margin", "profit", "loss", "earnings",
    "balance", "utilization", "consumption", "rate", "percentage", "pct",
]
ENTITY_TERMS = [
    "quarter", "month", "year", "region", "product", "customer", "vendor",
    "cost center", "department", "segment", "category", "division", "account",
]
PLACEHOLDERS = [
    "", "n/a", "na", "none", "null", "todo", "tbd", "unknown", "placeholder", "description",
]
VAGUE_TEXTS = [
    "id", "identifier", "key", "date", "string", "number", "integer", "field", "column", "timestamp",
    "a string", "an id", "id field", "date field", "string field", "number field",
]


# ---- inventory ----------------------------------------------------------------


def inventory(columns: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Columns with the attributes of their table; columns of unlisted tables stay."""
    return columns.join(tables, keys, "left")


def tags(table_tags: DataFrame, column_tags: DataFrame) -> DataFrame:
    """Table and column tags in one frame; table tags have no column."""
    return table_tags.unionByName(column_tags, allowMissingColumns=True)


def foreign_keys(key_columns: DataFrame, referenced: DataFrame) -> DataFrame:
    """Foreign keys with their column lists: child columns by position pair with parent columns by name."""
    def numbered(df: DataFrame, *order: str) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy("constraint_name").orderBy(*order)))

    child = numbered(key_columns, "ordinal_position", "column_name").select(
        "constraint_name", "rn", F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column")
    )
    parent = numbered(referenced, "column_name").select(
        "constraint_name", "rn", F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column")
    )
    pairs = child.join(parent, ["constraint_name", "rn"])
    listed = F.array_sort(F.collect_list(F.struct("rn", "child_column", "parent_column")))
    return pairs.groupBy("constraint_name", "child_table", "parent_table").agg(listed.alias("_p")).select(
        "constraint_name", "child_table", "parent_table",
        F.col("_p.child_column").alias("child_columns"), F.col("_p.parent_column").alias("parent_columns"),
    )


# ---- lineage ------------------------------------------------------------------


def _used(lineage: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    start = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days)
    return lineage.filter(F.col("event_time") >= F.lit(start)).filter("space_id IS NOT NULL AND source_table IS NOT NULL")


def resource_usage(lineage: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Per agent and table: uses and last use."""
    return (
        _used(lineage, as_of, days)
        .groupBy("space_id", F.col("source_table").alias("full_name"))
        .agg(F.count("*").alias("query_count"), F.max("event_time").alias("last_used"))
    )


def resource_rollup(lineage: DataFrame, as_of: dt.date, days: int = 30, limit: int = 50) -> DataFrame:
    """Tables by the number of agents that use them."""
    return (
        resource_usage(lineage, as_of, days)
        .groupBy("full_name")
        .agg(F.count("*").alias("space_count"), F.sum("query_count").alias("query_count_total"), F.max("last_used").alias("last_used"))
        .orderBy(F.desc("space_count"), F.desc("query_count_total"), "full_name")
        .limit(limit)
    )


def users_of_tables(lineage: DataFrame, as_of: dt.date, days: int = 30, full_name: str | None = None) -> DataFrame:
    """Distinct (table, agent) pairs, of one table when it is named."""
    rows = _used(lineage, as_of, days)
    if full_name is not None:
        rows = rows.filter(F.col("source_table") == full_name)
    return rows.select(F.col("source_table").alias("full_name"), "space_id").distinct()


def resource_graph(lineage: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Edges (agent, workspace, table) with uses, last use and the workspace that holds most of the agent's edges."""
    edges = (
        _used(lineage, as_of, days)
        .groupBy("space_id", "workspace_id", F.col("source_table").alias("full_name"))
        .agg(F.count("*").alias("query_count"), F.max("event_time").alias("last_used"))
    )
    counts = edges.filter("workspace_id IS NOT NULL").groupBy("space_id", "workspace_id").agg(F.count("*").alias("_n"))
    home = latest_wins(counts, ["space_id"], [F.desc("_n"), F.asc("workspace_id")])
    return edges.join(home.select("space_id", F.col("workspace_id").alias("home_workspace")), "space_id", "left")


def reconcile(configured: DataFrame, executed: DataFrame) -> DataFrame:
    """Configured against executed tables per agent: configured, executed or both."""
    c = configured.select("space_id", "full_name").distinct().withColumn("_c", F.lit(True))
    e = executed.select("space_id", "full_name", "query_count", "last_used").withColumn("_e", F.lit(True))
    source = F.when(F.col("_c") & F.col("_e"), "both").when(F.col("_c"), "configured").otherwise("executed")
    return c.join(e, ["space_id", "full_name"], "full").withColumn("source", source).drop("_c", "_e")


def neighbours(edges: DataFrame) -> DataFrame:
    """(table, direction, neighbour): distinct upstream and downstream tables, never the table itself."""
    e = edges.filter("source_table IS NOT NULL AND target_table IS NOT NULL AND source_table <> target_table").select(
        "source_table", "target_table"
    ).distinct()
    up = e.select(F.col("target_table").alias("table"), F.lit("upstream").alias("direction"), F.col("source_table").alias("neighbour"))
    down = e.select(F.col("source_table").alias("table"), F.lit("downstream").alias("direction"), F.col("target_table").alias("neighbour"))
    return up.unionByName(down)


def usage_profile(tables: list[str], edges: DataFrame, log: DataFrame, statement: str = "statement_text") -> DataFrame:
    """Per chosen table: upstream and downstream tables and finished statements that name it, in any case.

    The tables are a list that a user picked; all are counted in one read of the log.
    """
    near = neighbours(edges).filter(F.col("table").isin(tables)).groupBy("table").agg(
        F.count_if(F.col("direction") == "upstream").alias("upstream"),
        F.count_if(F.col("direction") == "downstream").alias("downstream"),
    )
    text = F.lower(statement)
    named = lambda t: F.contains(text, F.lit(t.lower())) | F.contains(text, F.lit(t.lower().split(".")[-1]))
    row = log.filter("execution_status = 'FINISHED'").agg(*[F.count_if(named(t)).alias(f"t{k}") for k, t in enumerate(tables)])
    cells = [F.struct(F.lit(t).alias("table"), F.col(f"t{k}").alias("queries")) for k, t in enumerate(tables)]
    counts = row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return counts.join(near, "table", "left").fillna(0, ["upstream", "downstream"]).withColumn(
        "has_lineage", F.col("upstream") + F.col("downstream") > 0
    )


# ---- governance and coverage ------------------------------------------------------


def governance_verdicts(assets: DataFrame, bases: DataFrame) -> DataFrame:
    """Per asset: clean, tainted or unknown, with the reason.

    An unreadable catalog is unknown. A row filter or column mask taints, on
    the asset itself or one level below a view, and so does an identity
    function in a view. An unreadable base makes a view unknown unless it is
    tainted. ``bases`` holds (asset, base) rows of views.
    """
    flags = assets.select(
        F.col("asset").alias("base"), F.col("readable").alias("_readable"),
        (F.col("has_row_filter") | F.col("has_column_mask")).alias("_governed"),
    )
    below = (
        bases.join(flags, "base", "left")
        .groupBy("asset")
        .agg(
            F.bool_or(F.coalesce(F.col("_readable") & F.col("_governed"), F.lit(False))).alias("_inherits"),
            F.bool_or(~F.coalesce("_readable", F.lit(True))).alias("_blind"),
        )
    )
    rows = assets.join(below, "asset", "left")
    view = F.col("is_view")
    reason = (
        F.when(~F.col("readable"), "unreadable")
        .when(F.col("has_row_filter"), "row_filter")
        .when(F.col("has_column_mask"), "column_mask")
        .when(view & F.col("is_dynamic"), "identity_function")
        .when(view & F.coalesce("_inherits", F.lit(False)), "inherited")
        .when(view & F.coalesce("_blind", F.lit(False)), "unreadable_base")
    )
    verdict = F.when(F.col("reason").isNull(), "clean").when(F.col("reason").isin("unreadable", "unreadable_base"), "unknown").otherwise("tainted")
    return rows.withColumn("reason", reason).select("asset", verdict.alias("verdict"), "reason")


def leaf(c: Column) -> Column:
    return F.lower(F.substring_index(F.trim(F.replace(c, F.lit("`"), F.lit(""))), ".", -1))


def uncovered_assets(assets: DataFrame, refs: DataFrame) -> DataFrame:
    """Assets that no benchmark refers to, by leaf name."""
    used = refs.select(leaf(F.col("table_ref")).alias("leaf")).distinct()
    return assets.select("kind", leaf(F.col("asset")).alias("leaf")).distinct().join(used, "leaf", "left_anti")


def uncovered_joins(specs: DataFrame, refs: DataFrame) -> DataFrame:
    """Configured join pairs that no benchmark uses: a benchmark joins its first table to each later one."""
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    first = refs.groupBy("benchmark_id").agg(F.min(F.struct("ordinal", "table_ref")).alias("_f"))
    rows = refs.join(first, "benchmark_id").filter(F.col("ordinal") > F.col("_f.ordinal"))
    used = rows.select(*pair(leaf(F.col("_f.table_ref")), leaf(F.col("table_ref")))).distinct()
    wanted = specs.select(*pair(leaf(F.col("left_table")), leaf(F.col("right_table")))).filter("a <> '' AND b <> ''").distinct()
    return wanted.join(used, ["a", "b"], "left_anti")


def schema_overlap(outputs: DataFrame, known: DataFrame) -> DataFrame:
    """Per function: output columns, those known under some table (the first by name), and their share."""
    source = known.groupBy(F.lower("column_name").alias("c")).agg(F.min("table_name").alias("source"))
    cols = outputs.select("function_name", F.lower("column_name").alias("c")).distinct()
    return cols.join(source, "c", "left").groupBy("function_name").agg(
        F.count("*").alias("columns"), F.count("source").alias("covered"),
        F.array_sort(F.collect_list(F.when(F.col("source").isNull(), F.col("c")))).alias("uncovered"),
        F.round(F.count("source") / F.count("*"), 4).alias("coverage_ratio"),
    ).withColumn("full_coverage", F.col("covered") == F.col("columns"))


def readiness(columns: DataFrame, questions: DataFrame, group: str = "grp") -> DataFrame:
    """Readiness of the tables of a group for its questions: four banded pillars and their mean.

    ``columns`` has a row per column with its schema, table, description, type
    and table comment. Terms are searched as text in names and descriptions.
    """
    texts = F.concat_ws(
        " ", F.lower("column_name"), F.lower("table_name"), F.lower("description"), F.lower("table_comment")
    )
    n_measures, n_entities = len(MEASURE_TERMS), len(ENTITY_TERMS)
    terms = MEASURE_TERMS + ENTITY_TERMS

    def seen(c: Column, p: str) -> list[Column]:
        return [F.bool_or(F.contains(c, F.lit(t))).alias(f"{p}{k}") for k, t in enumerate(terms)]

    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    per_table = columns.groupBy(group, "schema_name", "table_name").agg(
        F.count("*").alias("cols"),
        F.count_if(filled("description")).alias("doc_cols"),
        F.count_if(filled("data_type")).alias("typed"),
        F.bool_or(filled("table_comment")).alias("doc_table"),
        *seen(texts, "c"),
    )
    known = per_table.groupBy(group).agg(
        F.count("*").alias("tables"), F.countDistinct("schema_name").alias("schemas"),
        F.sum("cols").alias("cols"), F.sum("doc_cols").alias("doc_cols"), F.sum("typed").alias("typed"),
        F.count_if("doc_table").alias("doc_tables"),
        *[F.bool_or(f"c{k}").alias(f"c{k}") for k in range(len(terms))],
    )
    asked = questions.groupBy(group).agg(F.count("*").alias("n_questions"), *seen(F.lower("question"), "q"))
    rows = known.join(asked, group, "left")

    def total(span: range, hits: bool) -> Column:
        out = F.lit(0)
        for k in span:
            both = F.col(f"q{k}") & F.col(f"c{k}") if hits else F.col(f"q{k}")
            out = out + F.coalesce(both, F.lit(False)).cast("int")
        return out

    m, e = range(n_measures), range(n_measures, n_measures + n_entities)
    rows = rows.select(
        group, "tables", "schemas", "cols", "doc_cols", "typed", "doc_tables", F.coalesce("n_questions", F.lit(0)).alias("n_questions"),
        total(m, False).alias("exp_m"), total(e, False).alias("exp_e"), total(m, True).alias("hit_m"), total(e, True).alias("hit_e"),
    )
    asks = (F.col("n_questions") > 0) & ((F.col("exp_m") > 0) | (F.col("exp_e") > 0))
    semantic = (
        F.when(asks & (F.col("exp_m") > 0) & (F.col("hit_m") == 0), "Low")
        .when(asks & (F.col("exp_e") > 0) & (F.col("hit_e") == 0), "Low")
        .when(asks & (F.col("hit_m") >= F.col("exp_m") * 0.5) & (F.col("hit_e") >= F.col("exp_e") * 0.5), "High")
        .when(asks, "Medium")
        .when(F.col("tables") < 3, "Low")
        .otherwise("Medium")
    )
    typed_share = F.try_divide(F.col("typed") * 100.0, F.col("cols"))
    quality = F.when(F.coalesce(typed_share, F.lit(0.0)) > 90, "Medium").otherwise("Low")
    model = F.when((F.col("schemas") >= 2) & (F.col("tables") >= 5), "Medium").otherwise("Low")
    doc_c = F.coalesce(F.try_divide(F.col("doc_cols") * 100.0, F.col("cols")), F.lit(0.0))
    doc_t = F.coalesce(F.try_divide(F.col("doc_tables") * 100.0, F.col("tables")), F.lit(0.0))
    context = F.when((doc_c > 60) & (doc_t > 60), "High").when((doc_c > 20) | (doc_t > 20), "Medium").otherwise("Low")
    banded = rows.select(
        group, semantic.alias("semantic"), quality.alias("quality"), model.alias("modelability"), context.alias("context")
    )
    points = lambda c: F.when(F.col(c) == "High", 3).when(F.col(c) == "Medium", 2).otherwise(1)
    mean = (points("semantic") + points("quality") + points("modelability") + points("context")) / 4
    return banded.withColumn("mean_points", mean).withColumn(
        "overall", F.when(mean >= 2.5, "High").when(mean >= 1.5, "Medium").otherwise("Low")
    )


# ---- configuration documents ---------------------------------------------------------

_COLUMN = (
    "STRUCT<column_name: STRING, name: STRING, description: STRING, comment: STRING, exclude: BOOLEAN, visible: BOOLEAN,"
    " enable_entity_matching: BOOLEAN, enable_format_assistance: BOOLEAN, format_assistance_enabled: BOOLEAN>"
)
_TABLE = f"STRUCT<name: STRING, identifier: STRING, description: STRING, comment: STRING, columns: ARRAY<{_COLUMN}>, column_configs: ARRAY<{_COLUMN}>>"
CONFIG_SCHEMA = (
    f"description STRING, data_sources STRUCT<tables: ARRAY<{_TABLE}>, metric_views: ARRAY<{_TABLE}>>,"
    " instructions STRUCT<text_instructions: ARRAY<STRUCT<content: STRING>>, join_specs: ARRAY<STRUCT<id: STRING>>,"
    " example_question_sqls: ARRAY<STRUCT<usage_guidance: STRING>>, sql_functions: ARRAY<STRUCT<id: STRING>>,"
    " sql_snippets: STRUCT<expressions: ARRAY<STRUCT<id: STRING>>, measures: ARRAY<STRUCT<id: STRING>>, filters: ARRAY<STRUCT<id: STRING>>>>,"
    " benchmarks STRUCT<questions: ARRAY<STRUCT<id: STRING>>>"
)
CHECKS = [
    "Agent description", "Table descriptions", "Column descriptions", "Text instructions (>50 chars)",
    "Join specifications", "Data source count 1-12", "SQL guidance artifacts", "Entity/format matching",
    "10+ benchmark questions", "Column visibility / noise control",
    "Optimization workflow completed", "Optimization accuracy >= 85%",
]
CONFIG_CHECKS = 10


def _joined(c: Column, glue: str) -> Column:
    """A text that may be stored as a JSON list of fragments."""
    listed = F.array_join(F.from_json(c, "ARRAY<STRING>"), glue)
    return F.coalesce(F.when(c.startswith("["), listed), c, F.lit(""))


def _text(c: Column) -> Column:
    return F.trim(_joined(c, " "))


def meaningful(text: Column, min_chars: int = 8, min_words: int = 2) -> Column:
    """A trimmed text long enough, of enough words, that is neither a placeholder nor a bare type name."""
    normal = F.lower(F.regexp_replace(text, r"\s+", " "))
    words = F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+)"), F.lit(1)))
    return (F.length(text) >= min_chars) & (words >= min_words) & ~normal.isin(PLACEHOLDERS + VAGUE_TEXTS)


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later steps read them.

    A generator of one row stands between the steps, through which the
    optimiser does not repeat an expression at each place of its use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _count(c: str) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def _plain_texts(tables: Column) -> Column:
    """Tables whose described texts are no longer JSON lists of fragments; such lists are rare, and other tables stay as they are.

    A joined text ends in a blank, so that it is none of the empty ones.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    listed = lambda c: flag(c["description"].startswith("[")) | flag(c["comment"].startswith("["))
    found = F.exists(tables, lambda t: listed(t) | flag(F.exists(t["columns"], listed)) | flag(F.exists(t["column_configs"], listed)))

    def plain(c):
        text = F.coalesce(F.nullif(c["description"], F.lit("")), c["comment"])
        return c.withField("description", F.when(text.startswith("["), F.concat(_joined(text, " "), F.lit(" "))).otherwise(text))

    def table(t):
        parts = {p: F.transform(t[p], plain) for p in ("columns", "column_configs")}
        return plain(t).withField("columns", parts["columns"]).withField("column_configs", parts["column_configs"])

    return F.when(found, F.transform(tables, table)).otherwise(tables)


def scorecard(documents: DataFrame, document: str = "document", key: str = "doc_id", accuracy: str = "accuracy") -> DataFrame:
    """Twelve checks per configuration document: (key, check_no, check, passed, severity).

    ``accuracy`` is the score (0 to 1) of the agent's last optimisation run,
    NULL when there was none. The document is parsed once with a fixed schema;
    tables and columns are counted in Arrow batches, and every check is a
    column expression over counts.
    """
    some = lambda c, kind: F.coalesce(c, F.array().cast(f"ARRAY<{kind}>"))
    d = _with(documents.select(key, F.col(accuracy).alias("_acc"), document), d=F.from_json(document, CONFIG_SCHEMA))
    guides = some(F.col("d.instructions.example_question_sqls"), "STRUCT<usage_guidance: STRING>")
    d = d.select(
        key, "_acc",
        some(F.col("d.data_sources.tables"), _TABLE).alias("tables"),
        some(F.col("d.data_sources.metric_views"), _TABLE).alias("views"),
        _text(F.col("d.description")).alias("about"),
        F.aggregate(
            some(F.col("d.instructions.text_instructions"), "STRUCT<content: STRING>"), F.lit(""), lambda acc, t: F.concat(acc, _joined(t["content"], ""))
        ).alias("body"),
        _count("d.instructions.text_instructions").alias("n_texts"),
        _count("d.instructions.join_specs").alias("joins"),
        _count("d.instructions.example_question_sqls").alias("examples"),
        F.size(F.filter(guides, lambda x: F.coalesce(x["usage_guidance"], F.lit("")) == "")).alias("unguided"),
        _count("d.instructions.sql_functions").alias("functions"),
        _count("d.instructions.sql_snippets.expressions").alias("expressions"),
        _count("d.instructions.sql_snippets.measures").alias("measures"),
        _count("d.instructions.sql_snippets.filters").alias("filters"),
        _count("d.benchmarks.questions").alias("benchmarks"),
    )
    counts = table_counts_column(_plain_texts(F.col("tables")), F.col("views"), PLACEHOLDERS + VAGUE_TEXTS, NOISE_NAME)
    d = d.select("*", F.size("tables").alias("n_tables"), F.size("views").alias("n_views"), counts.alias("_n")).drop("tables", "views")
    facts = _with(d.select("*", "_n.*"), described=meaningful(F.col("about"), 30, 5), desc_len=F.length("about"))
    c = F.col
    sources = c("n_tables") + c("n_views")
    no_tables = F.when(c("n_views") > 0, "pass").otherwise("fail")
    noise = F.coalesce(F.try_divide(c("noisy"), c("n_cols")), F.lit(0.0))
    sql_lines = F.exists(F.split("body", r"\r\n|\n|\r"), looks_like_sql)
    graded = lambda ok, warn: F.when(~ok, "fail").when(warn, "warning").otherwise("pass")
    snippets = c("functions") + c("expressions") + c("measures") + c("filters")
    ran = c("_acc").isNotNull()
    table_share, column_share = c("told_tables") / c("n_tables"), F.coalesce(F.try_divide(c("told_cols"), c("n_cols")), F.lit(0.0))
    severities = [
        graded(c("described"), c("desc_len") < 100),
        F.when(c("n_tables") > 0, graded(table_share >= 0.80, table_share < 1.0)).otherwise(no_tables),
        F.when(c("n_tables") > 0, graded(column_share >= 0.50, column_share < 0.80)).otherwise(no_tables),
        graded((c("n_texts") > 0) & (F.length("body") > 50), (F.length("body") > 2000) | sql_lines),
        graded(
            (sources > 0) & ((c("n_tables") <= 1) | (c("joins") > 0)),
            (c("n_tables") > 1) & (c("joins") < c("n_tables") - 1),
        ),
        graded(sources.between(1, 12), sources >= 9),
        graded(
            snippets + c("examples") > 0,
            ((snippets > 0) & ((c("filters") == 0) | (c("measures") == 0))) | (c("unguided") > c("examples") / 2),
        ),
        graded((c("matched") > 0) | (c("assisted") > 0), c("matched") > 100),
        graded(c("benchmarks") >= 10, c("benchmarks") < 20),
        graded(
            (sources > 0) & ~((c("n_cols") >= 20) & (noise >= 0.30)),
            ((c("n_cols") >= 20) & (noise >= 0.15)) | (c("widest") > 75),
        ),
        graded(ran, F.lit(False)),
        graded(ran & (c("_acc") >= 0.85), F.lit(False)),
    ]
    cells = [F.struct(F.lit(k + 1).alias("check_no"), F.lit(n).alias("check"), s.alias("severity")) for k, (n, s) in enumerate(zip(CHECKS, severities))]
    return (
        facts.select(key, F.explode(F.array(*cells)).alias("_c"))
        .select(key, "_c.*")
        .withColumn("passed", F.col("severity") != "fail")
    )


def maturity(card: DataFrame, key: str = "doc_id") -> DataFrame:
    """Score and maturity per document from its checks."""
    return card.groupBy(key).agg(
        F.count_if("passed").alias("score"),
        F.bool_and("passed").alias("_all"),
        F.bool_and(F.col("passed") | (F.col("check_no") > CONFIG_CHECKS)).alias("_config"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    ).select(
        key, "score", "warnings",
        F.when(F.col("_all"), "Trusted").when(F.col("_config"), "Ready to Optimize").otherwise("Not Ready").alias("maturity"),
    )


def fingerprints(documents: DataFrame, document: str = "document") -> DataFrame:
    """Add ``config_fp`` and ``benchmark_fp`` of a JSON document."""
    return documents.withColumn("_fp", fingerprints_column(F.col(document))).select("*", "_fp.*").drop("_fp")


def config_drift(stored: DataFrame, live: DataFrame, key: str = "doc_id", document: str = "document") -> DataFrame:
    """Per document: does the live configuration or its benchmark block differ from the stored one?

    NULL when a side is missing or cannot be read: unreadable is not drift.
    Documents become digests of their leaves where they are; only those meet.
    """
    a, b = (df.select(key, leaves_column(F.col(document)).alias(n)) for df, n in ((stored, "_a"), (live, "_b")))
    differs = lambda part: (F.col(f"_a.{part}") != F.col(f"_b.{part}")).alias(f"{part}_drifted")
    return a.join(b, key, "full").select(key, differs("config"), differs("benchmarks"))


def asset_fingerprint(assets: DataFrame, key: str, name: str = "asset") -> DataFrame:
    """A 16-digit hash of the sorted distinct asset names per key.

    The hashed text is a JSON list with ``", "`` between names, names in ASCII.
    """
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.col(name), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    names = assets.filter(F.col(name) != "").select(key, F.col(name), quoted.alias("q")).distinct()
    listed = names.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(name, "q"))).alias("n"))
    text = F.concat(F.lit("["), F.array_join("n.q", ", "), F.lit("]"))
    return listed.select(key, F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("fingerprint"))


def version_match(runs: DataFrame, champions: DataFrame, live: DataFrame) -> DataFrame:
    """Which known version is each live document: matched, mixed, drifted, or not decidable?

    ``runs`` (space_id, run_id, started_at, config_fp, benchmark_fp,
    best_iteration) give baselines, ``champions`` the observed and submitted
    fingerprints of the selected iteration. A missing capture leaves history
    incomplete: it forbids ``drifted``, never ``matched``. The newest matching
    run is ``current``.
    """
    base = runs.select("space_id", "run_id", "started_at", F.lit("baseline").alias("target"), "config_fp", "benchmark_fp",
                       F.col("config_fp").isNull().alias("_no_c"), F.col("benchmark_fp").isNull().alias("_no_b"))
    won = runs.select("space_id", "run_id", "started_at", "best_iteration").join(champions.withColumn("_has", F.lit(True)), "run_id", "left")
    lost = F.col("best_iteration").isNotNull() & F.col("_has").isNull()
    champ = won.filter(F.col("_has") | lost).select(
        "space_id", "run_id", "started_at", F.lit("champion").alias("target"),
        F.coalesce("observed_config_fp", "submitted_config_fp").alias("config_fp"),
        F.coalesce("observed_benchmark_fp", "submitted_benchmark_fp").alias("benchmark_fp"),
        (lost | F.col("observed_config_fp").isNull()).alias("_no_c"),
        (lost | F.col("observed_benchmark_fp").isNull()).alias("_no_b"),
    )
    now = live.select("space_id", F.col("config_fp").alias("live_c"), F.col("benchmark_fp").alias("live_b"))
    versions = base.unionByName(champ).join(now, "space_id", "right")
    is_c = F.coalesce(F.col("config_fp") == F.col("live_c"), F.lit(False))
    is_b = F.coalesce(F.col("benchmark_fp") == F.col("live_b"), F.lit(False))
    key = F.struct("started_at", "run_id", "target")
    per = versions.groupBy("space_id").agg(
        F.max(F.when(is_c & is_b, key)).alias("_full"), F.bool_or(is_c).alias("_c"), F.bool_or(is_b).alias("_b"),
        F.bool_or(F.coalesce("_no_c", F.lit(False))).alias("_open_c"), F.bool_or(F.coalesce("_no_b", F.lit(False))).alias("_open_b"),
        F.bool_or(F.col("config_fp").isNotNull() | F.col("benchmark_fp").isNotNull()).alias("_known"),
        F.bool_or(F.col("live_c").isNull() | F.col("live_b").isNull()).alias("_offline"),
    )
    status = (
        F.when(~F.col("_known"), F.when(F.col("_open_c") | F.col("_open_b"), "history_incomplete").otherwise("no_known_versions"))
        .when(F.col("_offline"), "unavailable")
        .when(F.col("_full").isNotNull(), "matched")
        .when(F.col("_c") & F.col("_b"), "mixed")
        .when((~F.col("_c") & F.col("_open_c")) | (~F.col("_b") & F.col("_open_b")), "history_incomplete")
        .otherwise("drifted")
    )
    rows = per.withColumn("status", status)
    drifted = F.when(
        F.col("status") == "drifted",
        F.array_join(F.array_compact(F.array(F.when(~F.col("_c"), F.lit("config")), F.when(~F.col("_b"), F.lit("benchmarks")))), ","),
    )
    matched = F.col("status") == "matched"
    return rows.select(
        "space_id", "status", F.when(matched, F.col("_full.run_id")).alias("run_id"),
        F.when(matched, F.col("_full.target")).alias("target"), drifted.alias("drifted_dimensions"),
    )
