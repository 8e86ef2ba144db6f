"""Evidence-ranking queries."""

import datetime as dt

from pyspark.sql import functions as F

from auditframe.operators import profile
from auditframe.operators import ranking as r
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()
AS_OF = dt.datetime(2024, 2, 5)
_AGE = "epoch(TIMESTAMP '2024-02-05 00:00:00' - start_time) / 86400"
_RECENCY = f"CASE WHEN {_AGE} <= 7 THEN 1.0 WHEN {_AGE} <= 14 THEN 0.5 WHEN {_AGE} <= 30 THEN 0.25 WHEN {_AGE} <= 90 THEN 0.1 END"
_HISTORY = f"""
  shape AS (SELECT table_name, column_name, shape_id, count(*) AS uses, bool_or(in_scope) AS scoped,
                   max({_RECENCY}) AS rec, max(start_time) AS last_used,
                   max(CASE sql_role WHEN 'join' THEN 6 WHEN 'filter' THEN 5 WHEN 'group' THEN 4 WHEN 'aggregate' THEN 4
                            WHEN 'order' THEN 2 ELSE 1 END) AS w
            FROM column_usage WHERE principal_kind = 'user' AND {_AGE} <= 90 GROUP BY ALL),
  hist AS (SELECT table_name, column_name,
                  sum(w * rec * least(3.0, 1 + ln(uses)) * CASE WHEN scoped THEN 2 ELSE 1 END)::DOUBLE AS score,
                  sum(uses)::BIGINT AS uses, count(*) AS shapes, count(*) FILTER (WHERE scoped) AS in_scope_shapes,
                  max(last_used) AS last_used_at
           FROM shape GROUP BY ALL)"""


def _history(i):
    return r.history_score(i.column_usage.filter("principal_kind = 'user'"), AS_OF)


@FAMILY.add(
    "cs_history_score",
    oracle(f"WITH {_HISTORY} SELECT * REPLACE (round(score, 6) AS score) FROM hist", "column_usage"),
)
def history_score(i):
    return _history(i).withColumn("score", F.round("score", 6))


@FAMILY.add(
    "cs_exclusion_counts",
    oracle(
        """SELECT excluded, count(*) AS n FROM (
             SELECT CASE WHEN executed_by IN ('u13', 'u26', 'u39') THEN 'service_principal'
                         WHEN execution_status = 'FAILED' THEN 'failed'
                         WHEN statement_text LIKE '%FROM t4%' THEN 'profiling_shape' END AS excluded FROM query_log)
           WHERE excluded IS NOT NULL GROUP BY 1""",
        "query_log",
    ),
)
def exclusion_counts(i):
    rules = [
        ("service_principal", F.col("executed_by").isin("u13", "u26", "u39")),
        ("failed", F.col("execution_status") == "FAILED"),
        ("profiling_shape", F.contains("statement_text", F.lit("FROM t4"))),
    ]
    return r.exclusion_counts(i.query_log, rules)


@FAMILY.add(
    "cs_relevant_log",
    oracle(
        """SELECT statement_id, coalesce(space_id = 's1', false) AS in_scope FROM query_log
           WHERE start_time >= TIMESTAMP '2024-01-06 00:00:00' AND execution_status = 'FINISHED'
             AND (space_id = 's1' OR regexp_matches(lower(statement_text), '\\b(t1|t3)\\b'))""",
        "query_log",
    ),
)
def relevant_log(i):
    return r.relevant_log(i.query_log, ["main.sales.t1", "main.sales.t3"], AS_OF, target_space="s1").select(
        "statement_id", "in_scope"
    )


@FAMILY.add(
    "cs_relevant_assets",
    oracle(
        """WITH a AS (SELECT list('t' || s_suppkey) AS leaves FROM supplier)
        SELECT statement_id, coalesce(space_id = 's1', false) AS in_scope FROM query_log, a
           WHERE start_time >= TIMESTAMP '2024-01-06 00:00:00' AND execution_status = 'FINISHED'
             AND (space_id = 's1' OR list_has_any(regexp_extract_all(lower(statement_text), '[a-z0-9_]+'), leaves))""",
        "query_log",
    ),
)
def relevant_assets(i):
    assets = i.supplier.select(F.concat(F.lit("main.Sales.t"), F.col("s_suppkey").cast("string")).alias("asset"))
    return r.relevant_log_of(i.query_log, assets, AS_OF, target_space="s1").select("statement_id", "in_scope")


@FAMILY.add(
    "cs_adaptive_lookback",
    oracle(
        """WITH a AS (SELECT space_id, statement_text, epoch(TIMESTAMP '2024-02-28 12:00:00' - start_time) / 86400 AS age
                      FROM query_log WHERE space_id IS NOT NULL),
        n AS (SELECT space_id, count(DISTINCT statement_text) FILTER (WHERE age <= 30) AS k FROM a GROUP BY 1)
        SELECT space_id, CASE WHEN k < 56 THEN 90 ELSE 30 END AS window_days, count(*) AS rows,
               count(DISTINCT statement_text) AS shapes
        FROM a JOIN n USING (space_id) WHERE age <= CASE WHEN k < 56 THEN 90 ELSE 30 END GROUP BY ALL""",
        "query_log",
    ),
)
def adaptive_lookback(i):
    log = i.query_log.filter("space_id IS NOT NULL")
    rows = r.adaptive_lookback(log, ["space_id"], "statement_text", dt.datetime(2024, 2, 28, 12), min_shapes=56)
    return rows.groupBy("space_id", "window_days").agg(
        F.count("*").alias("rows"), F.countDistinct("statement_text").alias("shapes")
    )


_WORDS = (
    "list_filter(regexp_extract_all(lower(replace(regexp_replace(coalesce({0}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')),"
    " '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in r.TOKEN_STOPWORDS) + "], w))"
)
_CONCEPTS = "[" + ", ".join(f"'{w}'" for w in r.CONCEPT_WORDS) + "]"


@FAMILY.add(
    "cs_semantic_score",
    types={"semantic_score": "DOUBLE"},
    oracle_sql=oracle(
        f"""WITH t AS (SELECT table_name, {_WORDS.format('body')} AS tw FROM table_texts),
        c AS (SELECT table_name, column_name, {_WORDS.format('column_name')} AS nw, {_WORDS.format('description')} AS dw
              FROM named_columns)
        SELECT table_name, column_name,
               CASE WHEN len(nw) > 0 AND contains(array_to_string(tw, ' '), array_to_string(nw, ' ')) THEN 8.0 ELSE 0.0 END
               + least(8.0, 2.0 * len(list_intersect(nw, tw))) + least(4.0, len(list_intersect(dw, tw)))
               + CASE WHEN list_has_any(nw, {_CONCEPTS}) THEN 2.0 ELSE 0.0 END AS semantic_score
        FROM c JOIN t USING (table_name)""",
        "named_columns", "table_texts",
    ),
)
def semantic_score(i):
    return r.semantic_score(i.named_columns, i.table_texts, "table_name").select("table_name", "column_name", "semantic_score")


@FAMILY.add(
    "cs_structural_score",
    types={"structural_score": "DOUBLE"},
    oracle_sql=oracle(
        """SELECT table_name, column_name, CASE WHEN is_key THEN 5.0 WHEN data_type = 'timestamp' THEN 4.0
                  WHEN data_type = 'string' THEN 2.0 ELSE 3.0 END AS structural_score FROM column_inventory""",
        "column_inventory",
    ),
)
def structural_score(i):
    return r.structural_score(i.column_inventory).select("table_name", "column_name", "structural_score")


def _merged(i):
    history = _history(i).select("table_name", "column_name", F.lit("QUERY_HISTORY").alias("reason"), F.round("score", 6).alias("score"))
    structure = r.structural_score(i.column_inventory).select(
        "table_name", "column_name", F.lit("STRUCTURAL_COVERAGE").alias("reason"), F.col("structural_score").alias("score")
    )
    return r.merged_evidence(i.local_evidence.unionByName(history).unionByName(structure))


_EVIDENCE = f"""{_HISTORY},
  src AS (SELECT table_name, column_name, reason, score FROM local_evidence
          UNION ALL SELECT table_name, column_name, 'QUERY_HISTORY', round(score, 6) FROM hist
          UNION ALL SELECT table_name, column_name, 'STRUCTURAL_COVERAGE',
                           CASE WHEN is_key THEN 5.0 WHEN data_type = 'timestamp' THEN 4.0 WHEN data_type = 'string' THEN 2.0
                                ELSE 3.0 END FROM column_inventory),
  pri AS (SELECT *, CASE reason WHEN 'BENCHMARK_SQL' THEN 1 WHEN 'CONFIG_SQL' THEN 2 WHEN 'JOIN_KEY' THEN 2
                         WHEN 'METRIC_FIELD' THEN 3 WHEN 'QUERY_HISTORY' THEN 3 WHEN 'COLUMN_BEHAVIOR' THEN 4
                         WHEN 'SEMANTIC_MATCH' THEN 4 ELSE 5 END AS p,
                 reason IN ('BENCHMARK_SQL', 'CONFIG_SQL', 'JOIN_KEY') AS hard FROM src WHERE score > 0),
  ev AS (SELECT table_name, column_name, string_agg(reason, ',' ORDER BY p, reason) AS reasons,
                coalesce(min(p) FILTER (WHERE hard), 3) AS priority, bool_or(hard) AS is_hard,
                coalesce(sum(score) FILTER (WHERE hard), 0) AS hard_score,
                coalesce(sum(score) FILTER (WHERE reason = 'QUERY_HISTORY'), 0) AS history_score,
                coalesce(sum(score) FILTER (WHERE reason = 'METRIC_FIELD'), 0) AS metric_score,
                coalesce(sum(score) FILTER (WHERE reason = 'COLUMN_BEHAVIOR'), 0) AS behavior_score,
                coalesce(sum(score) FILTER (WHERE reason = 'SEMANTIC_MATCH'), 0) AS semantic_score,
                coalesce(sum(score) FILTER (WHERE reason = 'STRUCTURAL_COVERAGE'), 0) AS structural_score,
                round(sum(score), 6) AS evidence_score
         FROM pri GROUP BY ALL)"""
_EV_VIEWS = ("column_usage", "column_inventory", "local_evidence")


@FAMILY.add("cs_merged_evidence", oracle(f"WITH {_EVIDENCE} SELECT * FROM ev", *_EV_VIEWS))
def merged_evidence(i):
    return _merged(i).withColumn("reasons", F.array_join("reasons", ",")).withColumn(
        "evidence_score", F.round("evidence_score", 6)
    )


def _ranked(i):
    hidden = i.column_inventory.select("table_name", "column_name", "hidden", "is_key", "data_type")
    return r.stable_rank(_merged(i)).join(hidden, ["table_name", "column_name"])


_RANK = f"""{_EVIDENCE},
  ranked AS (SELECT ev.*, i.hidden, i.is_key, i.data_type,
                    row_number() OVER (PARTITION BY table_name ORDER BY priority, hard_score DESC, history_score DESC,
                      metric_score DESC, behavior_score DESC, ev.semantic_score DESC, structural_score DESC, column_name) AS stable_rank
             FROM ev JOIN column_inventory i USING (table_name, column_name))"""


@FAMILY.add("cs_stable_rank", types={"stable_rank": "INTEGER"}, oracle_sql=oracle(f"WITH {_RANK} SELECT table_name, column_name, stable_rank FROM ranked", *_EV_VIEWS))
def stable_rank(i):
    return _ranked(i).select("table_name", "column_name", "stable_rank")


_CORE = 8
_SELECT = f"""{_RANK},
  req AS (SELECT *, is_hard AND NOT hidden AS required FROM ranked),
  sel AS (SELECT *, required OR (NOT hidden AND (SELECT count(*) FROM req b WHERE b.table_name = a.table_name AND b.required)
                                 + (SELECT count(*) FROM req b WHERE b.table_name = a.table_name AND NOT b.required
                                      AND NOT b.hidden AND b.stable_rank <= a.stable_rank) <= {_CORE}) AS selected
          FROM req a)"""


@FAMILY.add("cs_selection", oracle(f"WITH {_SELECT} SELECT table_name, column_name, selected FROM sel", *_EV_VIEWS))
def selection(i):
    return r.select_core(_ranked(i), core=_CORE).select("table_name", "column_name", "selected")


def _classed(i):
    core = r.select_core(_ranked(i), core=_CORE)
    return profile.structural_class(core).withColumn("column_id", F.concat_ws(".", "table_name", "column_name"))


_CLASS = f"""{_SELECT},
  cls AS (SELECT *, CASE WHEN is_key THEN 'identifier' WHEN data_type = 'timestamp' THEN 'date'
                         WHEN data_type = 'string' THEN 'categorical' ELSE 'numeric' END AS c,
                 table_name || '.' || column_name AS column_id FROM sel),
  pool AS (SELECT *, sha256('run7' || column_id) AS h,
                  NOT EXISTS (SELECT 1 FROM cls s WHERE s.table_name = x.table_name AND s.selected AND s.c = x.c) AS fresh
           FROM cls x WHERE NOT selected AND NOT hidden),
  ord AS (SELECT *, CASE WHEN fresh AND row_number() OVER (PARTITION BY table_name, c ORDER BY h) = 1
                         THEN CASE c WHEN 'identifier' THEN 0 WHEN 'date' THEN 1 WHEN 'numeric' THEN 2 WHEN 'categorical' THEN 3 END
                         ELSE 99 END AS lead FROM pool),
  explored AS (SELECT table_name, column_name FROM ord QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY lead, h) <= 2)"""


@FAMILY.add("cs_exploration", oracle(f"WITH {_CLASS} SELECT * FROM explored", *_EV_VIEWS))
def exploration(i):
    return r.explore(_classed(i), "run7", slots=2).filter("explored").select("table_name", "column_name")


@FAMILY.add(
    "cs_evict",
    types={"stable_rank": "INTEGER"},
    oracle_sql=oracle(
        f"""WITH {_CLASS},
        want AS (SELECT table_name, arg_max(column_id, stable_rank) AS wanted FROM cls WHERE NOT selected AND NOT hidden GROUP BY 1),
        full_ AS (SELECT table_name, count(*) FILTER (WHERE selected) >= {_CORE} AS is_full,
                         arg_max(column_id, stable_rank) FILTER (WHERE selected AND NOT contains(reasons, 'JOIN_KEY')
                                                                 AND stable_rank <> 1) AS victim FROM cls GROUP BY 1)
        SELECT cls.table_name, column_id, stable_rank,
               CASE WHEN wanted IS NULL THEN selected WHEN column_id = wanted AND (NOT is_full OR victim IS NOT NULL) THEN true
                    WHEN is_full AND column_id = victim THEN false ELSE selected END AS active,
               CASE WHEN wanted IS NOT NULL AND is_full AND column_id = victim THEN 'promoted:' || wanted END AS eviction_reason,
               CASE WHEN column_id = wanted AND (NOT is_full OR victim IS NOT NULL) THEN 'exploration' END AS activation_reason,
               CASE WHEN wanted IS NULL THEN 'unchanged' WHEN is_full AND victim IS NULL THEN 'full' ELSE 'activated' END AS status
        FROM cls LEFT JOIN want USING (table_name) JOIN full_ USING (table_name)""",
        *_EV_VIEWS,
    ),
)
def evict(i):
    rows = _classed(i)
    plan = rows.select(
        "table_name", "column_id", "stable_rank", F.col("selected").alias("active"),
        F.array_contains("reasons", "JOIN_KEY").alias("is_join_key"), (F.col("stable_rank") == 1).alias("protected"),
    )
    wanted = rows.filter("NOT selected AND NOT hidden").groupBy("table_name").agg(
        F.max_by("column_id", "stable_rank").alias("column_id")
    )
    return r.activate(plan, wanted.withColumn("reason", F.lit("EXPLORATION")), max_active=_CORE)


@FAMILY.add("cs_activate_in_order")
def activate_in_order(i):
    rows = _classed(i)
    plan = rows.select(
        "table_name", "column_id", "stable_rank", F.col("selected").alias("active"), "hidden",
        F.col("reasons").alias("reason_codes"), (F.col("stable_rank") == 1).alias("protected"),
    )
    asked = rows.filter("NOT selected").select(
        "table_name", "column_id", F.when(F.col("stable_rank") % 2 == 0, "REPAIR_FAILURE").alias("reason"), F.col("stable_rank").alias("place")
    )
    return r.activate_in_order(plan, asked, max_active=_CORE).withColumn("reason_codes", F.array_join("reason_codes", ","))


_SCORE = """
  f AS (SELECT *, lower(coalesce(description, '')) AS d FROM named_columns),
  s AS (SELECT table_name, column_name, data_type, enabled,
               CASE WHEN verdict = 'tainted' THEN 'rls_tainted' WHEN column_name = 'customer_email' THEN 'pii_name'
                    WHEN column_name = 'notes' THEN 'free_text_name' WHEN column_name = 'is_active' THEN 'boolean_flag'
                    WHEN contains(d, 'sensitive') THEN 'pii_description'
                    WHEN cardinality > 0 AND cardinality < 2 THEN 'cardinality_too_low'
                    WHEN cardinality > 1024 THEN 'cardinality_too_high'
                    WHEN cardinality > 0 AND cardinality / row_count > 0.8 THEN 'id_like_distinct_ratio' ELSE 'ok' END AS reason,
               CASE WHEN regexp_matches(column_name, 'status|category|region|code') THEN 3.0 ELSE 1.0 END
               + CASE WHEN cardinality BETWEEN 5 AND 200 THEN 2.0 WHEN cardinality BETWEEN 201 AND 1024 THEN 1.0
                      WHEN cardinality BETWEEN 2 AND 4 THEN 0.3 ELSE 0.0 END
               + CASE WHEN referenced THEN 3.0 ELSE 0.0 END + CASE WHEN contains(d, 'one of') THEN 1.0 ELSE 0.0 END
               - CASE WHEN contains(d, 'internal') THEN 2.0 ELSE 0.0 END AS raw FROM f),
  scored AS (SELECT *, CASE WHEN reason = 'ok' THEN greatest(0.0, least(10.0, raw))::DOUBLE ELSE 0.0 END AS score FROM s)"""


@FAMILY.add(
    "cs_entity_score",
    oracle(f"WITH {_SCORE} SELECT table_name, column_name, reason, round(score, 6) AS score FROM scored", "named_columns"),
)
def entity_score(i):
    return r.entity_score(i.named_columns).select("table_name", "column_name", "reason", F.round("score", 6).alias("score"))


@FAMILY.add(
    "cs_slot_diff",
    oracle(
        f"""WITH {_SCORE},
        t AS (SELECT table_name, column_name FROM scored WHERE score > 0 AND data_type = 'string'
              ORDER BY score DESC, table_name, column_name LIMIT 120),
        c AS (SELECT table_name, column_name FROM scored WHERE enabled AND data_type = 'string')
        SELECT coalesce(t.table_name, c.table_name) AS table_name, coalesce(t.column_name, c.column_name) AS column_name,
               CASE WHEN c.table_name IS NULL THEN 'enable' WHEN t.table_name IS NULL THEN 'disable' ELSE 'keep' END AS action
        FROM t FULL JOIN c ON t.table_name = c.table_name AND t.column_name = c.column_name""",
        "named_columns",
    ),
)
def slot_diff(i):
    return r.slot_diff(r.entity_score(i.named_columns.filter("data_type = 'string'")), 120)


@FAMILY.add(
    "cs_column_mentions",
    oracle(
        """SELECT name, count(*) AS mentions FROM (
             SELECT 'c' || CAST(event_id % 60 AS VARCHAR) AS name FROM events
             UNION ALL SELECT 'd' || CAST(user_id % 11 AS VARCHAR) FROM events
             UNION ALL SELECT 't' || CAST(event_id % 5 AS VARCHAR) FROM events
             UNION ALL SELECT 'flag' FROM events) GROUP BY 1 ORDER BY mentions DESC, name LIMIT 20""",
    ),
)
def column_mentions(i):
    return r.column_mentions(i.mention_log)
