"""Catalog, lineage, governance and configuration queries."""

import datetime as dt
import json

from pyspark.sql import functions as F

from auditframe.operators import catalog as c
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()
AS_OF, DAYS = dt.date(2002, 1, 1), 3650


@FAMILY.add(
    "ct_inventory",
    oracle(
        """SELECT n.table_name, n.column_name, n.data_type, t.table_type, t.table_comment
           FROM named_columns n LEFT JOIN table_list t USING (table_name)""",
        "named_columns", "table_list",
    ),
)
def inventory(i):
    df = c.inventory(i.named_columns, i.table_list, ["table_name"])
    return df.select("table_name", "column_name", "data_type", "table_type", "table_comment")


@FAMILY.add(
    "ct_tags",
    oracle(
        """SELECT table_name, NULL AS column_name, tag_name, tag_value FROM table_tags
           UNION ALL SELECT table_name, column_name, tag_name, tag_value FROM column_tags""",
        "table_tags", "column_tags",
    ),
)
def tags(i):
    return c.tags(i.table_tags, i.column_tags)


@FAMILY.add(
    "ct_foreign_keys",
    oracle(
        """WITH a AS (SELECT *, row_number() OVER (PARTITION BY constraint_name ORDER BY ordinal_position, column_name) AS rn FROM key_columns),
        b AS (SELECT *, row_number() OVER (PARTITION BY constraint_name ORDER BY column_name) AS rn FROM referenced_columns)
        SELECT a.constraint_name, a.table_name AS child_table, b.table_name AS parent_table,
               string_agg(a.column_name, ',' ORDER BY a.rn) AS child_columns, string_agg(b.column_name, ',' ORDER BY a.rn) AS parent_columns
        FROM a JOIN b ON a.constraint_name = b.constraint_name AND a.rn = b.rn GROUP BY ALL""",
        "key_columns", "referenced_columns",
    ),
)
def foreign_keys(i):
    df = c.foreign_keys(i.key_columns, i.referenced_columns)
    return df.withColumns({n: F.array_join(n, ",") for n in ("child_columns", "parent_columns")})


@FAMILY.add(
    "ct_resources",
    oracle(
        """SELECT space_id, source_table AS full_name, count(*) AS query_count, max(event_time) AS last_used
           FROM lineage WHERE event_time >= TIMESTAMP '1992-01-04' GROUP BY ALL""",
        "lineage",
    ),
)
def resources(i):
    return c.resource_usage(i.lineage, AS_OF, DAYS)


@FAMILY.add(
    "ct_resource_rollup",
    oracle(
        """SELECT source_table AS full_name, count(DISTINCT space_id) AS space_count, count(*) AS query_count_total,
                  max(event_time) AS last_used FROM lineage
           GROUP BY 1 ORDER BY space_count DESC, query_count_total DESC, full_name LIMIT 20""",
        "lineage",
    ),
)
def resource_rollup(i):
    return c.resource_rollup(i.lineage, AS_OF, DAYS, 20)


@FAMILY.add("ct_users_of_table", oracle("SELECT DISTINCT source_table AS full_name, space_id FROM lineage", "lineage"))
def users_of_table(i):
    return c.users_of_tables(i.lineage, AS_OF, DAYS)


@FAMILY.add(
    "ct_graph",
    oracle(
        """WITH e AS (SELECT space_id, workspace_id, source_table AS full_name, count(*) AS query_count, max(event_time) AS last_used
                      FROM lineage GROUP BY ALL),
        n AS (SELECT space_id, workspace_id AS home_workspace, count(*) AS k FROM e GROUP BY ALL),
        h AS (SELECT space_id, home_workspace FROM n
              QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY k DESC, home_workspace) = 1)
        SELECT e.*, home_workspace FROM e JOIN h USING (space_id)""",
        "lineage",
    ),
)
def graph(i):
    return c.resource_graph(i.lineage, AS_OF, DAYS)


@FAMILY.add(
    "ct_reconcile",
    oracle(
        """WITH e AS (SELECT space_id, source_table AS full_name, count(*) AS query_count, max(event_time) AS last_used
                      FROM lineage GROUP BY ALL)
        SELECT coalesce(c.space_id, e.space_id) AS space_id, coalesce(c.full_name, e.full_name) AS full_name, query_count, last_used,
               CASE WHEN e.space_id IS NULL THEN 'configured' WHEN c.space_id IS NULL THEN 'executed' ELSE 'both' END AS source
        FROM configured_tables c FULL JOIN e ON c.space_id = e.space_id AND c.full_name = e.full_name""",
        "lineage", "configured_tables",
    ),
)
def reconcile(i):
    return c.reconcile(i.configured_tables, c.resource_usage(i.lineage, AS_OF, DAYS))


@FAMILY.add(
    "ct_neighbours",
    oracle(
        """SELECT DISTINCT target_table AS "table", 'upstream' AS direction, source_table AS neighbour FROM edges
           WHERE source_table <> target_table
           UNION ALL SELECT DISTINCT source_table, 'downstream', target_table FROM edges WHERE source_table <> target_table""",
        "edges",
    ),
)
def neighbours(i):
    return c.neighbours(i.edges)


@FAMILY.add(
    "ct_usage_profile",
    oracle(
        """WITH t AS (SELECT unnest(['t1', 't3', 'n5', 'zz']) AS "table"),
        ren AS (SELECT replace(source_table, 'n1', 't1') AS s, replace(target_table, 'n1', 't1') AS g FROM edges)
        SELECT "table", (SELECT count(*) FROM query_log WHERE execution_status = 'FINISHED'
                           AND contains(lower(statement_text), "table")) AS queries,
               (SELECT count(DISTINCT s) FROM ren WHERE g = "table" AND s <> g) AS upstream,
               (SELECT count(DISTINCT g) FROM ren WHERE s = "table" AND s <> g) AS downstream,
               EXISTS (SELECT 1 FROM ren WHERE s <> g AND (s = "table" OR g = "table")) AS has_lineage FROM t""",
        "edges", "query_log",
    ),
)
def usage_profile(i):
    named = i.edges.withColumns({x: F.replace(x, F.lit("n1"), F.lit("t1")) for x in ("source_table", "target_table")})
    return c.usage_profile(["t1", "t3", "n5", "zz"], named, i.query_log)


@FAMILY.add(
    "ct_rls_verdict",
    oracle(
        """WITH b AS (SELECT v.asset, bool_or(g.readable AND (g.has_row_filter OR g.has_column_mask)) AS inh, bool_or(NOT g.readable) AS blind
                      FROM view_bases v LEFT JOIN governed_assets g ON g.asset = v.base GROUP BY 1),
        r AS (SELECT a.asset, CASE WHEN NOT readable THEN 'unreadable' WHEN has_row_filter THEN 'row_filter'
                     WHEN has_column_mask THEN 'column_mask' WHEN is_view AND is_dynamic THEN 'identity_function'
                     WHEN is_view AND inh THEN 'inherited' WHEN is_view AND blind THEN 'unreadable_base' END AS reason
              FROM governed_assets a LEFT JOIN b USING (asset))
        SELECT asset, CASE WHEN reason IS NULL THEN 'clean' WHEN reason LIKE 'unreadable%' THEN 'unknown' ELSE 'tainted' END AS verdict, reason
        FROM r""",
        "governed_assets", "view_bases",
    ),
)
def rls_verdict(i):
    return c.governance_verdicts(i.governed_assets, i.view_bases)


@FAMILY.add(
    "ct_uncovered",
    oracle(
        """SELECT kind, replace(asset, 'main.sales.', '') AS leaf FROM known_assets
           WHERE lower(asset) NOT IN (SELECT lower(table_ref) FROM benchmark_refs)""",
        "known_assets", "benchmark_refs",
    ),
)
def uncovered(i):
    return c.uncovered_assets(i.known_assets, i.benchmark_refs)


@FAMILY.add(
    "ct_uncovered_joins",
    oracle(
        """WITH f AS (SELECT benchmark_id, lower(split_part(table_ref, '.', 3)) AS t,
                          row_number() OVER (PARTITION BY benchmark_id ORDER BY ordinal, table_ref) AS k, ordinal FROM benchmark_refs),
        used AS (SELECT least(a.t, b.t) AS a, greatest(a.t, b.t) AS b FROM f a JOIN f b USING (benchmark_id)
                 WHERE a.k = 1 AND b.ordinal > a.ordinal)
        SELECT DISTINCT least(lower(left_table), lower(right_table)) AS a, greatest(lower(left_table), lower(right_table)) AS b
        FROM join_specs s WHERE NOT EXISTS (SELECT 1 FROM used u
          WHERE u.a = least(lower(left_table), lower(right_table)) AND u.b = greatest(lower(left_table), lower(right_table)))""",
        "benchmark_refs", "join_specs",
    ),
)
def uncovered_joins(i):
    return c.uncovered_joins(i.join_specs, i.benchmark_refs)


@FAMILY.add(
    "ct_schema_overlap",
    oracle(
        """WITH k AS (SELECT DISTINCT lower(column_name) AS col FROM named_columns),
        o AS (SELECT DISTINCT function_name, lower(column_name) AS col FROM function_columns)
        SELECT function_name, count(*) AS columns, count(k.col) AS covered,
               coalesce(string_agg(o.col, ',' ORDER BY o.col) FILTER (WHERE k.col IS NULL), '') AS uncovered,
               round(count(k.col) / count(*), 4) AS coverage_ratio, count(k.col) = count(*) AS full_coverage
        FROM o LEFT JOIN k USING (col) GROUP BY 1""",
        "named_columns", "function_columns",
    ),
)
def schema_overlap(i):
    return c.schema_overlap(i.function_columns, i.named_columns).withColumn("uncovered", F.array_join("uncovered", ","))


# ---- readiness ---------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@FAMILY.add(
    "ct_readiness",
    oracle(
        f"""WITH corpus AS (SELECT grp, string_agg(concat_ws(' ', lower(column_name), lower(table_name), lower(description),
                                                            lower(table_comment)), ' | ') AS t FROM readiness_columns GROUP BY 1),
        asked AS (SELECT grp, string_agg(lower(question), ' | ') AS q FROM readiness_questions GROUP BY 1),
        m AS (SELECT unnest({_list(c.MEASURE_TERMS)}) AS w), e AS (SELECT unnest({_list(c.ENTITY_TERMS)}) AS w),
        x AS (SELECT corpus.grp, q,
                (SELECT count(*) FROM m WHERE contains(q, w)) AS em, (SELECT count(*) FROM e WHERE contains(q, w)) AS ee,
                (SELECT count(*) FROM m WHERE contains(q, w) AND contains(t, w)) AS hm,
                (SELECT count(*) FROM e WHERE contains(q, w) AND contains(t, w)) AS he
              FROM corpus LEFT JOIN asked USING (grp)),
        tabs AS (SELECT grp, schema_name, table_name, bool_or(table_comment IS NOT NULL) AS told FROM readiness_columns GROUP BY ALL),
        n AS (SELECT grp, count(*) AS tables, count(DISTINCT schema_name) AS schemas, 100.0 * count(*) FILTER (WHERE told) / count(*) AS tp
              FROM tabs GROUP BY 1),
        k AS (SELECT grp, 100.0 * count(description) / count(*) AS cp, 100.0 * count(data_type) / count(*) AS yp FROM readiness_columns GROUP BY 1),
        b AS (SELECT grp,
                CASE WHEN q IS NOT NULL AND (em > 0 OR ee > 0) THEN
                       CASE WHEN em > 0 AND hm = 0 THEN 'Low' WHEN ee > 0 AND he = 0 THEN 'Low'
                            WHEN hm >= em * 0.5 AND he >= ee * 0.5 THEN 'High' ELSE 'Medium' END
                     WHEN tables < 3 THEN 'Low' ELSE 'Medium' END AS semantic,
                CASE WHEN yp > 90 THEN 'Medium' ELSE 'Low' END AS quality,
                CASE WHEN schemas >= 2 AND tables >= 5 THEN 'Medium' ELSE 'Low' END AS modelability,
                CASE WHEN cp > 60 AND tp > 60 THEN 'High' WHEN cp > 20 OR tp > 20 THEN 'Medium' ELSE 'Low' END AS context
              FROM x JOIN n USING (grp) JOIN k USING (grp)),
        s AS (SELECT *, (list_sum(list_transform([semantic, quality, modelability, context],
                          lambda v: CASE v WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END)) / 4)::DOUBLE AS mean_points FROM b)
        SELECT *, CASE WHEN mean_points >= 2.5 THEN 'High' WHEN mean_points >= 1.5 THEN 'Medium' ELSE 'Low' END AS overall FROM s""",
        "readiness_columns", "readiness_questions",
    ),
)
def readiness(i):
    return c.readiness(i.readiness_columns, i.readiness_questions)


# ---- configuration documents: one per order, one table per line --------------------------

_ABOUT = "Orders and revenue by region for the sales team"
_MORE = ", with returns, discounts and shipping dates for every customer segment we serve"
_RULES = ["", "Short", "Always report revenue in dollars and ignore cancelled orders.",
          "Use net revenue for every question about money here.\nSELECT sum(x) FROM sales", "Report revenue net of returns. "]


def _tables(rows, live: bool):
    """doc_id -> array of the JSON texts of tables; the live form lists them backwards with other key orders."""
    # Lines are gathered as they are and become tables afterwards: the shuffle and its sort hold no texts.
    raw = ["l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    gathered = rows.groupBy("doc_id", "o_custkey", "o_orderstatus", "o_orderpriority").agg(F.collect_list(F.struct(*raw)).alias("_l"))
    items = F.sort_array(F.transform("_l", lambda line: _table_item(line, live)), asc=not live)
    return gathered.withColumn("tables", F.transform(items, lambda item: _table_text(item, live)))


def _table_item(line, live: bool):
    """A line with what its table says, in the order in which tables are listed."""
    part = line["l_partkey"].cast("string")
    traits = [line[x].cast("string") for x in ("l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")]
    told = F.when(line["l_returnflag"] == "N", F.concat(F.lit('"Sales of part '), part, F.lit(' by day"'))).when(
        line["l_returnflag"] == "A", F.lit('"table"')
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    said = [
        F.concat_ws("_", F.lit("tbl"), part, *traits).alias("name"), told.alias("told"), (~flag(line["l_linestatus"] == "O")).alias("bare"),
        flag(line["l_discount"] >= 0.05).alias("exclude"), flag(line["l_quantity"] > 48).alias("match"),
    ]
    return F.struct(line["l_linenumber"].alias("n"), line["l_partkey"].alias("part"), *([*said[2:], *reversed(said[:2])] if live else said))


def _table_text(item, live: bool):
    def column(n, text=None, exclude=False, enable_entity_matching=False):
        fields = {"column_name": n} | ({} if text is None else {"description": text})
        fields |= {"exclude": exclude, "enable_entity_matching": enable_entity_matching}
        return json.dumps(dict(reversed(fields.items())) if live else fields, separators=(",", ":"))

    either = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    columns = [
        F.lit('"columns":['),
        either(item["bare"], column("order_total", "number"), column("order_total", "Total value of the order")),
        F.lit(f",{column('etl_batch')},"),
        either(item["exclude"], column("load_key", exclude=True), column("load_key")),
        F.lit(","),
        either(item["match"], column("region", "Sales region name", enable_entity_matching=True), column("region", "Sales region name")),
        F.lit(f",{column('Status')}]"),
    ]
    status = either(item["n"] == 1, column("status", "Status of the shipped line"), column("status"))
    configs = [F.lit('"column_configs":['), status, F.lit("]")]
    told = F.coalesce(F.concat(F.lit('"description":'), item["told"], F.lit(",")), F.lit(""))
    names = [item["name"].alias("id"), item["name"].alias("name")]
    if live:
        return F.concat(F.lit("{"), *configs, F.lit(","), *columns, F.lit(","), told, F.substring(F.to_json(F.struct(*reversed(names))), 2, 2**31 - 1))
    return F.concat(F.rtrim(F.to_json(F.struct(*names)), F.lit("}")), F.lit(","), told, *columns, F.lit(","), *configs, F.lit("}"))


def _documents(i, live: bool = False):
    """JSON configuration documents; the live form says the same in another shape, with edits in some."""
    d = _tables(i.config_base, live)
    k = F.col("doc_id")
    quote = F.lit("'" if live else "")
    about = F.when(k % 4 == 1, F.lit("TBD")).when(k % 4 == 2, F.concat(quote, F.lit(_ABOUT), quote)).when(k % 4 == 3, F.lit(_ABOUT + _MORE))
    if live:
        about = F.when(k % 10 == 0, F.lit("Edited by hand")).otherwise(about)
    rule = F.when(k % 5 == 4, F.repeat(F.lit(_RULES[4]), F.lit(80)))
    for r in (1, 2, 3):
        rule = rule.when(k % 5 == r, F.lit(_RULES[r]))
    content = F.array(F.substring(rule, 1, 9), F.substring(rule, F.lit(10), F.length(rule))) if live else F.array(rule)
    texts = F.when(k % 5 == 0, F.array().cast("ARRAY<STRUCT<content: ARRAY<STRING>>>")).otherwise(F.array(F.struct(content.alias("content"))))

    def items(n, make):
        return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("ARRAY<INT>")), make)

    by_id = lambda prefix: lambda x: F.struct(F.concat(F.lit(prefix), x.cast("string")).alias("id"))
    joins = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", F.size("tables") - 1).otherwise(1)
    examples = F.when(k % 3 == 1, 1).when(k % 3 == 2, 3).otherwise(0)
    guided = lambda x: F.struct(F.concat(F.lit("e"), x.cast("string")).alias("id"), F.when(x == 1, F.lit("Use for totals")).alias("usage_guidance"))
    asked = (F.col("o_custkey") % 25).cast("int")
    if live:
        asked = F.when(k % 15 == 0, asked + 1).otherwise(asked)
    question = lambda x: F.concat(F.lit('{"id":"q'), F.lpad(x.cast("string"), 3, "0"), F.lit('","question":["How much?"]}'))
    one = lambda cond: items(F.when(cond, 1).otherwise(0), by_id("s"))
    snippets = F.struct(one(F.col("o_orderstatus") == "O").alias("measures"), one(F.col("o_orderstatus") == "F").alias("filters"))
    instructions = [
        texts.alias("text_instructions"), items(joins, by_id("j")).alias("join_specs"),
        items(examples, guided).alias("example_question_sqls"), snippets.alias("sql_snippets"),
    ]
    listed = lambda texts: F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    instructions = F.to_json(F.struct(*(reversed(instructions) if live else instructions)))
    top = [
        F.concat(F.lit('"description":"'), about, F.lit('"')), F.concat(F.lit('"data_sources":{"tables":'), listed("tables"), F.lit("}")),
        F.concat(F.lit('"instructions":'), instructions), F.concat(F.lit('"benchmarks":{"questions":'), listed(items(asked, question)), F.lit("}")),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *(reversed(top) if live else top)), F.lit("}"))
    accuracy = F.when(k % 3 != 0, (k % 21) / 20.0)
    return d.select("doc_id", text.alias("document"), accuracy.alias("accuracy"))


def _grade(ok: str, warn: str = "false") -> str:
    return f"CASE WHEN NOT ({ok}) THEN 'fail' WHEN {warn} THEN 'warning' ELSE 'pass' END"


_CARD = f"""
  f AS (SELECT doc_id, o_custkey % 25 AS nb, o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n,
               count(*) FILTER (WHERE l_returnflag = 'N') AS told, sum(CASE WHEN l_discount >= 0.05 THEN 4 ELSE 5 END) AS cols,
               sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + 1 + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS told_cols,
               sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 2 END) AS noisy, count(*) FILTER (WHERE l_quantity > 48) AS em
        FROM config_base GROUP BY ALL),
  g AS (SELECT *, CASE pr WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN n - 1 ELSE 1 END AS joins,
               CASE doc_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS ex,
               CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 21) / 20.0 END AS acc FROM f),
  card AS (
    SELECT doc_id, unnest(range(1, 13)) AS check_no, unnest({_list(c.CHECKS)}) AS "check", unnest([
      {_grade("doc_id % 4 >= 2", "doc_id % 4 = 2")},
      {_grade("told / n >= 0.8", "told < n")},
      {_grade("told_cols / cols >= 0.5", "told_cols / cols < 0.8")},
      {_grade("doc_id % 5 >= 2", "doc_id % 5 >= 3")},
      {_grade("n <= 1 OR joins > 0", "n > 1 AND joins < n - 1")},
      {_grade("n <= 12", "n >= 9")},
      {_grade("ex > 0 OR st IN ('O', 'F')", "st IN ('O', 'F') OR ex = 3")},
      {_grade("em > 0", "em > 100")},
      {_grade("nb >= 10", "nb < 20")},
      {_grade("NOT (cols >= 20 AND noisy / cols >= 0.30)", "cols >= 20 AND noisy / cols >= 0.15")},
      {_grade("acc IS NOT NULL")},
      {_grade("coalesce(acc >= 0.85, false)")}]) AS severity FROM g)"""


@FAMILY.add("ct_scorecard", types={"check_no": "INTEGER"}, oracle_sql=oracle(f"WITH {_CARD} SELECT *, severity <> 'fail' AS passed FROM card", "config_base"))
def scorecard(i):
    return c.scorecard(_documents(i))


@FAMILY.add(
    "ct_maturity",
    oracle(
        f"""WITH {_CARD} SELECT doc_id, count(*) FILTER (WHERE severity <> 'fail') AS score,
                   count(*) FILTER (WHERE severity = 'warning') AS warnings,
                   CASE WHEN bool_and(severity <> 'fail') THEN 'Trusted'
                        WHEN bool_and(severity <> 'fail' OR check_no > 10) THEN 'Ready to Optimize' ELSE 'Not Ready' END AS maturity
            FROM card GROUP BY 1""",
        "config_base",
    ),
)
def maturity(i):
    return c.maturity(c.scorecard(_documents(i)))


@FAMILY.add(
    "ct_config_drift",
    """SELECT DISTINCT l_orderkey AS doc_id, l_orderkey % 10 = 0 AS config_drifted, l_orderkey % 15 = 0 AS benchmarks_drifted
       FROM lineitem""",
)
def config_drift(i):
    return c.config_drift(_documents(i), _documents(i, live=True))


@FAMILY.add(
    "ct_asset_fingerprint",
    """SELECT l_orderkey AS doc_id, substr(sha256('["' || string_agg(DISTINCT p, '", "' ORDER BY p) || '"]'), 1, 16) AS fingerprint
       FROM (SELECT l_orderkey, 'part_' || CAST(l_partkey AS VARCHAR) AS p FROM lineitem) GROUP BY 1""",
)
def asset_fingerprint(i):
    assets = i.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("asset"))
    return c.asset_fingerprint(assets, "doc_id")


@FAMILY.add(
    "ct_version_match",
    oracle(
        """WITH v AS (
          SELECT space_id, run_id, started_at, 'baseline' AS target, config_fp AS cf, benchmark_fp AS bf,
                 config_fp IS NULL AS no_c, benchmark_fp IS NULL AS no_b FROM version_runs
          UNION ALL
          SELECT r.space_id, r.run_id, r.started_at, 'champion', coalesce(observed_config_fp, submitted_config_fp),
                 coalesce(observed_benchmark_fp, submitted_benchmark_fp), observed_config_fp IS NULL, observed_benchmark_fp IS NULL
          FROM version_runs r JOIN version_champions c USING (run_id)
          UNION ALL
          SELECT space_id, run_id, started_at, 'champion', NULL, NULL, true, true FROM version_runs
          WHERE best_iteration IS NOT NULL AND run_id NOT IN (SELECT run_id FROM version_champions)),
        j AS (SELECT l.space_id, l.config_fp AS lc, l.benchmark_fp AS lb, v.run_id, v.started_at, v.target, v.cf, v.bf,
                     coalesce(no_c, false) AS no_c, coalesce(no_b, false) AS no_b,
                     coalesce(v.cf = l.config_fp, false) AS mc, coalesce(v.bf = l.benchmark_fp, false) AS mb
              FROM live_versions l LEFT JOIN v USING (space_id)),
        s AS (SELECT space_id, bool_or(mc) AS c, bool_or(mb) AS b, bool_or(mc AND mb) AS f, bool_or(no_c) AS oc, bool_or(no_b) AS ob,
                     bool_or(cf IS NOT NULL OR bf IS NOT NULL) AS known, bool_or(lc IS NULL OR lb IS NULL) AS off FROM j GROUP BY 1),
        st AS (SELECT *, CASE WHEN NOT known THEN CASE WHEN oc OR ob THEN 'history_incomplete' ELSE 'no_known_versions' END
                    WHEN off THEN 'unavailable' WHEN f THEN 'matched' WHEN c AND b THEN 'mixed'
                    WHEN (NOT c AND oc) OR (NOT b AND ob) THEN 'history_incomplete' ELSE 'drifted' END AS status FROM s),
        cur AS (SELECT space_id, run_id, target FROM j WHERE mc AND mb
                QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY started_at DESC, run_id DESC, target DESC) = 1)
        SELECT st.space_id, status, CASE WHEN status = 'matched' THEN cur.run_id END AS run_id,
               CASE WHEN status = 'matched' THEN cur.target END AS target,
               CASE WHEN status = 'drifted' THEN concat_ws(',', CASE WHEN NOT c THEN 'config' END, CASE WHEN NOT b THEN 'benchmarks' END) END
                 AS drifted_dimensions
        FROM st LEFT JOIN cur USING (space_id)""",
        "version_runs", "version_champions", "live_versions",
    ),
)
def version_match(i):
    return c.version_match(i.version_runs, i.version_champions, i.live_versions)
