"""Driver tables and the derived input views of FIXTURES.md.

Each view is one SQL text in the subset that Spark and DuckDB share. Table and
view names appear as ``{name}``: Spark binds them to DataFrames, the oracle
text binds them to plain identifiers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "query_log": """
        SELECT 'q' || CAST(event_id AS STRING) AS statement_id,
               'ws' || CAST(user_id % 2 AS STRING) AS workspace_id,
               CASE WHEN event_type = 'signup' THEN NULL
                    ELSE 's' || CAST(user_id % 7 AS STRING) END AS space_id,
               'w' || CAST(event_id % 3 AS STRING) AS warehouse_id,
               ts AS start_time,
               'u' || CAST(user_id AS STRING) AS executed_by,
               CAST(floor(value * 10) AS BIGINT) AS task_ms,
               CAST(floor(value * 12) AS BIGINT) AS duration_ms,
               CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS execution_status,
               'SELECT * FROM t' || CAST(event_id % 5 AS STRING) || ' WHERE k = '
                 || CAST(event_id % 100 AS STRING) AS statement_text
        FROM {events}""",
    "billing_usage": """
        SELECT 'w' || CAST(event_id % 3 AS STRING) AS warehouse_id,
               date_trunc('hour', ts) AS usage_start_time,
               'sku' || CAST(event_id % 3 AS STRING) AS sku_name,
               'c1' AS cloud,
               sum(value) / 100 AS usage_quantity
        FROM {events}
        WHERE event_type IN ('view', 'click')
        GROUP BY 1, 2, 3, 4""",
    "list_prices": """
        SELECT sku_name, cloud, price_start_time, price_end_time,
               CAST(list_price AS DOUBLE) AS list_price
        FROM (VALUES
          ('sku0', 'c1', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-15 00:00:00', 0.5),
          ('sku0', 'c1', TIMESTAMP '2024-01-15 00:00:00', CAST(NULL AS TIMESTAMP), 0.75),
          ('sku1', 'c1', TIMESTAMP '2024-01-01 00:00:00', CAST(NULL AS TIMESTAMP), 0.25)
        ) AS p(sku_name, cloud, price_start_time, price_end_time, list_price)""",
    "audit_events": """
        SELECT event_id AS audit_id, ts AS event_time,
               'u' || CAST(user_id AS STRING) AS user_email,
               's' || CAST(user_id % 7 AS STRING) AS space_id,
               'ws' || CAST(user_id % 2 AS STRING) AS workspace_id,
               'c' || CAST(event_id % 50 AS STRING) AS conversation_id,
               'm' || CAST(event_id AS STRING) AS message_id,
               CASE event_id % 4 WHEN 0 THEN 'THUMBS_UP' WHEN 1 THEN 'THUMBS_DOWN'
                    WHEN 2 THEN 'OTHER' ELSE NULL END AS feedback_rating,
               'note ' || CAST(event_id % 9 AS STRING) AS comment
        FROM {events}
        WHERE event_type = 'click'""",
    "agents": """
        SELECT 's' || CAST(k AS STRING) AS space_id, 'Agent ' || CAST(k AS STRING) AS title
        FROM (SELECT DISTINCT user_id % 9 AS k FROM {events}) AS d""",
    "message_comments": """
        SELECT event_id AS ordinal, 'm' || CAST(event_id % 50 AS STRING) AS message_id,
               CASE WHEN event_id % 29 = 0 THEN '   '
                    ELSE '  ' || event_type || ' note ' || CAST(event_id % 17 AS STRING) || ' ' END AS content,
               ts AS created_at, 'u' || CAST(user_id AS STRING) AS user_id
        FROM {events}""",
    "lineage": """
        SELECT 's' || CAST(l.l_suppkey % 7 AS STRING) AS space_id,
               'ws' || CAST(l.l_orderkey % 2 AS STRING) AS workspace_id,
               p.p_brand AS source_table,
               'mart_' || CAST(l.l_suppkey % 5 AS STRING) AS target_table,
               l.l_shipdate AS event_time
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "messages": """
        SELECT 'Show ' || event_type || ' by s' || CAST(user_id % 7 AS STRING)
                 || ' above ' || CAST(event_id AS STRING)
                 || CASE WHEN event_id % 2 = 0 THEN '?' ELSE ' . ' END AS content,
               'c' || CAST(event_id % 400 AS STRING) AS conversation_id,
               CASE WHEN user_id % 10 = 0 THEN '' ELSE 'u' || CAST(user_id AS STRING) END AS user_key,
               CASE WHEN event_id % 11 = 0 THEN 'FAILED'
                    WHEN event_id % 11 = 1 THEN 'EXECUTING'
                    WHEN event_id % 11 = 2 THEN 'QUERY_RESULT_EXPIRED'
                    ELSE 'COMPLETED' END AS status,
               CASE WHEN event_id % 13 = 0 THEN 'THUMBS_DOWN' ELSE NULL END AS feedback,
               ts AS created_at, event_id AS ordinal
        FROM {events}""",
    "corpus_questions": """
        SELECT 'show ' || event_type || ' by s1 above 7' AS question
        FROM {events} GROUP BY event_type""",
    "candidates": """
        SELECT doc_id % 300 AS question_id, doc_id AS ordinal, text AS question,
               'SELECT ' || CAST(doc_id % 40 AS STRING) || ' -- ' || lang AS expected_sql,
               CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'generated' END AS source,
               CASE WHEN doc_id % 4 = 0 THEN 'valid' ELSE 'pending' END AS validation_status,
               CASE WHEN doc_id % 5 = 0 THEN 'P0' ELSE 'P1' END AS priority,
               CASE doc_id % 7 WHEN 0 THEN 'curated' WHEN 1 THEN 'synthetic'
                    WHEN 2 THEN 'coverage_gap_fill' ELSE 'imported' END AS provenance
        FROM {documents}""",
    "eval_rows": """
        SELECT doc_id AS question_id,
               CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS control_assessment,
               CASE WHEN toxic = 1 THEN 'NEEDS_REVIEW'
                    WHEN doc_id % 3 = 0 THEN 'GOOD'
                    WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS candidate_assessment,
               doc_id % 7 = 0 AS equivalent,
               CASE WHEN doc_id % 5 = 0 THEN 'equivalent' ELSE 'different' END AS reviewer_verdict,
               'run' || CAST(doc_id % 4 AS STRING) AS run_id
        FROM {labels}""",
    "iterations": """
        SELECT 'r' || CAST(o_custkey % 200 AS STRING) AS run_id,
               CAST(o_orderkey % 5 AS INT) AS iteration,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'slice'
                    WHEN '5-LOW' THEN 'enrichment' ELSE 'full' END AS eval_scope,
               o_orderdate AS event_ts,
               CAST(o_orderkey % 101 AS DOUBLE) AS overall_accuracy,
               CAST(o_orderkey % 21 AS INT) AS evaluated_count,
               CAST(floor((o_orderkey % 21) * (o_orderkey % 3) / 2) AS INT) AS correct_count,
               o_orderstatus = 'F' AS rolled_back,
               o_orderkey % 97 = 0 AS is_champion,
               CAST(o_orderkey % 4 AS INT) AS attempt_no,
               o_orderkey AS ordinal
        FROM {orders}""",
    "scan_results": """
        SELECT 's' || CAST(o_custkey % 50 AS STRING) AS space_id,
               CAST(o_orderkey % 13 AS INT) AS score,
               CASE WHEN o_orderkey % 13 = 12 THEN 'Trusted'
                    WHEN o_orderkey % 13 >= 8 THEN 'Ready to Optimize'
                    ELSE 'Not Ready' END AS maturity,
               o_orderdate AS scanned_at, o_orderkey AS ordinal
        FROM {orders}""",
    "memberships": """
        SELECT o.o_orderkey AS member_id, c.c_mktsegment AS unit,
               CAST(o.o_orderdate AS DATE) AS start_date,
               CASE WHEN o.o_orderstatus = 'O' THEN NULL
                    ELSE CAST(greatest(o.o_orderdate, max(l.l_shipdate)) AS DATE) END AS end_date
        FROM {orders} o
        JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
        GROUP BY o.o_orderkey, c.c_mktsegment, o.o_orderdate, o.o_orderstatus""",
    "column_usage": """
        SELECT 't' || CAST(event_id % 5 AS STRING) AS table_name,
               'c' || CAST(event_id % 60 AS STRING) AS column_name,
               CASE event_type WHEN 'view' THEN 'projection' WHEN 'click' THEN 'filter'
                    WHEN 'purchase' THEN 'join' WHEN 'signup' THEN 'group'
                    ELSE 'aggregate' END AS sql_role,
               'shape' || CAST(event_id % 240 AS STRING) AS shape_id,
               user_id % 7 = 1 AS in_scope,
               CASE WHEN user_id % 13 = 0 THEN 'service' ELSE 'user' END AS principal_kind,
               ts AS start_time
        FROM {events}""",
    "column_inventory": """
        SELECT table_name, column_name,
               CASE CAST(substr(column_name, 2) AS INT) % 4 WHEN 0 THEN 'bigint'
                    WHEN 1 THEN 'string' WHEN 2 THEN 'timestamp' ELSE 'double' END AS data_type,
               CASE WHEN CAST(substr(column_name, 2) AS INT) % 3 = 0 THEN NULL
                    ELSE 'value of ' || column_name END AS description,
               CAST(substr(column_name, 2) AS INT) % 10 = 0 AS is_key,
               CAST(substr(column_name, 2) AS INT) % 17 = 0 AS hidden
        FROM (SELECT DISTINCT table_name, column_name FROM {column_usage}) AS d""",
    "named_columns": """
        SELECT 'tbl' || CAST(CAST(floor(p_partkey / 12) AS BIGINT) AS STRING) AS table_name,
               CASE p_partkey % 12
                    WHEN 0 THEN 'order_status' WHEN 1 THEN 'customer_email' WHEN 2 THEN 'is_active'
                    WHEN 3 THEN 'etl_batch' WHEN 4 THEN 'product_category' WHEN 5 THEN 'notes'
                    WHEN 6 THEN 'total_amount' WHEN 7 THEN 'raw_payload' WHEN 8 THEN 'region_code'
                    WHEN 9 THEN 'order_id' WHEN 10 THEN 'created_at' ELSE 'load_key' END AS column_name,
               CASE p_partkey % 12 WHEN 6 THEN 'decimal(10,2)' WHEN 9 THEN 'bigint' WHEN 10 THEN 'timestamp'
                    WHEN 11 THEN 'int' ELSE 'string' END AS data_type,
               CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'one of the valid values for ' || p_type
                    WHEN 2 THEN 'internal audit column of ' || p_brand WHEN 3 THEN 'sensitive ' || p_type
                    ELSE p_type || ' sold as ' || p_brand END AS description,
               CAST(CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 7 = 1 THEN 1
                         ELSE p_size * (p_size % 7) * 5 END AS BIGINT) AS cardinality,
               CAST(2000 AS BIGINT) AS row_count,
               p_size % 11 = 3 AS referenced,
               CASE p_size % 13 WHEN 0 THEN 'tainted' WHEN 1 THEN 'unknown' ELSE 'clean' END AS verdict,
               p_size % 4 = 0 AS enabled
        FROM {part}""",
    "literals": """
        SELECT DISTINCT 'event_type' AS column_name,
               CASE user_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN event_type || 's'
                    WHEN 2 THEN event_type || ' only' ELSE event_type END AS literal
        FROM {events}
        UNION ALL
        SELECT DISTINCT 'o_orderpriority',
               CASE o_custkey % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN replace(o_orderpriority, '-', ' ')
                    ELSE substr(o_orderpriority, 3) END
        FROM {orders}""",
    "timed_questions": """
        SELECT o_orderkey AS question_id, o_custkey,
               CASE o_orderkey % 6 WHEN 0 THEN 'Returns this year for customer ' WHEN 1 THEN 'Last 30 days of returns of '
                    WHEN 2 THEN 'Returns YTD, customer ' WHEN 3 THEN 'Returns in the past 2 months of '
                    WHEN 4 THEN 'All returns of ' ELSE 'Yearly returns of ' END
                 || CAST(o_custkey AS STRING) AS question
        FROM {orders}""",
    "eval_details": """
        SELECT e.run_id, e.question_id, e.question_id % 3 AS iteration, e.candidate_assessment AS assessment,
               CASE WHEN e.question_id % 4 = 0 THEN NULL WHEN e.question_id % 4 = 1 THEN 'missing_filter'
                    WHEN e.question_id % 4 = 2 THEN 'wrong_join,missing_filter' ELSE 'wrong_grain' END AS reasons
        FROM {eval_rows} e""",
    "question_states": """
        SELECT doc_id AS question_id, CAST(toxic AS STRING) AS sql_text FROM {labels} WHERE quality = 1""",
    "dispositions": """
        SELECT l_orderkey AS question_id,
               CASE l_returnflag WHEN 'N' THEN 'passed' WHEN 'A' THEN 'warning' ELSE 'excluded' END AS disposition
        FROM {lineitem}""",
    "directory": """
        SELECT DISTINCT 's' || CAST(c_custkey % 60 AS STRING) AS space_id,
               'Agent ' || CAST(c_custkey % 60 AS STRING) AS title FROM {customer}""",
    "stars": """
        SELECT DISTINCT 's' || CAST((s_suppkey % 12) * 5 AS STRING) AS space_id FROM {supplier}""",
    "artifacts": """
        SELECT d.doc_id AS artifact_id, d.text AS question, d.lang AS kind,
               'SELECT ' || CAST(d.doc_id % 40 AS STRING) || ', total FROM sales -- ' || d.lang AS sql_text
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
        WHERE l.quality IS NULL OR l.quality = 0""",
    "corpus": """
        SELECT d.doc_id AS item_id, d.text AS question,
               'select ' || CAST(d.doc_id % 60 AS STRING) || ',  total from sales /* ' || d.lang || ' */' AS sql_text
        FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id
        WHERE l.quality = 1""",
    "ids_with_suffixes": """
        SELECT doc_id AS ordinal,
               'q' || CAST(doc_id % 300 AS STRING) || CASE WHEN doc_id % 17 = 0 THEN ':v3' ELSE '' END AS question_id
        FROM {documents}""",
    "qa_pairs": """
        SELECT o_orderkey AS question_id,
               CASE o_orderkey % 7
                 WHEN 0 THEN 'What is the total price for customer ' || CAST(o_custkey AS STRING) || '?'
                 WHEN 1 THEN 'Compare urgent versus low orders of ' || CAST(o_custkey AS STRING)
                 WHEN 2 THEN 'Top customers by highest price'
                 WHEN 3 THEN 'Show me the status of order ' || CAST(o_orderkey AS STRING)
                 WHEN 4 THEN 'Orders of customer ' || CAST(o_custkey AS STRING) || ' since 1998'
                 WHEN 5 THEN 'List active customers' ELSE 'Anything else' END AS question,
               CASE o_orderkey % 8
                 WHEN 0 THEN 'SELECT sum(o_totalprice) FROM orders WHERE o_custkey = ' || CAST(o_custkey AS STRING)
                 WHEN 1 THEN 'SELECT o_orderkey FROM orders LIMIT 10'
                 WHEN 2 THEN 'SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY 1 LIMIT 5'
                 WHEN 3 THEN 'SELECT * FROM (SELECT o_custkey FROM orders LIMIT 3) AS t ORDER BY o_custkey LIMIT 2'
                 WHEN 4 THEN 'SELECT o_orderkey FROM orders WHERE o_orderdate < current_date() ORDER BY rand() LIMIT 1'
                 WHEN 5 THEN 'SELECT o_orderkey FROM orders WHERE note = ''LIMIT 5 now()'' -- uuid() LIMIT 3'
                 WHEN 6 THEN 'SELECT o_orderkey FROM orders TABLESAMPLE (10 ROWS) WHERE is_active = 1'
                 ELSE 'SELECT l.l_orderkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey' END AS expected_sql,
               CASE o_orderkey % 5 WHEN 0 THEN 'ranking' WHEN 1 THEN 'detail' ELSE NULL END AS category
        FROM {orders}""",
    "instructions": """
        SELECT o_orderkey AS doc_id,
               'Use the customer name.' || chr(10)
                 || CASE o_orderkey % 9
                      WHEN 0 THEN 'Select a region from the list'
                      WHEN 1 THEN 'Do not join orders to lineitem'
                      WHEN 2 THEN 'Revenue: SELECT sum(o_totalprice) FROM orders'
                      WHEN 3 THEN 'Only rows WHERE o_orderstatus = ''F'' count'
                      WHEN 4 THEN 'Always group by t.region and order by t.total'
                      WHEN 5 THEN 'group by t.region, order by t.total'
                      WHEN 6 THEN 'JOIN lineitem ON l_orderkey'
                      WHEN 7 THEN 'Rank with ORDER BY total DESC'
                      ELSE 'Where applicable, say so' END
                 || chr(10) || 'Order ' || CAST(o_orderkey AS STRING) AS body
        FROM {orders}""",
    "table_texts": """
        SELECT table_name, 'Track order status, total amount and region per customer. '
                 || coalesce(min(description), 'Created daily') AS body
        FROM {named_columns} GROUP BY table_name""",
    "mention_log": """
        SELECT event_id, 'SELECT a.c' || CAST(event_id % 60 AS STRING) || ', `d' || CAST(user_id % 11 AS STRING)
                 || '` FROM sales.t' || CAST(event_id % 5 AS STRING) || ' a WHERE a.flag = 1' AS statement_text
        FROM {events}""",
    "local_evidence": """
        SELECT table_name, column_name,
               CASE CAST(substr(column_name, 2) AS INT) % 6 WHEN 0 THEN 'JOIN_KEY' WHEN 1 THEN 'BENCHMARK_SQL'
                    WHEN 2 THEN 'COLUMN_BEHAVIOR' WHEN 3 THEN 'SEMANTIC_MATCH' WHEN 4 THEN 'METRIC_FIELD'
                    ELSE 'CONFIG_SQL' END AS reason,
               CAST(CAST(substr(column_name, 2) AS INT) % 4 + 1 AS DOUBLE) AS score
        FROM {column_inventory}""",
    "table_list": """
        SELECT table_name, CASE WHEN max(cardinality) % 2 = 0 THEN 'TABLE' ELSE 'VIEW' END AS table_type,
               CASE WHEN max(cardinality) % 3 = 0 THEN NULL ELSE 'holds ' || min(column_name) END AS table_comment
        FROM {named_columns} WHERE column_name <> 'notes' GROUP BY table_name""",
    "table_tags": """
        SELECT table_name, 'tier' AS tag_name, table_type AS tag_value FROM {table_list}""",
    "column_tags": """
        SELECT table_name, column_name, 'verdict' AS tag_name, verdict AS tag_value FROM {named_columns}
        WHERE verdict <> 'clean'""",
    "key_columns": """
        SELECT 'fk' || CAST(l_orderkey AS STRING) AS constraint_name, 'child' || CAST(l_orderkey % 100 AS STRING) AS table_name,
               'c' || CAST(l_partkey AS STRING) AS column_name, l_linenumber AS ordinal_position
        FROM {lineitem}""",
    "referenced_columns": """
        SELECT 'fk' || CAST(l_orderkey AS STRING) AS constraint_name, 'parent' || CAST(l_orderkey % 90 AS STRING) AS table_name,
               'p' || CAST(l_suppkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS column_name
        FROM {lineitem}""",
    "configured_tables": """
        SELECT DISTINCT 's' || CAST(p_partkey % 9 AS STRING) AS space_id, p_brand AS full_name FROM {part}
        WHERE p_size < 25""",
    "edges": """
        SELECT 'n' || CAST(l_partkey % 60 AS STRING) AS source_table, 'n' || CAST(l_suppkey % 70 AS STRING) AS target_table,
               l_shipdate AS event_time
        FROM {lineitem}""",
    "governed_assets": """
        SELECT 'v' || CAST(p_partkey AS STRING) AS asset, p_size % 3 = 0 AS is_view, p_brand <> 'Brand#13' AS readable,
               p_size % 10 = 0 AS has_row_filter, p_size % 15 = 0 AS has_column_mask, p_size % 21 = 0 AS is_dynamic
        FROM {part}""",
    "view_bases": """
        SELECT DISTINCT 'v' || CAST(l_partkey AS STRING) AS asset, 'v' || CAST(l_suppkey AS STRING) AS base FROM {lineitem}""",
    "benchmark_refs": """
        SELECT l_orderkey AS benchmark_id, l_linenumber AS ordinal,
               'main.sales.T' || CAST(l_partkey % 300 AS STRING) AS table_ref
        FROM {lineitem}""",
    "known_assets": """
        SELECT DISTINCT 'main.sales.t' || CAST(p_partkey % 350 AS STRING) AS asset,
               CASE p_partkey % 350 % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'metric_view' ELSE 'function' END AS kind
        FROM {part}""",
    "join_specs": """
        SELECT DISTINCT 't' || CAST(l_suppkey % 310 AS STRING) AS left_table, 'T' || CAST(l_partkey % 310 AS STRING) AS right_table
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "function_columns": """
        SELECT 'f' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) AS function_name,
               CASE p_partkey % 4 WHEN 0 THEN 'Order_Status' WHEN 1 THEN 'total_amount'
                    WHEN 2 THEN 'metric_' || CAST(p_size AS STRING) ELSE 'REGION_CODE' END AS column_name
        FROM {part}""",
    "readiness_columns": """
        SELECT 'g' || CAST(p_size % 8 AS STRING) AS grp, 'schema' || CAST(p_size % 8 % 3 AS STRING) AS schema_name,
               'tbl' || CAST(p_partkey % 24 AS STRING) AS table_name,
               lower(p_brand) || CASE p_partkey % 5 WHEN 0 THEN '_revenue' WHEN 1 THEN '_region' ELSE '_x' END AS column_name,
               CASE WHEN p_partkey % (p_size % 8 + 1) = 0 THEN 'the ' || p_type ELSE NULL END AS description,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'string' END AS data_type,
               CASE WHEN p_partkey % 24 % 2 = 0 THEN 'about ' || CAST(p_partkey % 24 AS STRING) ELSE NULL END AS table_comment
        FROM {part}""",
    "readiness_questions": """
        SELECT 'g' || CAST(s_suppkey % 6 AS STRING) AS grp,
               CASE s_suppkey % 3 WHEN 0 THEN 'Revenue growth by region' WHEN 1 THEN 'Profit per customer and year'
                    ELSE 'Sales count by segment' END AS question
        FROM {supplier}""",
    "version_runs": """
        SELECT 's' || CAST(o_custkey AS STRING) AS space_id, 'r' || CAST(o_orderkey AS STRING) AS run_id,
               o_orderdate AS started_at,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'c' || CAST(o_orderkey % 6 AS STRING) END AS config_fp,
               CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'b' || CAST(o_orderkey % 5 AS STRING) END AS benchmark_fp,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE NULL END AS best_iteration
        FROM {orders}""",
    "version_champions": """
        SELECT 'r' || CAST(o_orderkey AS STRING) AS run_id,
               CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'c' || CAST(o_custkey % 6 AS STRING) END AS observed_config_fp,
               'c9' AS submitted_config_fp,
               CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'b' || CAST(o_custkey % 5 AS STRING) END AS observed_benchmark_fp,
               'b9' AS submitted_benchmark_fp
        FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""",
    "live_versions": """
        SELECT 's' || CAST(c_custkey AS STRING) AS space_id,
               CASE WHEN c_acctbal < -900 THEN NULL ELSE 'c' || CAST(c_custkey % 9 AS STRING) END AS config_fp,
               'b' || CAST(c_custkey % 8 AS STRING) AS benchmark_fp
        FROM {customer}""",
    "config_base": """
        SELECT o.o_orderkey AS doc_id, o.o_custkey, o.o_orderstatus, o.o_orderpriority, l.l_linenumber, l.l_partkey,
               l.l_returnflag, l.l_linestatus, l.l_quantity, l.l_discount
        FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""",
    "mutations": """
        SELECT 'run' || CAST(doc_id % 4 AS STRING) AS run_id, doc_id AS question_id,
               CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'excluded' WHEN 2 THEN 'removed'
                    WHEN 3 THEN 'changed' ELSE 'prune_recommended' END AS op,
               CAST(quality AS STRING) AS before_sql, CAST(toxic AS STRING) AS after_sql
        FROM {labels}""",
    "stages": """
        SELECT 'r' || CAST(user_id % 20 AS STRING) AS run_id, event_type AS step,
               ts AS started_at, event_id AS ordinal,
               CASE event_id % 4 WHEN 0 THEN 'STARTED' WHEN 1 THEN 'COMPLETE'
                    WHEN 2 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS duration_seconds
        FROM {events}""",
    "dirty": """
        SELECT event_id,
               CASE WHEN event_id % 3 = 0 THEN upper(event_type)
                    WHEN event_id % 3 = 1 THEN event_type
                    ELSE NULL END AS label,
               CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' ELSE NULL END AS flag,
               CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'x' END AS blankish,
               CAST(NULL AS STRING) AS all_null,
               'same' AS constant_col
        FROM {events}""",
}

# The one view whose generator differs by engine: a row per day, spanning the
# calendar years that the events touch and the year before.
CALENDAR_SPARK = """
    SELECT explode(sequence(add_months(trunc(min(ts), 'YEAR'), -12),
                            date_sub(add_months(trunc(max(ts), 'YEAR'), 12), 1),
                            interval 1 day)) AS date_key
    FROM {events}"""
CALENDAR_DUCKDB = """
    SELECT CAST(unnest(generate_series(date_trunc('year', min(ts)) - INTERVAL 1 YEAR,
                                       date_trunc('year', max(ts)) + INTERVAL 1 YEAR - INTERVAL 1 DAY,
                                       INTERVAL 1 DAY)) AS DATE) AS date_key
    FROM events"""

_NAME = re.compile(r"\{(\w+)\}")


class Inputs:
    """Lazy access to the driver tables and derived views of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = CALENDAR_SPARK if name == "calendar" else VIEWS[name]
        return self.spark.sql(text, **{ref: self.get(ref) for ref in set(_NAME.findall(text))})


def oracle(sql: str, *views: str) -> str:
    """``sql`` with the named input views in front as common table expressions."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes or name in TABLES:
            return
        text = CALENDAR_DUCKDB if name == "calendar" else VIEWS[name]
        for ref in _NAME.findall(text):
            add(ref)
        ctes[name] = _NAME.sub(r"\1", text)

    for view in views:
        add(view)
    body = sql.strip()
    if not ctes:
        return body
    head = ",\n".join(f"{name} AS ({text})" for name, text in ctes.items())
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
