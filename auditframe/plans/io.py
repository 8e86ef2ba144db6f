"""IO queries."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions.storage import session_folder
from auditframe.operators import io, merge
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()


@FAMILY.add(
    "io_filtered_scan",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
)
def filtered_scan(i):
    df = io.read_filtered(
        i.spark, f"{i.sf_dir}/orders.parquet", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    )
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


_KEPT = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("note", T.StringType())])


@FAMILY.add(
    "io_append",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DOUBLE) END AS o_totalprice,
              CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS note FROM orders""",
)
def append(i):
    """Two appends of other columns and column orders, read back under one schema."""
    path = f"{session_folder(i.spark)}/append-{uuid.uuid4().hex}"
    done = F.col("o_orderstatus") == "F"
    io.append(i.orders.filter(done).select("o_totalprice", "o_orderkey", "o_custkey"), path, _KEPT)
    io.append(i.orders.filter(~done).select(F.col("o_orderpriority").alias("note"), "o_orderkey"), path, _KEPT)
    return i.spark.read.parquet(path)


@FAMILY.add(
    "io_unique_key_guard",
    oracle(
        "SELECT question_id, count(*) AS n FROM candidates GROUP BY question_id HAVING count(*) > 1",
        "candidates",
    ),
)
def unique_key_guard(i):
    return io.duplicate_keys(i.candidates, ["question_id"])


@FAMILY.add(
    "io_latest_wins",
    oracle(
        """SELECT run_id, iteration, eval_scope, overall_accuracy, ordinal FROM iterations
           QUALIFY row_number() OVER (PARTITION BY run_id, iteration
                                      ORDER BY event_ts DESC, ordinal DESC) = 1""",
        "iterations",
    ),
)
def latest_wins(i):
    df = io.latest_wins(
        i.iterations, ["run_id", "iteration"], [F.desc("event_ts"), F.desc("ordinal")]
    )
    return df.select("run_id", "iteration", "eval_scope", "overall_accuracy", "ordinal")


@FAMILY.add(
    "io_merge",
    oracle(
        """SELECT run_id, iteration, eval_scope, overall_accuracy, event_ts, ordinal FROM iterations
           QUALIFY row_number() OVER (PARTITION BY run_id, iteration
                                      ORDER BY event_ts DESC, ordinal DESC) = 1""",
        "iterations",
    ),
)
def merge_rows(i):
    """The newest row per key, kept by upserts: a table and two merges, none of which reads the log again."""
    rows = i.iterations.select("run_id", "iteration", "eval_scope", "overall_accuracy", "event_ts", "ordinal")
    path = f"{session_folder(i.spark)}/merge-{uuid.uuid4().hex}"
    order = [F.desc("event_ts"), F.desc("ordinal")]
    merge.create_table(rows.filter("ordinal % 3 = 0"), path, ["run_id", "iteration"], order)
    for part in (1, 2):
        merge.merge(rows.filter(f"ordinal % 3 = {part}"), path, order)
    return merge.read_table(i.spark, path)


@FAMILY.add(
    "io_stamp_flag",
    oracle(
        """SELECT run_id, ordinal,
                  coalesce(overall_accuracy >= 85 AND NOT rolled_back, false) AS accepted
           FROM iterations""",
        "iterations",
    ),
)
def stamp_flag(i):
    accepted = (F.col("overall_accuracy") >= 85) & ~F.col("rolled_back")
    return io.stamp(i.iterations, "accepted", accepted).select("run_id", "ordinal", "accepted")


@FAMILY.add(
    "io_hash_verify",
    """SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE lang = 'de'""",
)
def hash_verify(i):
    stored = io.with_hash(i.documents.select("doc_id", "text", "lang"), "text")
    edited = stored.withColumn(
        "text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    )
    return io.hash_mismatches(edited, "text").select("doc_id", "content_hash")


@FAMILY.add(
    "io_json_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_props(i):
    df = io.parse_json_column(i.events, "props", "k BIGINT")
    return df.select("event_id", F.col("props.k").alias("k"))


@FAMILY.add("io_preview", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5")
def preview(i):
    return io.preview(i.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"])
