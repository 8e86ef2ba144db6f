"""Result-set equivalence queries."""

import uuid

from pyspark.sql import functions as F

from auditframe.functions.columns import union_all
from auditframe.functions.storage import session_folder
from auditframe.operators import digest
from auditframe.operators import equivalence as eq
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()

_A = "SELECT o_orderpriority, o_orderstatus, o_custkey FROM orders"
_B = """SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status,
               CAST(o_custkey AS DOUBLE) AS customer FROM orders"""


def _a(i):
    return i.orders.select("o_orderpriority", "o_orderstatus", "o_custkey")


def _b(i):
    status = F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus"))
    return i.orders.select(
        "o_orderpriority", status.alias("status"), F.col("o_custkey").cast("double").alias("customer")
    )


@FAMILY.add(
    "eq_setdiff_counts",
    f"""SELECT (SELECT count(*) FROM ({_A} EXCEPT ALL {_B})) AS a_minus_b,
               (SELECT count(*) FROM ({_B} EXCEPT ALL {_A})) AS b_minus_a""",
)
def setdiff_counts(i):
    return eq.setdiff_counts(_a(i), _b(i))


_KEPT = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_EDITED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 500 = 7 THEN 'X' ELSE o_orderstatus END, o_totalprice FROM orders"""


def _kept(i):
    return i.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _stored(*batches):
    """The folder of a new stored table with these batches."""
    spark = batches[0].sparkSession
    folder = f"{session_folder(spark)}/digests-{uuid.uuid4().hex}"
    for k, batch in enumerate(batches):
        digest.put(batch, folder, str(k), ["o_orderkey"], ranges=64)
    return folder


@FAMILY.add(
    "eq_stored_setdiff",
    f"""SELECT (SELECT count(*) FROM ({_KEPT} EXCEPT ALL {_EDITED})) AS a_minus_b,
               (SELECT count(*) FROM ({_EDITED} EXCEPT ALL {_KEPT})) AS b_minus_a""",
)
def stored_setdiff(i):
    a = _kept(i)
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 500 == 7, "X").otherwise(F.col("o_orderstatus")))
    return digest.stored_setdiff_counts(a.sparkSession, _stored(a), _stored(b))


@FAMILY.add(
    "eq_stored_equal",
    f"""SELECT NOT EXISTS ({_KEPT} EXCEPT ALL ({_KEPT} WHERE o_custkey % 3 = 0 UNION ALL {_KEPT} WHERE o_custkey % 3 <> 0))
           AND NOT EXISTS (({_KEPT} WHERE o_custkey % 3 = 0 UNION ALL {_KEPT} WHERE o_custkey % 3 <> 0) EXCEPT ALL {_KEPT}) AS equivalent""",
)
def stored_equal(i):
    a = _kept(i)
    third = F.col("o_custkey") % 3 == 0
    return digest.stored_equal(a.sparkSession, _stored(a), _stored(a.filter(third), a.filter(~third)))


@FAMILY.add(
    "eq_diff_rows",
    f"""SELECT 'a' AS side, count(*) AS copies, o_orderpriority, o_orderstatus,
               CAST(o_custkey AS DOUBLE) AS o_custkey
        FROM ({_A} EXCEPT ALL {_B}) GROUP BY ALL
        UNION ALL
        SELECT 'b', count(*), o_orderpriority, status, customer FROM ({_B} EXCEPT ALL {_A}) GROUP BY ALL""",
)
def diff_rows(i):
    return eq.diff_rows(_a(i), _b(i))


def _long(i):
    return i.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("supplier"), "l_returnflag").agg(
        F.sum("l_quantity").alias("qty")
    )


def _wide(i):
    return (
        i.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("supplier"))
        .pivot("l_returnflag", ["A", "N", "R"])
        .agg(F.sum("l_quantity"))
    )


_NUMBERS = """
  a AS (SELECT round(sum(l_quantity), 6) AS v FROM lineitem GROUP BY l_suppkey, l_returnflag),
  b AS (SELECT unnest([round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6),
                       round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6),
                       round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6)]) AS v
        FROM lineitem GROUP BY l_suppkey),
  same AS (SELECT NOT EXISTS (SELECT v FROM a WHERE v IS NOT NULL EXCEPT ALL SELECT v FROM b WHERE v IS NOT NULL)
              AND NOT EXISTS (SELECT v FROM b WHERE v IS NOT NULL EXCEPT ALL SELECT v FROM a WHERE v IS NOT NULL)
                  AS equivalent)"""


@FAMILY.add("eq_numeric_multiset", f"WITH {_NUMBERS} SELECT equivalent FROM same")
def numeric_multiset(i):
    return eq.numeric_equivalence(_long(i), _wide(i))


@FAMILY.add(
    "eq_cascade",
    f"""WITH {_NUMBERS}
    SELECT 'self' AS pair, 'exact' AS method,
           NOT EXISTS ({_A} EXCEPT ALL {_A}) AS equivalent
    UNION ALL SELECT 'edited', 'exact', NOT EXISTS ({_A} EXCEPT ALL {_B}) AND NOT EXISTS ({_B} EXCEPT ALL {_A})
    UNION ALL SELECT 'reshaped', 'numeric_multiset', equivalent FROM same
    UNION ALL SELECT 'no numbers', 'none', false""",
)
def cascade(i):
    labels_only = i.orders.select("o_orderpriority")
    pairs = {
        "self": (_a(i), _a(i)),
        "edited": (_a(i), _b(i)),
        "reshaped": (_long(i), _wide(i)),
        "no numbers": (labels_only, _a(i).select("o_orderpriority", "o_orderstatus")),
    }
    return union_all([eq.compare(a, b).withColumn("pair", F.lit(name)) for name, (a, b) in pairs.items()])


@FAMILY.add(
    "eq_reason_codes",
    f"""WITH only_a AS ({_A} EXCEPT ALL {_B}), only_b AS ({_B} EXCEPT ALL {_A}),
    empty_ AS (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0)
    SELECT 'edited' AS pair, unnest(['RESULT_MISSING_ROWS', 'RESULT_EXTRA_ROWS',
                                     'RESULT_MISSING_COLUMNS', 'RESULT_EXTRA_COLUMNS']) AS code
    WHERE (SELECT count(*) FROM only_a) > 0 AND (SELECT count(*) FROM only_b) > 0
    UNION ALL SELECT 'empty', unnest(['EMPTY_RESULT', 'RESULT_MISSING_ROWS']) FROM empty_ WHERE n = 0
    UNION ALL SELECT 'total', 'SINGLE_CELL_DIFFERENCE'
      WHERE (SELECT sum(o_custkey) FROM orders) <> (SELECT sum(o_custkey) + 1 FROM orders)
    UNION ALL SELECT 'retyped', 'COLUMN_TYPE_DIFFERENCE'""",
)
def reason_codes(i):
    total = i.orders.agg(F.sum("o_custkey").alias("total"))
    pairs = {
        "edited": (_b(i), _a(i)),
        "empty": (i.orders.filter("o_totalprice < 0").select(*_a(i).columns), _a(i)),
        "total": (total, total.select((F.col("total") + 1).alias("total"))),
        "retyped": (_a(i).withColumn("o_custkey", F.col("o_custkey").cast("double")), _a(i)),
    }
    return union_all(
        [eq.reason_codes(got, want).withColumn("pair", F.lit(name)) for name, (got, want) in pairs.items()]
    )


_VERDICT = """SELECT question_id, run_id, candidate_assessment,
       CASE WHEN candidate_assessment = 'GOOD' OR equivalent OR reviewer_verdict = 'equivalent'
            THEN 'GOOD' ELSE candidate_assessment END AS final,
       CASE WHEN candidate_assessment = 'GOOD' THEN 'native' WHEN equivalent THEN 'data'
            WHEN reviewer_verdict = 'equivalent' THEN 'reviewer' ELSE 'native' END AS decided_by
FROM eval_rows"""


@FAMILY.add("eq_final_verdict", oracle(f"SELECT question_id, final, decided_by FROM ({_VERDICT})", "eval_rows"))
def final_verdict(i):
    return eq.final_verdict(i.eval_rows, "candidate_assessment").select("question_id", "final", "decided_by")


@FAMILY.add(
    "eq_run_rollup",
    oracle(
        f"""SELECT run_id, count(*) AS n,
                   count(*) FILTER (WHERE candidate_assessment = 'GOOD') AS good,
                   count(*) FILTER (WHERE candidate_assessment = 'NEEDS_REVIEW') AS review,
                   count(*) FILTER (WHERE candidate_assessment = 'BAD') AS bad,
                   count(*) FILTER (WHERE final = 'GOOD') AS final_good,
                   round(100.0 * count(*) FILTER (WHERE candidate_assessment = 'GOOD') / count(*), 1) AS accuracy_native,
                   round(100.0 * count(*) FILTER (WHERE final = 'GOOD') / count(*), 1) AS accuracy_final
            FROM ({_VERDICT}) GROUP BY 1""",
        "eval_rows",
    ),
)
def run_rollup(i):
    return eq.run_rollup(eq.final_verdict(i.eval_rows, "candidate_assessment"), "candidate_assessment")


@FAMILY.add(
    "eq_nonempty",
    """SELECT 'returned items' AS name, count(*) AS n, count(*) > 0 AS has_rows FROM lineitem WHERE l_returnflag = 'R'
       UNION ALL SELECT 'negative totals', count(*), count(*) > 0 FROM orders WHERE o_totalprice < 0
       UNION ALL SELECT 'german documents', count(*), count(*) > 0 FROM documents WHERE lang = 'de'""",
)
def nonempty(i):
    return eq.has_rows(
        {
            "returned items": i.lineitem.filter("l_returnflag = 'R'"),
            "negative totals": i.orders.filter("o_totalprice < 0"),
            "german documents": i.documents.filter("lang = 'de'"),
        }
    )
