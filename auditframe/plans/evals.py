"""Evaluation-run queries."""

import datetime as dt

from pyspark.sql import functions as F

from auditframe.operators import evals as ev
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()

_ACC = """
  acc AS (SELECT *, CASE WHEN evaluated_count > 0 THEN round(100.0 * correct_count / evaluated_count, 2)
                         ELSE overall_accuracy END AS accuracy FROM iterations)"""


@FAMILY.add("ev_accuracy", oracle(f"WITH {_ACC} SELECT run_id, ordinal, accuracy FROM acc", "iterations"))
def accuracy(i):
    return ev.with_accuracy(i.iterations).select("run_id", "ordinal", "accuracy")


@FAMILY.add(
    "ev_drift",
    oracle(
        f"""WITH {_ACC} SELECT run_id, ordinal, accuracy, overall_accuracy,
                               round(accuracy - overall_accuracy, 4) AS drift
        FROM acc WHERE abs(accuracy - overall_accuracy) > 0.5""",
        "iterations",
    ),
)
def drift(i):
    return ev.accuracy_drift(i.iterations).select(
        "run_id", "ordinal", "accuracy", "overall_accuracy", F.round("drift", 4).alias("drift")
    )


@FAMILY.add(
    "ev_run_scores",
    oracle(
        f"""WITH {_ACC},
        base AS (SELECT run_id, accuracy, ordinal FROM acc WHERE eval_scope = 'full' AND iteration = 0
                 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_ts, ordinal) = 1),
        pool AS (SELECT a.run_id, iteration, a.accuracy,
                        CASE WHEN iteration = 0 THEN 'enrichment' ELSE 'full' END AS scope
                 FROM acc a LEFT JOIN base b USING (run_id)
                 WHERE NOT rolled_back AND a.accuracy IS NOT NULL AND a.ordinal IS DISTINCT FROM b.ordinal
                   AND (eval_scope = 'full' OR (eval_scope = 'enrichment' AND iteration = 0))),
        best AS (SELECT * FROM pool
                 QUALIFY row_number() OVER (PARTITION BY run_id
                   ORDER BY accuracy DESC, iteration, CASE scope WHEN 'full' THEN 0 ELSE 1 END) = 1),
        runs AS (SELECT DISTINCT run_id FROM iterations)
        SELECT r.run_id, b.accuracy AS baseline,
               CASE WHEN x.accuracy > b.accuracy THEN x.accuracy ELSE b.accuracy END AS optimized,
               CASE WHEN b.accuracy IS NOT NULL THEN 0 END AS baseline_iteration,
               CASE WHEN x.accuracy > b.accuracy THEN x.iteration WHEN b.accuracy IS NOT NULL THEN 0 END AS best_iteration,
               CASE WHEN x.accuracy > b.accuracy THEN x.scope WHEN b.accuracy IS NOT NULL THEN 'full' END AS best_eval_scope
        FROM runs r LEFT JOIN base b USING (run_id) LEFT JOIN best x USING (run_id)""",
        "iterations",
    ),
)
def run_scores(i):
    return ev.run_scores(i.iterations)


@FAMILY.add(
    "ev_champion",
    oracle(
        """WITH universe AS (SELECT * FROM iterations
                             QUALIFY eval_scope = 'full' OR NOT bool_or(eval_scope = 'full') OVER (PARTITION BY run_id)),
        flagged AS (SELECT *, bool_or(is_champion) OVER (PARTITION BY run_id) AS any_flag,
                           (NOT rolled_back OR (iteration = 0 AND eval_scope = 'full')) AS fit FROM universe),
        pool AS (SELECT *, bool_or(fit) OVER (PARTITION BY run_id) AS any_fit FROM flagged)
        SELECT run_id, ordinal, iteration, eval_scope, overall_accuracy FROM pool
        WHERE CASE WHEN any_flag THEN is_champion WHEN any_fit THEN fit ELSE true END
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY overall_accuracy DESC, ordinal) = 1""",
        "iterations",
    ),
)
def champion(i):
    return ev.champion(i.iterations).select("run_id", "ordinal", "iteration", "eval_scope", "overall_accuracy")


@FAMILY.add(
    "ev_attempts",
    oracle(
        """WITH e AS (SELECT * FROM iterations WHERE eval_scope IN ('full', 'enrichment')),
        zero AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_ts, ordinal) AS k,
                        min(event_ts) OVER (PARTITION BY run_id) AS first_ts
                 FROM e WHERE attempt_no = 0 AND iteration = 0 AND eval_scope = 'full'),
        numbered AS (SELECT run_id, attempt_no, ordinal, overall_accuracy, is_champion, false AS recovered
                     FROM e WHERE attempt_no <> 0
                     QUALIFY row_number() OVER (PARTITION BY run_id, attempt_no
                                                ORDER BY iteration DESC, event_ts DESC, ordinal) = 1),
        top AS (SELECT run_id, max(attempt_no) AS m FROM numbered GROUP BY 1),
        recovered AS (SELECT run_id, coalesce(m, 0) + row_number() OVER (PARTITION BY run_id ORDER BY event_ts, ordinal)
                               AS attempt_no, ordinal, overall_accuracy, is_champion, true AS recovered
                      FROM zero LEFT JOIN top USING (run_id) WHERE event_ts > first_ts),
        rows_ AS (SELECT * FROM numbered UNION ALL SELECT * FROM recovered),
        pool AS (SELECT run_id, attempt_no, overall_accuracy FROM rows_ WHERE is_champion
                 UNION ALL SELECT run_id, 0, overall_accuracy FROM zero WHERE k = 1 AND is_champion),
        winner AS (SELECT run_id, attempt_no AS w FROM pool
                   QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY overall_accuracy DESC, attempt_no) = 1)
        SELECT run_id, CAST(attempt_no AS INT) AS attempt_no, ordinal, overall_accuracy, recovered,
               coalesce(attempt_no = w, false) AS is_champion
        FROM rows_ LEFT JOIN winner USING (run_id)""",
        "iterations",
    ),
)
def attempts(i):
    return ev.attempts(i.iterations).select(
        "run_id", "attempt_no", "ordinal", "overall_accuracy", "recovered", "is_champion"
    )


@FAMILY.add(
    "ev_trajectory",
    types={"attempt_no": "INTEGER"},
    oracle_sql=oracle(
        """WITH base AS (SELECT run_id, ordinal AS b, overall_accuracy AS b_acc FROM iterations
                         WHERE iteration = 0 AND eval_scope = 'full'
                         QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_ts, ordinal) = 1),
        marked AS (SELECT i.*, coalesce(i.ordinal = b, false) AS is_baseline, b_acc,
                          i.ordinal IS DISTINCT FROM b AND eval_scope = 'full' AND iteration = 0 AND attempt_no = 0 AS rec
                   FROM iterations i LEFT JOIN base USING (run_id)),
        rank_ AS (SELECT run_id, ordinal,
                         row_number() OVER (PARTITION BY run_id ORDER BY attempt_no, event_ts, ordinal) AS k
                  FROM marked WHERE rec),
        free AS (SELECT run_id, n, row_number() OVER (PARTITION BY run_id ORDER BY n) AS k
                 FROM (SELECT run_id, unnest(range(1, 5 + count(*))) AS n FROM marked GROUP BY run_id) s
                 WHERE NOT EXISTS (SELECT 1 FROM iterations u WHERE u.run_id = s.run_id AND u.attempt_no = s.n))
        SELECT m.run_id, m.ordinal, iteration, eval_scope, event_ts,
               CASE WHEN is_baseline THEN NULL WHEN rec THEN free.n ELSE attempt_no END AS attempt_no,
               is_baseline, overall_accuracy AS accuracy, round(overall_accuracy - b_acc, 2) AS delta_vs_baseline,
               rolled_back
        FROM marked m LEFT JOIN rank_ ON rank_.run_id = m.run_id AND rank_.ordinal = m.ordinal
        LEFT JOIN free ON free.run_id = m.run_id AND free.k = rank_.k""",
        "iterations",
    ),
)
def trajectory(i):
    return ev.trajectory(i.iterations)


@FAMILY.add(
    "ev_latest_state",
    oracle(
        """SELECT 'full' AS state, run_id, iteration, ordinal FROM iterations
           WHERE eval_scope = 'full' AND NOT rolled_back
           QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC, event_ts DESC, ordinal DESC) = 1
           UNION ALL
           SELECT 'state', run_id, iteration, ordinal FROM iterations
           WHERE eval_scope IN ('full', 'enrichment') AND NOT rolled_back
           QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC, event_ts DESC, ordinal DESC) = 1""",
        "iterations",
    ),
)
def latest_state(i):
    def one(name, scopes):
        return ev.latest_state(i.iterations, scopes).select(F.lit(name).alias("state"), "run_id", "iteration", "ordinal")

    return one("full", ["full"]).unionByName(one("state", ev.FULL_SCOPES))


@FAMILY.add(
    "ev_sign_test",
    oracle(
        """WITH s AS (SELECT run_id,
                 count(*) FILTER (WHERE candidate_assessment = 'GOOD' AND control_assessment <> 'GOOD') AS wins,
                 count(*) FILTER (WHERE candidate_assessment <> 'GOOD' AND control_assessment = 'GOOD') AS losses,
                 count(*) AS n FROM eval_rows GROUP BY 1),
        t AS (SELECT run_id, sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1)
                                     - (wins + losses) * ln(2))) AS p
              FROM (SELECT *, unnest(range(wins, wins + losses + 1)) AS k FROM s) WHERE wins + losses > 0 GROUP BY 1)
        SELECT run_id, true AS valid, wins + losses > 0 AND coalesce(p, 1) <= 0.10 AS passes, wins, losses,
               n - wins - losses AS ties, wins + losses AS discordant,
               CASE WHEN wins + losses = 0 THEN 1.0 ELSE round(p, 9) END AS p_value,
               CASE WHEN wins + losses = 0 THEN 'no_discordant_pairs' WHEN p <= 0.10 THEN 'paired_evidence_passed'
                    ELSE 'insufficient_paired_evidence' END AS reason
        FROM s LEFT JOIN t USING (run_id)""",
        "eval_rows",
    ),
)
def sign_test(i):
    def side(c):
        return i.eval_rows.select("run_id", "question_id", F.col(c).alias("assessment"))

    test = ev.sign_test(side("control_assessment"), side("candidate_assessment"))
    return test.withColumn("p_value", F.round("p_value", 9))


def _gate_inputs(i):
    asked = i.eval_rows.select("run_id", "question_id")
    returned = i.eval_rows.filter("NOT (run_id = 'run3' AND control_assessment = 'BAD')")
    results = returned.select("run_id", "question_id", F.col("candidate_assessment").alias("assessment"))
    runs = asked.groupBy("run_id").agg(F.count("*").alias("num_questions")).select(
        "run_id", "num_questions", F.col("num_questions").alias("num_done"),
        F.when(F.col("run_id") == "run1", "TIMEOUT").otherwise("DONE").alias("status"),
    )
    return runs, asked, results


_GATE = """
  shut AS (SELECT run_id, run_id = 'run1' OR (run_id = 'run3' AND bool_or(control_assessment = 'BAD')) AS closed
           FROM eval_rows GROUP BY 1)"""


@FAMILY.add(
    "ev_fail_closed",
    oracle(
        f"""WITH {_GATE}
        SELECT run_id, NOT closed AS complete,
               CASE WHEN closed THEN 0 ELSE count(*) FILTER (WHERE candidate_assessment = 'GOOD') END AS correct_count,
               CASE WHEN closed THEN 0.0
                    ELSE round(100.0 * count(*) FILTER (WHERE candidate_assessment = 'GOOD') / count(*), 2) END AS accuracy,
               CASE WHEN closed THEN count(*) ELSE count(*) FILTER (WHERE candidate_assessment <> 'GOOD') END AS failures
        FROM eval_rows JOIN shut USING (run_id) GROUP BY run_id, closed""",
        "eval_rows",
    ),
)
def fail_closed(i):
    return ev.completeness_gate(*_gate_inputs(i))


@FAMILY.add(
    "ev_failed_questions",
    oracle(
        f"""WITH {_GATE} SELECT run_id, question_id FROM eval_rows JOIN shut USING (run_id)
        WHERE closed OR candidate_assessment <> 'GOOD'""",
        "eval_rows",
    ),
)
def failed_questions(i):
    runs, asked, results = _gate_inputs(i)
    return ev.failed_questions(ev.completeness_gate(runs, asked, results), asked, results)


@FAMILY.add(
    "ev_reason_counts",
    oracle(
        """SELECT run_id, iteration, reason, count(*) AS n FROM (
             SELECT run_id, iteration, unnest(string_split(coalesce(reasons, assessment), ',')) AS reason
             FROM eval_details WHERE assessment <> 'GOOD') GROUP BY ALL""",
        "eval_details",
    ),
)
def reason_counts(i):
    rows = i.eval_details.withColumn("reasons", F.split("reasons", ","))
    return ev.reason_counts(rows)


_FAMILIES = {1: "Tables & Columns", 2: "Metric Views", 4: "Join Specifications", 5: "Instructions & Examples"}


@FAMILY.add(
    "ev_patch_families",
    oracle(
        """WITH f AS (SELECT CASE question_id % 6 WHEN 1 THEN 'Tables & Columns' WHEN 2 THEN 'Metric Views'
                               WHEN 4 THEN 'Join Specifications' WHEN 5 THEN 'Instructions & Examples'
                               ELSE 'unknown' END AS family, after_sql = '1' AS undone FROM mutations)
           SELECT family, count(*) AS total, count(*) FILTER (WHERE undone) AS rolled_back FROM f GROUP BY 1
           UNION ALL SELECT '(all)', count(*), count(*) FILTER (WHERE undone) FROM f""",
        "mutations",
    ),
)
def patch_families(i):
    name = F.lit(None).cast("string")
    for lever, label in _FAMILIES.items():
        name = F.when(F.col("question_id") % 6 == lever, label).otherwise(name)
    return ev.patch_families(i.mutations.select(name.alias("family"), (F.col("after_sql") == "1").alias("rolled_back")))


_OPS = ["added", "excluded", "removed", "changed", "prune_recommended"]


@FAMILY.add(
    "ev_mutation_counts",
    oracle(
        "SELECT run_id, "
        + ", ".join(f"count(*) FILTER (WHERE op = '{o}') AS {o}" for o in _OPS)
        + """, count(*) AS total FROM mutations m
           WHERE NOT (op = 'changed' AND EXISTS (SELECT 1 FROM question_states s
                                                 WHERE s.question_id = m.question_id AND s.sql_text = m.after_sql))
           GROUP BY 1""",
        "mutations", "question_states",
    ),
)
def mutation_counts(i):
    return ev.mutation_counts(i.mutations, i.question_states, _OPS)


@FAMILY.add(
    "ev_stage_status",
    oracle(
        """SELECT run_id, step,
                  CASE arg_max(status, (started_at, ordinal)) WHEN 'FAILED' THEN 'failed' WHEN 'STARTED' THEN 'running'
                       WHEN 'COMPLETE' THEN 'completed' WHEN 'SKIPPED' THEN 'completed' ELSE 'pending' END AS status,
                  CASE WHEN sum(duration_seconds) > 0 THEN round(sum(duration_seconds), 6) END AS duration_seconds
           FROM stages GROUP BY 1, 2""",
        "stages",
    ),
)
def stage_status(i):
    return ev.stage_status(i.stages)


@FAMILY.add(
    "ev_stale_runs",
    oracle(
        """SELECT run_id, ordinal, started_at FROM stages
           WHERE status IN ('STARTED', 'COMPLETE') AND duration_seconds IS NULL
             AND started_at < TIMESTAMP '2024-01-30 11:50:00'""",
        "stages",
    ),
)
def stale_runs(i):
    runs = i.stages.withColumn("job_id", F.col("duration_seconds"))
    return ev.stale_runs(runs, dt.datetime(2024, 1, 30, 12), ["STARTED", "COMPLETE"]).select(
        "run_id", "ordinal", "started_at"
    )


_LATEST = """
  latest AS (SELECT * FROM scan_results
             QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY scanned_at DESC, ordinal DESC) = 1)"""


@FAMILY.add("ev_latest_score", oracle(f"WITH {_LATEST} SELECT * FROM latest", "scan_results"))
def latest_score(i):
    return ev.latest_scores(i.scan_results)


@FAMILY.add(
    "ev_score_history",
    oracle(
        "SELECT space_id, score, maturity, scanned_at FROM scan_results WHERE scanned_at >= TIMESTAMP '2001-05-03 00:00:00'",
        "scan_results",
    ),
)
def score_history(i):
    return ev.score_history(i.scan_results, dt.date(2001, 8, 1), 90).select("space_id", "score", "maturity", "scanned_at")


@FAMILY.add(
    "ev_dashboard",
    oracle(
        f"""WITH {_LATEST}
        SELECT maturity, count(*) AS agents, round(avg(score), 1) AS avg_score,
               count(*) FILTER (WHERE maturity = 'Not Ready') AS critical FROM latest GROUP BY 1
        UNION ALL SELECT '(all)', count(*), round(avg(score), 1), count(*) FILTER (WHERE maturity = 'Not Ready') FROM latest""",
        "scan_results",
    ),
)
def dashboard(i):
    return ev.dashboard(ev.latest_scores(i.scan_results))


@FAMILY.add(
    "ev_leaderboard",
    oracle(
        f"""WITH {_LATEST}
        (SELECT 'top' AS side, space_id, score, maturity, scanned_at FROM latest ORDER BY score DESC, space_id LIMIT 10)
        UNION ALL
        (SELECT 'bottom', space_id, score, maturity, scanned_at FROM latest ORDER BY score, space_id LIMIT 10)""",
        "scan_results",
    ),
)
def leaderboard(i):
    return ev.leaderboard(ev.latest_scores(i.scan_results), 10)


@FAMILY.add(
    "ev_alerts",
    oracle(
        f"""WITH {_LATEST}
        SELECT space_id, score, CASE WHEN score < 5 THEN 'score below 5' ELSE 'scan ' || CAST(ordinal AS VARCHAR) END
                 AS top_finding
        FROM latest WHERE maturity = 'Not Ready' ORDER BY score, space_id LIMIT 20""",
        "scan_results",
    ),
)
def alerts(i):
    scan = F.concat(F.lit("scan "), F.col("ordinal").cast("string"))
    findings = F.array_compact(F.array(F.when(F.col("score") < 5, F.lit("score below 5")), scan))
    return ev.alerts(ev.latest_scores(i.scan_results).withColumn("findings", findings))


@FAMILY.add(
    "ev_truncate",
    oracle(
        """SELECT ordinal, provenance FROM candidates
           ORDER BY CASE provenance WHEN 'curated' THEN 0 WHEN 'synthetic' THEN 3 WHEN 'coverage_gap_fill' THEN 5
                                    ELSE 6 END, ordinal LIMIT 200""",
        "candidates",
    ),
)
def truncate(i):
    return ev.truncate_by_tier(i.candidates.select("ordinal", "provenance"), 200)


_WORST = """
  worst AS (SELECT question_id, max(CASE disposition WHEN 'passed' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS r
            FROM dispositions GROUP BY 1)"""


@FAMILY.add(
    "ev_dispositions",
    oracle(
        f"""WITH {_WORST} SELECT count(*) FILTER (WHERE r = 0) AS trusted, count(*) FILTER (WHERE r = 1) AS warnings,
               count(*) FILTER (WHERE r = 2) + 3 AS excluded, count(*) + 3 AS total FROM worst""",
        "dispositions",
    ),
)
def dispositions(i):
    return ev.disposition_counts(ev.worst_dispositions(i.dispositions), 3)


@FAMILY.add(
    "ev_disposition_rows",
    oracle(
        f"""WITH {_WORST} SELECT question_id, CASE r WHEN 0 THEN 'passed' WHEN 1 THEN 'warning' ELSE 'excluded' END
                 AS disposition FROM worst""",
        "dispositions",
    ),
)
def disposition_rows(i):
    return ev.worst_dispositions(i.dispositions)


@FAMILY.add(
    "ev_catalogue",
    oracle(
        f"""WITH {_LATEST}
        SELECT d.space_id, title, s.space_id IS NOT NULL AS is_starred, score, maturity, scanned_at
        FROM directory d LEFT JOIN stars s USING (space_id) LEFT JOIN latest USING (space_id)
        WHERE lower(title) LIKE '%agent%' AND score <= 11""",
        "scan_results", "directory", "stars",
    ),
)
def catalogue(i):
    return ev.catalogue(i.directory, ev.latest_scores(i.scan_results), i.stars, search="AGENT", max_score=11)
