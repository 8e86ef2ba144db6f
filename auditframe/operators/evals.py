"""Evaluation-run analytics: accuracy, baselines, champions, attempts, paired tests, rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.ranking import kth_free, number_rows
from auditframe.functions.stats import sign_tail_column
from auditframe.operators.io import latest_wins

DRIFT_POINTS = 0.5
SIGN_TEST_THRESHOLD = 0.10
STALE_MINUTES = 10

# Scopes that evaluate the whole corpus; step names of stage states;
# provenance tiers in order of retention; texts read as true; good assessments.
FULL_SCOPES = ["full", "enrichment"]
STEP_STATUS = {
    "FAILED": "failed", "COMPLETE": "completed", "SKIPPED": "completed", "ROLLED_BACK": "completed", "STARTED": "running",
}
PROVENANCE_TIERS = ["curated", "curated_sql_generated", "reused", "synthetic", "auto_corrected", "coverage_gap_fill"]
TRUE_TEXTS = ["true", "t", "1", "yes", "y"]
GOOD_ASSESSMENTS = ["GOOD", "YES", "BOTH_CORRECT"]


def truthy(df: DataFrame, name: str) -> Column:
    """A flag that may be stored as a boolean, number or text; NULL is false."""
    if df.schema[name].dataType.typeName() == "string":
        flag = F.lower(F.trim(name)).isin(TRUE_TEXTS)
    else:
        flag = F.col(name).cast("boolean")
    return F.coalesce(flag, F.lit(False))


def _scope() -> Column:
    return F.lower(F.coalesce("eval_scope", F.lit("full")))


def _day(column: str = "event_ts") -> Column:
    return F.unix_date(F.to_date(column))


def with_accuracy(iterations: DataFrame) -> DataFrame:
    """Add ``accuracy``: percent correct of the evaluated, or the stored value when none were evaluated."""
    evaluated = F.expr("try_cast(evaluated_count AS INT)")
    correct = F.coalesce(F.expr("try_cast(correct_count AS INT)"), F.lit(0))
    stored = F.expr("try_cast(overall_accuracy AS DOUBLE)")
    derived = F.round(F.lit(100.0) * correct / evaluated, 2)
    return iterations.withColumn("accuracy", F.when(evaluated > 0, derived).otherwise(stored))


def accuracy_drift(iterations: DataFrame, points: float = DRIFT_POINTS) -> DataFrame:
    """Rows whose stored accuracy is more than ``points`` away from the derived one."""
    rows = with_accuracy(iterations).withColumn("drift", F.col("accuracy") - F.col("overall_accuracy"))
    return rows.filter(F.abs("drift") > points)


def run_scores(iterations: DataFrame) -> DataFrame:
    """Baseline and best score per run, in one aggregate.

    The baseline is the earliest full iteration-0 row, rolled back or not.
    Candidates are the other full rows and the iteration-0 enrichment rows that
    were not rolled back; the best must beat the baseline strictly. The
    baseline row may sit among the candidates: it cannot beat itself. A run
    without a baseline has no scores.
    """
    rows = with_accuracy(iterations)
    scope, it = _scope(), F.col("iteration")
    full, zero = scope == "full", it == 0
    candidate = (
        ~truthy(iterations, "rolled_back")
        & F.col("accuracy").isNotNull()
        & ((full & (it >= 0)) | ((scope == "enrichment") & zero))
    )
    is_enrichment = zero.cast("int")
    rank = F.struct(F.col("accuracy").alias("acc"), (-it).alias("it"), (-is_enrichment).alias("enr"))
    per = rows.groupBy("run_id").agg(
        F.min_by("accuracy", F.when(full & zero, F.struct("event_ts", "ordinal"))).alias("baseline"),
        F.max(F.when(candidate, rank)).alias("_best"),
    )
    scored = F.col("baseline").isNotNull()
    wins = scored & F.coalesce(F.col("_best.acc") > F.col("baseline"), F.lit(False))
    scope_name = F.when(F.col("_best.enr") < 0, "enrichment").otherwise("full")
    return per.select(
        "run_id",
        "baseline",
        F.when(wins, F.col("_best.acc")).otherwise(F.col("baseline")).alias("optimized"),
        F.when(scored, 0).alias("baseline_iteration"),
        F.when(wins, -F.col("_best.it")).when(scored, 0).alias("best_iteration"),
        F.when(wins, scope_name).when(scored, "full").alias("best_eval_scope"),
    )


def champion(iterations: DataFrame) -> DataFrame:
    """The champion row per run by stored accuracy.

    Full rows go before all others; then flagged rows; then rows that were not
    rolled back or are the iteration-0 full baseline; then accuracy; then input
    order. One lexicographic order replaces the three fallbacks.
    """
    full = _scope() == "full"
    flagged = truthy(iterations, "is_champion")
    eligible = flagged | ~truthy(iterations, "rolled_back") | (full & (F.col("iteration") == 0))
    order = [
        full.desc(), flagged.desc(), eligible.desc(),
        F.coalesce("overall_accuracy", F.lit(0.0)).desc(), F.col("ordinal").asc(),
    ]
    return latest_wins(iterations, ["run_id"], order)


def _baseline_time(rows: DataFrame) -> DataFrame:
    """run_id -> first (time, ordinal, accuracy) of the full iteration-0 rows."""
    zero = (_scope() == "full") & (F.col("iteration") == 0)
    first = F.min(F.struct("event_ts", "ordinal", "overall_accuracy"))
    return rows.filter(zero).groupBy("run_id").agg(first.alias("_base"))


def attempts(iterations: DataFrame) -> DataFrame:
    """One row per attempt: the last row of each numbered attempt, then recovered re-entry baselines.

    Full iteration-0 rows without an attempt number that are later than the
    first are real evaluations; they take the numbers after the largest one.
    At most one attempt keeps the champion flag, none if the baseline is best.
    """
    attempt = F.coalesce(F.expr("try_cast(attempt_no AS INT)"), F.lit(0))
    rows = iterations.filter(_scope().isin(FULL_SCOPES)).withColumn("attempt_no", attempt).withColumn(
        "is_champion", truthy(iterations, "is_champion")
    )
    numbered = latest_wins(
        rows.filter("attempt_no <> 0"),
        ["run_id", "attempt_no"],
        [F.desc("iteration"), F.desc("event_ts"), F.asc("ordinal")],
    ).withColumn("recovered", F.lit(False))
    zero = rows.filter((F.col("attempt_no") == 0) & (F.col("iteration") == 0) & (_scope() == "full"))
    base = zero.groupBy("run_id").agg(
        F.min(F.struct("event_ts", "ordinal")).alias("_b"),
        F.min_by(F.struct("overall_accuracy", "is_champion"), F.struct("event_ts", "ordinal")).alias("_base"),
    )
    later = zero.join(base.select("run_id", "_b"), "run_id").filter(F.col("event_ts") > F.col("_b.event_ts")).drop("_b")
    top = numbered.groupBy("run_id").agg(F.max("attempt_no").alias("_top"))
    recovered = (
        number_rows(later, ["run_id"], _day(), [F.col("event_ts"), F.col("ordinal")], "_k")
        .join(top, "run_id", "left")
        .withColumn("attempt_no", (F.coalesce("_top", F.lit(0)) + F.col("_k")).cast("int"))
        .drop("_k", "_top")
        .withColumn("recovered", F.lit(True))
    )
    all_rows = numbered.unionByName(recovered)
    acc = F.coalesce("overall_accuracy", F.lit(0.0))
    pool = all_rows.filter("is_champion").select("run_id", "attempt_no", acc.alias("acc")).unionByName(
        base.filter("_base.is_champion").select(
            "run_id", F.lit(0).alias("attempt_no"), F.coalesce("_base.overall_accuracy", F.lit(0.0)).alias("acc")
        )
    )
    best = pool.groupBy("run_id").agg(F.max(F.struct("acc", -F.col("attempt_no"))).alias("_c"))
    winner = best.select("run_id", (-F.col("_c.col2")).alias("_winner"))
    return (
        all_rows.join(winner, "run_id", "left")
        .withColumn("is_champion", F.coalesce(F.col("attempt_no") == F.col("_winner"), F.lit(False)))
        .drop("_winner")
    )


def trajectory(iterations: DataFrame) -> DataFrame:
    """Every evaluation with its accuracy change against the run's baseline.

    The baseline is the earliest full iteration-0 row. Later ones without an
    attempt number take the smallest numbers no other row uses, in order.
    """
    attempt = F.expr("try_cast(attempt_no AS INT)")
    rows = iterations.withColumn("attempt_no", attempt)
    base = _baseline_time(rows)
    marked = rows.join(base, "run_id", "left").withColumn(
        "is_baseline", F.coalesce(F.col("ordinal") == F.col("_base.ordinal"), F.lit(False))
    )
    unnumbered = F.coalesce("attempt_no", F.lit(0)) == 0
    recovered = ~F.col("is_baseline") & (_scope() == "full") & (F.col("iteration") == 0) & unnumbered
    marked = marked.withColumn("_rec", recovered)

    rec = number_rows(
        marked.filter("_rec"), ["run_id"], F.coalesce("attempt_no", F.lit(-1)) * 1_000_000 + F.coalesce(_day(), F.lit(0)),
        [F.col("attempt_no").asc_nulls_first(), F.col("event_ts"), F.col("ordinal")], "_k",
    )
    taken = marked.select("run_id", F.col("attempt_no").alias("_taken"))
    rec = kth_free(rec, taken, ["run_id"], "_k", "_taken", "_new").drop("_k")
    out = marked.filter("NOT _rec").withColumn("_new", F.lit(None).cast("int")).unionByName(rec)
    return out.select(
        "run_id", "ordinal", "iteration", "eval_scope", "event_ts",
        F.when(F.col("is_baseline"), F.lit(None)).otherwise(F.coalesce("_new", "attempt_no")).alias("attempt_no"),
        "is_baseline",
        F.col("overall_accuracy").alias("accuracy"),
        F.round(F.col("overall_accuracy") - F.col("_base.overall_accuracy"), 2).alias("delta_vs_baseline"),
        truthy(iterations, "rolled_back").alias("rolled_back"),
    )


def latest_state(iterations: DataFrame, scopes: list[str] | None = None, include_rolled_back: bool = False) -> DataFrame:
    """The newest row per run of the given scopes, rolled-back rows excluded."""
    rows = iterations.filter(F.col("eval_scope").isin(scopes or FULL_SCOPES))
    if not include_rolled_back:
        rows = rows.filter(~truthy(iterations, "rolled_back"))
    return latest_wins(rows, ["run_id"], [F.desc("iteration"), F.desc("event_ts"), F.desc("ordinal")])


def sign_test(
    control: DataFrame, candidate: DataFrame, threshold: float = SIGN_TEST_THRESHOLD
) -> DataFrame:
    """Paired one-sided sign test per run on (run_id, question_id, assessment) rows.

    Fails closed: a side without rows, a missing or repeated id, an unscored
    row or differing id sets give ``valid = false`` and p = 1. Only GOOD counts
    as good. Both sides meet in one aggregate by question, not in a join.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        label = F.upper(F.trim("assessment"))
        scored = F.when(label == "GOOD", True).when(label.isin("BAD", "NEEDS_REVIEW"), False)
        return df.select("run_id", F.col("question_id").cast("string").alias("id"), scored.alias("good"), F.lit(name).alias("side"))

    rows = side(control, "a").unionByName(side(candidate, "b"))
    a, b = F.col("side") == "a", F.col("side") == "b"
    per_question = rows.groupBy("run_id", "id").agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
        F.max(F.when(a, F.col("good"))).alias("g_a"), F.max(F.when(b, F.col("good"))).alias("g_b"),
        F.count_if(F.col("good").isNull()).alias("unscored"),
    )
    no_id = F.col("id").isNull() | (F.trim("id") == "")
    paired = F.col("g_a").isNotNull() & F.col("g_b").isNotNull()
    per_run = per_question.groupBy("run_id").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"),
        F.count_if(no_id).alias("no_id"),
        F.count_if((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("repeated"),
        F.sum("unscored").alias("unscored"),
        F.count_if((F.col("n_a") == 0) | (F.col("n_b") == 0)).alias("unmatched"),
        F.count_if(paired & F.col("g_b") & ~F.col("g_a")).alias("wins"),
        F.count_if(paired & F.col("g_a") & ~F.col("g_b")).alias("losses"),
        F.count_if(paired & (F.col("g_a") == F.col("g_b"))).alias("ties"),
    )
    error = (
        F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "missing_rows")
        .when(F.col("no_id") > 0, "missing_question_id")
        .when(F.col("repeated") > 0, "duplicate_question_id")
        .when(F.col("unscored") > 0, "unscored_row")
        .when(F.col("unmatched") > 0, "question_id_mismatch")
    )
    checked = per_run.withColumn("_error", error).withColumn("valid", F.col("_error").isNull())
    for name in ("wins", "losses", "ties"):
        checked = checked.withColumn(name, F.when(F.col("valid"), F.col(name)).otherwise(F.lit(0)))
    checked = checked.withColumn("discordant", F.col("wins") + F.col("losses"))
    tested = checked.withColumn("p_value", sign_tail_column("wins", "discordant"))
    passes = F.col("valid") & (F.col("discordant") > 0) & (F.col("p_value") <= threshold)
    reason = (
        F.when(~F.col("valid"), F.col("_error"))
        .when(F.col("discordant") == 0, "no_discordant_pairs")
        .when(passes, "paired_evidence_passed")
        .otherwise("insufficient_paired_evidence")
    )
    return tested.select(
        "run_id", "valid", passes.alias("passes"), "wins", "losses", "ties", "discordant", "p_value", reason.alias("reason")
    )


def completeness_gate(runs: DataFrame, requested: DataFrame, results: DataFrame) -> DataFrame:
    """Score evaluation runs, failing partial ones closed.

    ``runs`` is (run_id, status, num_questions, num_done). A run that is not
    DONE, done in part, empty or short of rows scores 0 and fails every
    requested question; a complete one is scored by its rows.
    """
    got = results.groupBy("run_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.upper("assessment") == "GOOD").alias("n_good")
    )
    asked = requested.groupBy("run_id").agg(F.countDistinct("question_id").alias("n_requested"))
    rows = runs.join(got, "run_id", "left").join(asked, "run_id", "left").fillna(0, ["n_rows", "n_good", "n_requested"])
    complete = (
        (F.col("status") == "DONE")
        & (F.col("num_questions") > 0)
        & (F.col("num_done") >= F.col("num_questions"))
        & (F.col("n_rows") >= F.col("num_questions"))
    )
    return rows.withColumn("complete", F.coalesce(complete, F.lit(False))).select(
        "run_id", "complete",
        F.when(F.col("complete"), F.col("n_good")).otherwise(F.lit(0)).alias("correct_count"),
        F.when(F.col("complete"), F.round(F.col("n_good") * 100.0 / F.col("n_rows"), 2)).otherwise(F.lit(0.0)).alias("accuracy"),
        F.when(F.col("complete"), F.col("n_rows") - F.col("n_good")).otherwise(F.col("n_requested")).alias("failures"),
    )


def failed_questions(gate: DataFrame, requested: DataFrame, results: DataFrame) -> DataFrame:
    """The failed question ids behind :func:`completeness_gate`: all requested ones of an incomplete run."""
    flags = gate.select("run_id", "complete")
    bad = results.filter(F.upper("assessment") != "GOOD").select("run_id", "question_id")
    closed = requested.select("run_id", "question_id").join(flags.filter("NOT complete"), "run_id", "left_semi")
    open_ = bad.join(flags.filter("complete"), "run_id", "left_semi")
    return closed.unionByName(open_).distinct()


def reason_counts(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    """Failure reasons per run and iteration; a failure without reasons counts under its assessment."""
    label = F.upper(F.trim(F.coalesce("assessment", F.lit("UNKNOWN_ASSESSMENT"))))
    default = F.when(label == "UNKNOWN_ASSESSMENT", "UNSPECIFIED_FAILURE").otherwise(label)
    listed = F.when(F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0, F.col(reasons)).otherwise(F.array(default))
    return (
        rows.filter(~label.isin(GOOD_ASSESSMENTS))
        .select("run_id", "iteration", F.explode(listed).alias("reason"))
        .groupBy("run_id", "iteration", "reason")
        .agg(F.count("*").alias("n"))
    )


def patch_families(patches: DataFrame, family: str = "family") -> DataFrame:
    """Changes and rolled-back changes per family and in total (``(all)``)."""
    return (
        patches.withColumn("family", F.coalesce(F.col(family), F.lit("unknown")))
        .rollup("family")
        .agg(F.count("*").alias("total"), F.count_if("rolled_back").alias("rolled_back"))
        .withColumn("family", F.coalesce("family", F.lit("(all)")))
    )


def mutation_counts(mutations: DataFrame, states: DataFrame, ops: list[str]) -> DataFrame:
    """Ledger entries per run and operation; a change whose SQL equals the recorded state is no change."""
    op = F.lower(F.trim(F.coalesce("op", F.lit(""))))
    known = states.select("question_id", F.trim(F.coalesce("sql_text", F.lit(""))).alias("_was"))
    same = (op == "changed") & F.coalesce(F.col("_was") == F.trim("after_sql"), F.lit(False))
    kept = mutations.join(known, "question_id", "left").filter(~same)
    return kept.groupBy("run_id").agg(
        *[F.count_if(op == o).alias(o) for o in ops], F.count("*").alias("total")
    )


def stage_status(stages: DataFrame) -> DataFrame:
    """Per run and step: the status of its last stage row and the summed duration (NULL unless positive)."""
    last = F.upper(F.max_by("status", F.struct("started_at", "ordinal")))
    per = stages.groupBy("run_id", "step").agg(last.alias("_last"), F.sum("duration_seconds").alias("_sum"))
    status = F.lit("pending")
    for raw, name in STEP_STATUS.items():
        status = F.when(F.col("_last") == raw, name).otherwise(status)
    return per.select(
        "run_id", "step", status.alias("status"), F.when(F.col("_sum") > 0, F.round("_sum", 6)).alias("duration_seconds")
    )


def stale_runs(runs: DataFrame, as_of: dt.datetime, active: list[str], minutes: int = STALE_MINUTES) -> DataFrame:
    """Active runs without a job that started more than ``minutes`` before ``as_of``."""
    return runs.filter(F.col("status").isin(active) & F.col("job_id").isNull()).filter(
        F.col("started_at") < F.lit(as_of - dt.timedelta(minutes=minutes))
    )


def latest_scores(scans: DataFrame) -> DataFrame:
    """The newest scan per agent."""
    return latest_wins(scans, ["space_id"], [F.desc("scanned_at"), F.desc("ordinal")])


def score_history(scans: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Scans of the last ``days`` days, oldest first per agent."""
    start = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days)
    return scans.filter(F.col("scanned_at") >= F.lit(start)).orderBy("space_id", "scanned_at", "ordinal")


def dashboard(latest: DataFrame) -> DataFrame:
    """Per maturity and in total: agents, mean score, agents not ready."""
    return (
        latest.withColumn("maturity", F.coalesce("maturity", F.lit("Unknown")))
        .rollup("maturity")
        .agg(
            F.count("*").alias("agents"),
            F.round(F.avg("score"), 1).alias("avg_score"),
            F.count_if(F.col("maturity") == "Not Ready").alias("critical"),
        )
        .withColumn("maturity", F.coalesce("maturity", F.lit("(all)")))
    )


def leaderboard(latest: DataFrame, n: int = 10) -> DataFrame:
    """The n best and n worst agents; ties by id."""
    def side(name: str, *order: Column) -> DataFrame:
        return latest.orderBy(*order).limit(n).select(F.lit(name).alias("side"), "space_id", "score", "maturity", "scanned_at")

    return side("top", F.desc("score"), F.asc("space_id")).unionByName(side("bottom", F.asc("score"), F.asc("space_id")))


def alerts(latest: DataFrame, n: int = 20) -> DataFrame:
    """The lowest agents that are not ready, with their first finding."""
    first = F.get(F.coalesce("findings", F.array().cast("array<string>")), 0)
    return (
        latest.filter("maturity = 'Not Ready'")
        .select("space_id", "score", first.alias("top_finding"))
        .orderBy("score", "space_id")
        .limit(n)
    )


def truncate_by_tier(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by provenance tier, input order kept inside a tier."""
    tier = F.lit(len(PROVENANCE_TIERS))
    for k, name in enumerate(PROVENANCE_TIERS):
        tier = F.when(F.col("provenance") == name, k).otherwise(tier)
    return rows.orderBy(tier, "ordinal").limit(n)


def worst_dispositions(rows: DataFrame) -> DataFrame:
    """The final disposition per question: the worst of its rows; unknown ones are ignored."""
    rank = F.when(F.col("disposition") == "passed", 0).when(F.col("disposition") == "warning", 1).when(
        F.col("disposition") == "excluded", 2
    )
    worst = rows.withColumn("_r", rank).filter("_r IS NOT NULL").groupBy("question_id").agg(F.max("_r").alias("_r"))
    return worst.select("question_id", F.element_at(F.array(*map(F.lit, ["passed", "warning", "excluded"])), F.col("_r") + 1).alias("disposition"))


def disposition_counts(final: DataFrame, additional_excluded: int = 0) -> DataFrame:
    counts = final.agg(
        F.count_if(F.col("disposition") == "passed").alias("trusted"),
        F.count_if(F.col("disposition") == "warning").alias("warnings"),
        (F.count_if(F.col("disposition") == "excluded") + max(0, additional_excluded)).alias("excluded"),
    )
    return counts.withColumn("total", F.col("trusted") + F.col("warnings") + F.col("excluded"))


def catalogue(
    directory: DataFrame, latest: DataFrame, stars: DataFrame, search: str | None = None,
    starred_only: bool = False, min_score: int | None = None, max_score: int | None = None,
) -> DataFrame:
    """Agents with their newest score, filtered; starred first, then by score, unscored last."""
    starred = stars.select("space_id").distinct().withColumn("is_starred", F.lit(True))
    rows = directory
    if search:
        rows = rows.filter(F.contains(F.lower("title"), F.lit(search.lower())))
    rows = rows.join(starred, "space_id", "left_semi" if starred_only else "left")
    flag = F.lit(True) if starred_only else F.coalesce("is_starred", F.lit(False))
    rows = rows.withColumn("is_starred", flag).join(
        latest.select("space_id", "score", "maturity", "scanned_at"), "space_id", "left"
    )
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    if max_score is not None:
        rows = rows.filter(F.col("score") <= max_score)
    return rows.orderBy(F.desc("is_starred"), F.desc_nulls_last("score"), "space_id")
