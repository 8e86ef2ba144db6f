"""Question families, coverage gaps, deduplication, leakage and statement checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions import minhash_index
from auditframe.functions import text as tx
from auditframe.functions.columns import union_all
from auditframe.functions.patterns import occurrences
from auditframe.functions.ranking import kth_free, number_rows
from auditframe.functions.similarity import best_cosine, best_jaccard, best_jaccard_blocks
from auditframe.functions.storage import written
from auditframe.functions.vector_index import best_in_index, create_index
from auditframe.operators.io import latest_wins

NGRAM_THRESHOLD = 0.60
COSINE_THRESHOLD = 0.85
ECHO_THRESHOLD = 0.85
JOINT_THRESHOLD = 0.75

# Message states, feedback names, recency buckets (days, name, weight),
# retention sources and provenances.
COMPLETED = ["COMPLETED", "QUERY_RESULT_EXPIRED"]
FAILED = ["FAILED"]
NEGATIVE_FEEDBACK = ["NEGATIVE", "THUMBS_DOWN", "DISLIKE"]
RECENCY = [(7, "0_7_days", 1.0), (14, "8_14_days", 0.5), (30, "15_30_days", 0.25), (90, "31_90_days", 0.1)]
USER_SOURCES = ["sample_question", "user", "user_authored"]
CURATED_PROVENANCE = ["curated", "curated_sql_generated"]


# ---- families and coverage gaps ---------------------------------------------


def terminal_messages(messages: DataFrame, unicode: bool = True) -> DataFrame:
    """Finished messages with their family key and failure and feedback flags; blank keys are dropped."""
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    feedback = F.upper(F.trim(F.coalesce("feedback", F.lit(""))))
    return (
        messages.filter(status.isin(COMPLETED + FAILED))
        .withColumn("family", tx.template_key(F.col("content"), unicode))
        .filter("family <> ''")
        .withColumn("failed", status.isin(FAILED))
        .withColumn("negative", feedback.isin(NEGATIVE_FEEDBACK))
    )


def families(terminal: DataFrame) -> DataFrame:
    """Per family: occurrences, distinct users, failures, negative feedback, first and last seen."""
    user = F.when(F.col("user_key") != "", F.col("user_key"))
    return terminal.groupBy("family").agg(
        F.count("*").alias("occurrences"),
        F.countDistinct(user).alias("users"),
        F.count_if("failed").alias("failures"),
        F.count_if("negative").alias("negatives"),
        F.min("created_at").alias("first_seen_at"),
        F.max("created_at").alias("last_seen_at"),
    )


def _covered(corpus: DataFrame, question: str, unicode: bool) -> DataFrame:
    return corpus.select(tx.template_key(F.col(question), unicode).alias("family")).filter("family <> ''").distinct()


def coverage_gaps(fam: DataFrame, corpus: DataFrame, question: str = "question", unicode: bool = True) -> DataFrame:
    """Families that the corpus lacks and that carry a signal, most urgent first."""
    repeat = (F.col("users") >= 2) & (F.col("occurrences") >= 2)
    signals = F.array_compact(
        F.array(
            F.when(F.col("negatives") > 0, F.lit("negative_feedback")),
            F.when(F.col("failures") > 0, F.lit("failed")),
            F.when(repeat, F.lit("cross_user_repeat")),
        )
    )
    return (
        fam.join(_covered(corpus, question, unicode), "family", "left_anti")
        .withColumn("signals", signals)
        .filter(F.size("signals") > 0)
        .orderBy(F.desc("negatives"), F.desc("failures"), F.desc("users"), F.desc("occurrences"), "family")
    )


def gap_evidence(terminal: DataFrame, gaps: DataFrame, limit: int = 3) -> DataFrame:
    """Up to ``limit`` conversations per gap, ranked.

    Order: the first conversations of two different users (for families seen
    by several), the first with negative feedback, the first failed, then the
    rest with negative feedback, failed, and any, each by first appearance.
    Messages are reduced to one row per conversation, written once, before
    anything is ranked.
    """
    convs = (
        terminal.filter("conversation_id <> ''")
        .groupBy("family", "conversation_id")
        .agg(
            F.min("ordinal").alias("seen"),
            F.min_by("user_key", F.when(F.col("user_key") != "", F.col("ordinal"))).alias("user_key"),
            F.min(F.when(F.col("negative"), F.col("ordinal"))).alias("neg"),
            F.min(F.when(F.col("failed"), F.col("ordinal"))).alias("fail"),
        )
        .join(gaps.select("family", F.array_contains("signals", "cross_user_repeat").alias("_repeat")), "family")
    )
    convs = written(convs, "conversations")

    def top(df: DataFrame, order: str, n: int) -> DataFrame:
        w = Window.partitionBy("family").orderBy(order)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)

    def tagged(df: DataFrame, level: Column, order: str) -> DataFrame:
        return df.select("family", "conversation_id", level.alias("level"), F.col(order).alias("at"))

    per_user = latest_wins(convs.filter("_repeat AND user_key IS NOT NULL"), ["family", "user_key"], [F.col("seen")])
    first_else = lambda first, rest: F.when(F.col("_rn") == 1, first).otherwise(rest)
    picks = union_all(
        [
            tagged(top(per_user, "seen", 2), F.lit(0), "seen"),
            tagged(top(convs.filter("neg IS NOT NULL"), "neg", limit), first_else(1, 3), "neg"),
            tagged(top(convs.filter("fail IS NOT NULL"), "fail", limit), first_else(2, 4), "fail"),
            tagged(top(convs, "seen", limit), F.lit(5), "seen"),
        ]
    )
    best = picks.groupBy("family", "conversation_id").agg(F.min(F.struct("level", "at")).alias("_p"))
    w = Window.partitionBy("family").orderBy("_p")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("family", "rank", "conversation_id")


def gap_totals(fam: DataFrame, corpus: DataFrame, question: str = "question", unicode: bool = True) -> DataFrame:
    """One row: messages scanned, families, families the corpus covers."""
    covered = _covered(corpus, question, unicode).withColumn("_c", F.lit(1))
    return fam.join(covered, "family", "left").agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("scanned"),
        F.count("*").alias("families"),
        F.count("_c").alias("covered"),
    )


# ---- deduplication -----------------------------------------------------------


def _retention_order() -> list[Column]:
    valid = (F.trim(F.coalesce("expected_sql", F.lit(""))) != "") & (F.lower(F.trim("validation_status")) == "valid")
    curated = F.lower(F.trim("provenance")).isin(CURATED_PROVENANCE) | (F.upper(F.trim("priority")) == "P0")
    no = F.lit(False)
    return [
        F.coalesce(F.lower(F.trim("source")).isin(USER_SOURCES), no),
        F.coalesce(valid, no),
        F.coalesce(curated, no),
        -F.col("ordinal"),
    ]


def _keyed(rows: DataFrame, prefix: str) -> DataFrame:
    """Add ``_key``: the digest of the normalised question; a blank question is a key of its own."""
    key = tx.question_key(F.col("question"), prefix)
    alone = F.concat(F.lit("blank:"), F.coalesce(F.col("ordinal").cast("string"), F.lit("")))
    return rows.withColumn("_key", F.when(key == "", alone).otherwise(tx.digest(key)))


def dedup_winners(rows: DataFrame, prefix: str = "") -> DataFrame:
    """One row per normalised question, rows with a blank one all kept.

    The winner is user-authored, then valid, then curated or P0, then earliest.
    ``prefix`` is a label that may precede a question. Texts are grouped by
    their digest, so only digests and the selected columns are shuffled.
    """
    return latest_wins(_keyed(rows, prefix), ["_key"], [c.desc() for c in _retention_order()]).drop("_key")


def dedup_rejected(rows: DataFrame, prefix: str = "") -> DataFrame:
    """The losing duplicates with the id of the row kept in their place.

    Winners come from one aggregate per key and are joined back; a hot key is
    one row on that side, so the join can split the other.
    """
    keyed = _keyed(rows, prefix)
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(_retention_order())])
    kept = keyed.groupBy("_key").agg(F.max_by(F.struct("question_id", "ordinal"), order).alias("_w"))
    return (
        keyed.join(kept, "_key")
        .filter(F.col("ordinal") != F.col("_w.ordinal"))
        .withColumn("retained_id", F.col("_w.question_id"))
        .drop("_key", "_w")
    )


def renumber_ids(rows: DataFrame, id_: str = "question_id", ordinal: str = "ordinal", block: int = 1_000_000) -> DataFrame:
    """Make ids unique: the first row of an id keeps it, later ones get ``id:v2``, ``id:v3`` and so on.

    Suffixes that some row already carries are skipped, in one pass: the k-th
    duplicate takes the k-th free number. Ids are compared and named without
    surrounding blanks; blank ids stay as they are. Rows without an ordinal
    come first, in no fixed order among themselves.
    """
    bare = F.coalesce(F.trim(id_), F.lit(""))
    named = rows.withColumn("_id", bare).filter("_id <> ''")
    numbered = number_rows(named, ["_id"], F.floor(F.col(ordinal) / block), [F.asc_nulls_first(ordinal)], "_n")
    pattern = r"^(.*):v(\d{1,18})$"
    # Longer numbers than 18 digits are beyond any count of rows.
    taken = (
        named.filter(F.col("_id").rlike(pattern))
        .select(F.regexp_extract("_id", pattern, 1).alias("_base"), F.regexp_extract("_id", pattern, 2).alias("_digits"))
        # `v02` is a name of its own, which `v2` does not meet.
        .filter(~F.col("_digits").startswith("0"))
        .select(F.col("_base").alias("_id"), F.col("_digits").cast("long").alias("_t"))
        .distinct()
    )
    later = numbered.filter("_n > 1").withColumn("_k", F.col("_n") - 1)
    moved = kth_free(later, taken, ["_id"], "_k", "_t", "_v", start=2)
    moved = moved.withColumn("new_id", F.concat(F.col("_id"), F.lit(":v"), F.col("_v").cast("string"))).drop("_k", "_v")
    first = numbered.filter("_n = 1").withColumn("new_id", F.col("_id"))
    blank = rows.filter(bare == "").withColumn("new_id", F.col(id_))
    return first.unionByName(moved).drop("_n", "_id").unionByName(blank)


# ---- leakage -----------------------------------------------------------------


def exact_leaks(artifacts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Artifacts that are corpus items by id, statement fingerprint or canonical question, with the first reason.

    Artifacts carry (artifact_id, question, sql_text), the corpus (item_id, question, sql_text).
    """
    def keys(c: Column, name: str) -> DataFrame:
        return corpus.select(c.alias(name)).filter(F.col(name) != "").distinct().withColumn(f"_{name}", F.lit(True))

    question = tx.canonical_question(F.col("question"))
    rows = artifacts.select(
        "artifact_id",
        F.trim(F.col("artifact_id").cast("string")).alias("id"),
        tx.statement_fingerprint(F.col("sql_text")).alias("fp"),
        F.when(question == "", "").otherwise(tx.digest(question)).alias("qk"),
    )
    rows = (
        rows.join(keys(F.trim(F.col("item_id").cast("string")), "id"), "id", "left")
        .join(keys(tx.statement_fingerprint(F.col("sql_text")), "fp"), "fp", "left")
        .join(keys(F.when(question == "", "").otherwise(tx.digest(question)), "qk"), "qk", "left")
    )
    reason = F.coalesce(
        F.when(F.col("_id"), F.concat(F.lit("question_id="), F.col("id"))),
        F.when(F.col("_fp"), F.lit("sql_hash")),
        F.when(F.col("_qk"), F.lit("question_text")),
    )
    return rows.select("artifact_id", reason.alias("reason")).filter("reason IS NOT NULL")


def _fields(corpus: DataFrame, own: str, other: str) -> DataFrame:
    """Texts of both corpus fields; the own field ranks first on equal scores."""
    def field(name: str, rank: int) -> DataFrame:
        return corpus.select(
            F.struct(F.lit(rank).alias("field_rank"), F.col("item_id").alias("item_id"), F.lit(name).alias("field")).alias("rank"),
            F.col(name).alias("text"),
        )

    return field(own, 0).unionByName(field(other, 1))


def ngram_matches(
    artifacts: DataFrame, corpus: DataFrame, field: str = "question", threshold: float = NGRAM_THRESHOLD,
    both_fields: bool = True,
) -> DataFrame:
    """Best corpus match of each artifact's ``field`` by character 3-gram Jaccard, over both corpus fields."""
    other = "sql_text" if field == "question" else "question"
    right = _fields(corpus, field, other)
    if not both_fields:
        right = right.filter("rank.field_rank = 0")
    left = artifacts.select("artifact_id", F.col(field).alias("text"))
    best = best_jaccard_blocks(left, right, threshold, "artifact_id", "rank", tx.shingles, right_rank=F.col("rank"))
    return best.select("artifact_id", "match.item_id", "match.field", "score")


def token_matches(artifacts: DataFrame, corpus: DataFrame, threshold: float = ECHO_THRESHOLD) -> DataFrame:
    """Best corpus question of each artifact's question by token-set Jaccard without stopwords."""
    return best_jaccard(artifacts, corpus, threshold, "artifact_id", "item_id", tx.token_set, "question").select(
        "artifact_id", F.col("match").alias("item_id"), "score"
    )


def cosine_matches(artifacts: DataFrame, corpus: DataFrame, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """Best corpus vector of each artifact vector by cosine."""
    return best_cosine(artifacts, corpus, threshold, "artifact_id", "item_id").select(
        "artifact_id", F.col("match").alias("item_id"), "score"
    )


def index_corpus(corpus: DataFrame, path: str) -> None:
    """Write the corpus vectors as an index that later artifacts are matched with, and that ``append_vectors`` extends."""
    create_index(corpus, path, "item_id")


def cosine_indexed(artifacts: DataFrame, path: str, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """As :func:`cosine_matches` from a stored index: exact scores, of the matches that its buckets hold."""
    return best_in_index(artifacts, path, threshold, "artifact_id").select("artifact_id", F.col("match").alias("item_id"), "score")


def index_texts(corpus: DataFrame, path: str, field: str = "question", batch: str = "0") -> None:
    """File a batch of corpus texts of both fields in a MinHash index; of equal scores the own ``field`` ranks first."""
    other = "sql_text" if field == "question" else "question"
    minhash_index.append_texts(_fields(corpus, field, other), path, batch, F.col("rank"), F.col("text"), tx.shingles)


def ngram_indexed(artifacts: DataFrame, path: str, field: str = "question", threshold: float = NGRAM_THRESHOLD) -> DataFrame:
    """As :func:`ngram_matches` from a stored index, which reads no text of the corpus: exact scores, of the matches that share a band."""
    best = minhash_index.best_in_index(artifacts, path, threshold, "artifact_id", field, tx.shingles)
    return best.select("artifact_id", "match.item_id", "match.field", "score")


def leak_decisions(artifacts: DataFrame, corpus: DataFrame, strict: bool = True) -> DataFrame:
    """Block, warn or pass per artifact, with the reason.

    Order: near question and exact statement; question >= 0.75 with statement
    overlap; near question; statement overlap alone, which blocks when strict
    and warns otherwise. Scores below the thresholds that decide are NULL.
    """
    questions = token_matches(artifacts, corpus, JOINT_THRESHOLD).select("artifact_id", F.col("score").alias("question_score"))
    statements = ngram_matches(artifacts, corpus, "sql_text", both_fields=False).select(
        "artifact_id", F.col("score").alias("sql_score")
    )
    known = corpus.select(tx.statement_fingerprint(F.col("sql_text")).alias("fp")).filter("fp <> ''").distinct()
    rows = (
        artifacts.select("artifact_id", "kind", tx.statement_fingerprint(F.col("sql_text")).alias("fp"))
        .join(known.withColumn("_exact", F.lit(True)), "fp", "left")
        .join(questions, "artifact_id", "left")
        .join(statements, "artifact_id", "left")
    )
    exact = F.coalesce("_exact", F.lit(False))
    near = F.coalesce(F.col("question_score") >= ECHO_THRESHOLD, F.lit(False))
    joint = F.col("question_score").isNotNull()
    overlap = exact | F.col("sql_score").isNotNull()
    reason = (
        F.when(near & exact, "exact_question_and_sql")
        .when(joint & overlap, "high_question_and_sql_similarity")
        .when(near, "benchmark_question_echo")
        .when(overlap, "sql_pattern_overlap_strict" if strict else "sql_pattern_overlap_warning")
    )
    blocked = F.col("reason") != "sql_pattern_overlap_warning"
    decision = F.when(F.col("reason").isNull(), "pass").when(blocked, "block").otherwise("warn")
    return rows.select(
        "artifact_id", "kind", reason.alias("reason"), "question_score",
        F.when(exact, F.lit(1.0)).otherwise(F.col("sql_score")).alias("sql_score"),
    ).withColumn("decision", decision)


def leak_counts(artifacts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Artifacts per kind whose statement is a corpus statement or whose texts are near copies of corpus texts."""
    known = corpus.select(tx.statement_fingerprint(F.col("sql_text")).alias("fp")).filter("fp <> ''").distinct()
    same = artifacts.select("artifact_id", tx.statement_fingerprint(F.col("sql_text")).alias("fp")).join(known, "fp", "left_semi")
    leaked = union_all(
        [
            same.select("artifact_id"),
            ngram_matches(artifacts, corpus, "question").select("artifact_id"),
            ngram_matches(artifacts, corpus, "sql_text").select("artifact_id"),
        ]
    ).distinct()
    return artifacts.select("artifact_id", "kind").join(leaked, "artifact_id", "left_semi").groupBy("kind").agg(
        F.count("*").alias("leaks")
    )


# ---- statements --------------------------------------------------------------


def recency(age_days: Column) -> tuple[Column, Column]:
    """(bucket, weight) of an age; NULL beyond the last bucket."""
    bucket, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    for days, name, w in reversed(RECENCY):
        bucket, weight = F.when(age_days <= days, name).otherwise(bucket), F.when(age_days <= days, w).otherwise(weight)
    return bucket, weight


def age_in_days(column: str, as_of: dt.datetime) -> Column:
    seconds = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.col(column))
    return F.greatest(F.lit(0.0), seconds / 86400.0)


def shape_rollup(log: DataFrame, as_of: dt.datetime, statement: str = "statement_text") -> DataFrame:
    """Per statement shape: uses, users, last use and the recency bucket of the newest use."""
    shapes = log.groupBy(tx.shape_hash(F.col(statement)).alias("shape_hash")).agg(
        F.count("*").alias("frequency"),
        F.countDistinct("executed_by").alias("users"),
        F.max("start_time").alias("last_used_at"),
    )
    bucket, weight = recency(age_in_days("last_used_at", as_of))
    return shapes.withColumn("recency_bucket", bucket).withColumn("recency_weight", weight)


def keyword_search(tables: DataFrame, columns: DataFrame, keywords: list[str], limit: int = 20) -> DataFrame:
    """Tables that match a keyword by their own or a column's name or comment, newest first."""
    words = [k.lower() for k in keywords]

    def hit(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            for w in words:
                out = out | F.coalesce(F.contains(F.lower(n), F.lit(w)), F.lit(False))
        return out

    rows = tables.join(columns, "table_name", "left").filter(
        hit("table_name", "table_comment", "column_name", "description")
    )
    column_hit = F.when(hit("column_name", "description"), F.col("column_name"))
    return (
        rows.groupBy("table_name", "table_comment", "last_altered")
        .agg(F.array_sort(F.collect_set(column_hit)).alias("matching_columns"), F.countDistinct("column_name").alias("total_columns"))
        .orderBy(F.desc_nulls_last("last_altered"), "table_name")
        .limit(limit)
    )


def keyword_tables(tables: DataFrame, columns: DataFrame, keywords: DataFrame, limit: int | None = None) -> DataFrame:
    """What ``keyword_search`` finds for each of many keywords, a frame with ``keyword``.

    One row per keyword (in lower case) and table that it matches, with
    ``place`` counting a keyword's tables from the newest; ``limit`` keeps the
    first ones. ``total_columns`` counts all columns where the table itself
    matches and the matching ones elsewhere. ``tables`` has a row per table.
    Every different name and comment is searched once.
    """
    words = keywords.select(F.lower("keyword").alias("pattern"), F.lit(False).alias("whole"))
    sides = [(tables, "table_name"), (tables, "table_comment"), (columns, "column_name"), (columns, "description")]
    texts = [frame.select(F.lower(name).alias("text")) for frame, name in sides]
    found = written(occurrences(union_all(texts), words).select("text", F.col("pattern").alias("keyword")), "keyword-hits")
    hits = [
        frame.withColumn("text", F.lower(name)).join(found, "text").select("keyword", "table_name", "column_name" if frame is columns else F.lit(None).cast("string").alias("column_name"))
        for frame, name in sides
    ]
    totals = columns.groupBy("table_name").agg(F.countDistinct("column_name").alias("_columns"))
    rows = (
        union_all(hits)
        .groupBy("keyword", "table_name")
        .agg(F.array_sort(F.collect_set("column_name")).alias("matching_columns"), F.max(F.col("column_name").isNull()).alias("_own"))
        .join(tables.select("table_name", "table_comment", "last_altered"), "table_name")
        .join(totals, "table_name", "left")
    )
    newest = Window.partitionBy("keyword").orderBy(F.desc_nulls_last("last_altered"), "table_name")
    rows = rows.withColumn("place", F.row_number().over(newest))
    if limit is not None:
        rows = rows.filter(F.col("place") <= limit)
    total = F.when(F.col("_own"), F.coalesce("_columns", F.lit(0))).otherwise(F.size("matching_columns")).cast("long")
    return rows.select("keyword", "place", "table_name", "table_comment", "last_altered", "matching_columns", total.alias("total_columns"))


# What is not code in a statement, and what makes it unstable.
NOT_CODE = r"""(?s)/\*.*?\*/|--[^\n]*|'(?:''|[^'])*+'|`(?:``|[^`])*+`|"(?:""|[^"])*+\""""
RANDOM_CALL = r"(?i)\b(?:rand|random|randn|uuid|monotonically_increasing_id)\s*\("
SAMPLING = r"(?i)\btablesample\s*\(|\bsample\s+(?:bernoulli|system)\b"
CLOCK = r"(?i)\b(?:current_date|current_timestamp|localtimestamp|now|curdate)\b"


def _unordered_limit(code: Column) -> Column:
    """LIMIT without ORDER BY since the last SELECT of the same scope.

    Clause words and parentheses are read once, in order, whatever the depth.
    ``open`` has one letter for each scope that is open, the innermost last:
    whether an ORDER BY has been seen since its last SELECT.
    """
    words = F.transform(F.regexp_extract_all(code, F.lit(r"(?i)(\bSELECT\b|\bORDER\s+BY\b|\bLIMIT\b|[()])"), F.lit(1)), lambda w: F.upper(F.substring(w, 1, 1)))
    outer = lambda a: F.substring(a["open"], F.lit(1), F.length(a["open"]) - 1)

    def step(acc: Column, w: Column) -> Column:
        scopes = (
            F.when(w == "(", F.concat(acc["open"], F.lit("n")))
            .when(w == ")", F.when(F.length(acc["open"]) > 1, outer(acc)).otherwise(acc["open"]))
            .when(w == "S", F.concat(outer(acc), F.lit("n")))
            .when(w == "O", F.concat(outer(acc), F.lit("y")))
            .otherwise(acc["open"])
        )
        return F.struct(scopes.alias("open"), (acc["found"] | ((w == "L") & acc["open"].endswith("n"))).alias("found"))

    start = F.struct(F.lit("n").alias("open"), F.lit(False).alias("found"))
    return F.aggregate(words, start, step, lambda acc: acc["found"])


def statement_findings(statements: DataFrame, statement: str = "expected_sql", key: str = "question_id") -> DataFrame:
    """(key, code, severity) for statements whose result can change from run to run."""
    prepared = statements.filter(F.trim(statement) != "").select(
        key, F.regexp_replace(statement, NOT_CODE, " ").alias("_code")
    )
    code = F.col("_code")
    finding = lambda c, s: F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))
    rules = [
        (code.rlike(r"(?i)\bLIMIT\b") & _unordered_limit(code), finding("UNORDERED_LIMIT", "error")),
        (code.rlike(RANDOM_CALL) | code.rlike(SAMPLING), finding("NONDETERMINISTIC_SQL", "error")),
        (code.rlike(CLOCK), finding("VOLATILE_TIME_REFERENCE", "warning")),
    ]
    found = F.array_compact(F.array(*[F.when(cond, f) for cond, f in rules]))
    return prepared.select(key, F.explode(found).alias("_f")).select(key, "_f.*")


# Question formats, the categories that imply one, and their patterns
# (question pattern, statement pattern).
CATEGORY_FORMAT = {
    "aggregation": "aggregation",
    "detail": "lookup",
    "list": "lookup",
    "comparison": "comparison",
    "time-series": "time_filter",
    "ranking": "top_n",
}
FORMAT_PATTERNS = {
    "aggregation": (r"\b(total|sum|average|avg|count|how many|by each|per)\b", r"\b(sum|avg|count|min|max)\s*\("),
    "lookup": (r"\b(what is|which|show me|find|status of|details? for)\b", None),
    "comparison": (r"\b(compare|versus|vs\.?|difference|higher than|lower than)\b", None),
    "time_filter": (
        r"\b(ytd|year.to.date|last|this (?:week|month|quarter|year)|between|since|before|after)\b",
        r"\b(date|timestamp|interval|year|month|quarter)\b",
    ),
    "top_n": (r"\b(top|bottom|highest|lowest|rank(?:ed|ing)?)\b", None),
}


def format_coverage(questions: DataFrame) -> DataFrame:
    """Per required question format: how many corpus questions have it, their share, whether it is missing."""
    question = F.lower(F.coalesce("question", F.lit("")))
    sql = F.lower(F.coalesce("expected_sql", F.lit("")))
    category = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    flags = {}
    for name, (in_question, in_sql) in FORMAT_PATTERNS.items():
        flag = question.rlike(in_question) | category.isin([c for c, f in CATEGORY_FORMAT.items() if f == name])
        if in_sql:
            flag = flag | sql.rlike(in_sql)
        if name == "top_n":
            flag = flag | (sql.contains("limit") & sql.contains("order by"))
        flags[name] = flag
    row = questions.agg(F.count("*").alias("total"), *[F.count_if(f).alias(n) for n, f in flags.items()])
    cells = [F.struct(F.lit(n).alias("format"), F.col(n).alias("n")) for n in flags]
    share = F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))
    return (
        row.select("total", F.explode(F.array(*cells)).alias("_c"))
        .select("_c.*", "total")
        .select("format", "n", F.round(share, 4).alias("share"), (F.col("n") == 0).alias("missing"))
    )


def rule_findings(rows: DataFrame, rules: list[dict], key: str = "question_id") -> DataFrame:
    """(key, rule, issue): the statement names a rule's column, the question none of the rule's terms.

    Each rule is ``{"name", "column", "terms", "issue"}``; ``issue`` may hold ``{column}``.
    """
    question = F.lower(F.coalesce("question", F.lit("")))
    sql = F.lower(F.coalesce("expected_sql", F.lit("")))
    found = []
    for r in rules:
        meant = F.lit(False)
        for term in r["terms"]:
            meant = meant | question.contains(term.lower())
        issue = r["issue"].format(column=r["column"])
        cell = F.struct(F.lit(r["name"]).alias("rule"), F.lit(issue).alias("issue"))
        found.append(F.when(sql.contains(r["column"].lower()) & ~meant, cell))
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(key, "_f.*")


def rule_findings_of(rows: DataFrame, rules: DataFrame, key: str = "question_id") -> DataFrame:
    """``rule_findings`` for any number of rules, a frame with ``name``, ``column``, ``terms`` and ``issue``.

    Statements and rule columns meet as relations; only a rule whose column a
    statement names looks for its terms in the question. A rule without terms
    is met by the column alone.
    """
    asked = rows.select(
        key, F.lower(F.coalesce("question", F.lit(""))).alias("_question"), F.lower(F.coalesce("expected_sql", F.lit(""))).alias("_sql")
    )
    named = rules.withColumn("_column", F.lower("column"))
    found = occurrences(
        asked.select(F.col("_sql").alias("text")), named.select(F.col("_column").alias("pattern"), F.lit(False).alias("whole"))
    ).select(F.col("text").alias("_sql"), F.col("pattern").alias("_column"))
    meant = F.exists("terms", lambda t: F.contains(F.col("_question"), F.lower(t)))
    return (
        asked.join(found, "_sql")
        .join(named, "_column")
        .filter(~F.coalesce(meant, F.lit(False)))
        .select(key, F.col("name").alias("rule"), F.replace("issue", F.lit("{column}"), "column").alias("issue"))
    )


# Shapes that make a line a statement, imperative openings of prose,
# clause words and signs of structure.
SQL_ANCHORS = [
    r"(?i)\bSELECT\b[^.]*?\bFROM\b",
    r'(?i)\bFROM\s+[`"\w.]+\s+(?:AS\s+\w+|WHERE|JOIN|GROUP|ORDER|HAVING|LIMIT)\b',
    r'(?i)\bJOIN\s+[`"\w.]+\s+ON\b',
    r'(?i)\bWHERE\s+[`"\w.]+\s*(?:=|<>|!=|<=|>=|<|>|\bLIKE\b|\bIN\s*\()',
    r'(?i)\bGROUP\s+BY\s+[`"\w.]+(?:\s*,\s*[`"\w.]+)*\s+(?:\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b)',
    r'(?i)\bORDER\s+BY\s+[`"\w.]+(?:\s*,\s*[`"\w.]+)*\s+(?:\bASC\b|\bDESC\b|\bLIMIT\b)',
    r"(?i)\bHAVING\s+(?:SUM|COUNT|AVG|MAX|MIN|STDDEV|VARIANCE)\s*\(",
]
PROSE_OPENING = (
    r"(?i)^\s*[-*•]?\s*(?:Do\s+not|Do\s+NOT|Don['’]t|Never|Always|When|If|Prefer|Avoid|Combine|Link|Pair"
    r"|Associate|Consider|Note)\b"
)
CLAUSE_WORD = r"(?i)\b(SELECT|WHERE|JOIN|GROUP\s+BY|ORDER\s+BY|HAVING)\b"
SQL_STRUCTURE = [
    r'(?i)[`"]?\w+[`"]?\.[`"]?\w+[`"]?',
    r"(?i)(?:=|<>|!=|<=|>=|\bLIKE\b|\bIN\s*\(|\bBETWEEN\s+\w+)",
    r"(?i)\b(?:SUM|COUNT|AVG|MAX|MIN|STDDEV|VARIANCE)\s*\(",
    r"(?i)\bIS\s+(?:NOT\s+)?NULL\b",
]


def looks_like_sql(line: Column) -> Column:
    """A line with the shape of a statement, or with two clause words and structure and no prose opening."""
    anchored = F.lit(False)
    for p in SQL_ANCHORS:
        anchored = anchored | line.rlike(p)
    structured = F.lit(False)
    for p in SQL_STRUCTURE:
        structured = structured | line.rlike(p)
    words = F.transform(F.regexp_extract_all(line, F.lit(CLAUSE_WORD), F.lit(1)), F.upper)
    dense = (F.size(F.array_distinct(words)) >= 2) & structured & ~line.rlike(PROSE_OPENING)
    return anchored | dense


def sql_in_prose(texts: DataFrame, text: str = "body", key: str = "doc_id") -> DataFrame:
    """(key, line_no, line): lines of prose that look like statements."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "line"))
    return lines.filter(looks_like_sql(F.col("line"))).select(key, (F.col("pos") + 1).alias("line_no"), "line")
