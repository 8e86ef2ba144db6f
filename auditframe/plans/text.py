"""Text family, deduplication, leakage and statement queries."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from auditframe.functions import text as fx
from auditframe.functions.storage import session_folder
from auditframe.functions.vector_index import append_vectors
from auditframe.operators import text as t
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()
AS_OF = dt.datetime(2024, 2, 5)

_KEY = r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(lower({0}),
            '\b[0-9]+\b', ' numberliteral ', 'g'), '\s+', ' ', 'g')), '[?!.]+$', ''))"""
_TERMINAL = f"""
  done AS (SELECT *, {_KEY.format('content')} AS family, status = 'FAILED' AS failed, feedback IS NOT NULL AS negative
           FROM messages WHERE status IN ('COMPLETED', 'QUERY_RESULT_EXPIRED', 'FAILED')),
  fam AS (SELECT family, count(*) AS occurrences, count(DISTINCT nullif(user_key, '')) AS users,
                 count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE negative) AS negatives,
                 min(created_at) AS first_seen_at, max(created_at) AS last_seen_at
          FROM done GROUP BY 1),
  known AS (SELECT DISTINCT {_KEY.format('question')} AS family FROM corpus_questions),
  gaps AS (SELECT *, concat_ws(',', CASE WHEN negatives > 0 THEN 'negative_feedback' END,
                               CASE WHEN failures > 0 THEN 'failed' END,
                               CASE WHEN users >= 2 THEN 'cross_user_repeat' END) AS signals
           FROM fam WHERE family NOT IN (SELECT family FROM known))"""


def _terminal(i):
    return t.terminal_messages(i.messages, unicode=False)


def _gaps(i):
    return t.coverage_gaps(t.families(_terminal(i)), i.corpus_questions, unicode=False)


@FAMILY.add("tx_template_key", oracle(f"SELECT ordinal, {_KEY.format('content')} AS family FROM messages", "messages"))
def template_key(i):
    return i.messages.select("ordinal", fx.template_key(F.col("content"), unicode=False).alias("family"))


@FAMILY.add(
    "tx_template_key_unicode",
    r"""SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '\s+', ' ', 'g')),
               '[?!.]+$', '')) AS family FROM conversations""",
)
def template_key_unicode(i):
    return i.conversations.select("conv_id", "turn", fx.template_key(F.col("text")).alias("family"))


@FAMILY.add("tx_families", oracle(f"WITH {_TERMINAL} SELECT * FROM fam", "messages", "corpus_questions"))
def families(i):
    return t.families(_terminal(i))


@FAMILY.add(
    "tx_coverage_gaps", oracle(f"WITH {_TERMINAL} SELECT * FROM gaps WHERE signals <> ''", "messages", "corpus_questions")
)
def coverage_gaps(i):
    return _gaps(i).withColumn("signals", F.array_join("signals", ","))


@FAMILY.add(
    "tx_gap_evidence",
    types={"rank": "INTEGER"},
    oracle_sql=oracle(
        f"""WITH {_TERMINAL},
        c AS (SELECT d.family, conversation_id, min(ordinal) AS seen, min(ordinal) FILTER (WHERE negative) AS neg,
                     min(ordinal) FILTER (WHERE failed) AS fail,
                     arg_min(user_key, ordinal) FILTER (WHERE user_key <> '') AS u
              FROM done d JOIN gaps g ON g.family = d.family AND g.signals <> '' GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY family, u ORDER BY seen) AS of_user FROM c),
        reps AS (SELECT family, conversation_id FROM o JOIN gaps USING (family)
                 WHERE of_user = 1 AND u IS NOT NULL AND users >= 2
                 QUALIFY row_number() OVER (PARTITION BY family ORDER BY seen) <= 2),
        p AS (SELECT c.*, CASE WHEN r.conversation_id IS NOT NULL THEN 0
                               WHEN neg = min(neg) OVER (PARTITION BY c.family) THEN 1
                               WHEN fail = min(fail) OVER (PARTITION BY c.family) THEN 2
                               WHEN neg IS NOT NULL THEN 3 WHEN fail IS NOT NULL THEN 4 ELSE 5 END AS level
              FROM c LEFT JOIN reps r ON r.family = c.family AND r.conversation_id = c.conversation_id)
        SELECT family, row_number() OVER (PARTITION BY family
                 ORDER BY level, CASE level WHEN 0 THEN seen WHEN 1 THEN neg WHEN 2 THEN fail WHEN 3 THEN neg
                                            WHEN 4 THEN fail ELSE seen END) AS rank, conversation_id
        FROM p QUALIFY rank <= 3""",
        "messages", "corpus_questions",
    ),
)
def gap_evidence(i):
    return t.gap_evidence(_terminal(i), _gaps(i))


@FAMILY.add(
    "tx_gap_totals",
    oracle(
        f"""WITH {_TERMINAL} SELECT (SELECT count(*) FROM done) AS scanned, count(*) AS families,
                   count(*) FILTER (WHERE family IN (SELECT family FROM known)) AS covered FROM fam""",
        "messages", "corpus_questions",
    ),
)
def gap_totals(i):
    return t.gap_totals(t.families(_terminal(i)), i.corpus_questions, unicode=False)


_DUPES = r"""
  k AS (SELECT *, trim(regexp_replace(lower(replace(question, 'ß', 'ss')), '\s+', ' ', 'g')) AS key FROM candidates),
  r AS (SELECT *, row_number() OVER w AS rn, first_value(question_id) OVER w AS retained_id FROM k
        WINDOW w AS (PARTITION BY key ORDER BY source = 'user' DESC, validation_status = 'valid' DESC,
                     (priority = 'P0' OR provenance = 'curated') DESC, ordinal))"""


@FAMILY.add(
    "tx_dedup_winner",
    oracle(f"WITH {_DUPES} SELECT question_id, ordinal FROM r WHERE rn = 1 OR key = ''", "candidates"),
)
def dedup_winner(i):
    return t.dedup_winners(i.candidates).select("question_id", "ordinal")


@FAMILY.add(
    "tx_dedup_rejected",
    oracle(f"WITH {_DUPES} SELECT question_id, ordinal, retained_id FROM r WHERE rn > 1 AND key <> ''", "candidates"),
)
def dedup_rejected(i):
    return t.dedup_rejected(i.candidates).select("question_id", "ordinal", "retained_id")


@FAMILY.add(
    "tx_renumber_ids",
    oracle(
        """WITH n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ordinal) - 1 AS k FROM ids_with_suffixes),
        ids AS (SELECT question_id, count(*) AS c FROM ids_with_suffixes GROUP BY 1),
        free AS (SELECT question_id, v, row_number() OVER (PARTITION BY question_id ORDER BY v) AS k
                 FROM (SELECT question_id, unnest(range(2, c + 4)) AS v FROM ids) f
                 WHERE NOT EXISTS (SELECT 1 FROM ids x WHERE x.question_id = f.question_id || ':v' || CAST(f.v AS VARCHAR)))
        SELECT n.ordinal, n.question_id,
               CASE WHEN n.k = 0 THEN n.question_id ELSE n.question_id || ':v' || CAST(free.v AS VARCHAR) END AS new_id
        FROM n LEFT JOIN free ON free.question_id = n.question_id AND free.k = n.k""",
        "ids_with_suffixes",
    ),
)
def renumber_ids(i):
    return t.renumber_ids(i.ids_with_suffixes).select("ordinal", "question_id", "new_id")


_PLAIN = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '/\*.*?\*/', ' ', 'gs'), '--[^\n]*', ' ', 'g'),
             '\s+', ' ', 'g')))"""


@FAMILY.add(
    "tx_fingerprint",
    oracle(
        f"""SELECT artifact_id AS id, sha256({_PLAIN.format('sql_text')}) AS fingerprint FROM artifacts
            UNION ALL SELECT item_id, sha256({_PLAIN.format('sql_text')}) FROM corpus""",
        "artifacts", "corpus",
    ),
)
def fingerprint(i):
    both = i.artifacts.select(F.col("artifact_id").alias("id"), "sql_text").unionByName(
        i.corpus.select(F.col("item_id").alias("id"), "sql_text")
    )
    return both.select("id", fx.statement_fingerprint(F.col("sql_text")).alias("fingerprint"))


_CANON = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _artifact_ids(i):
    """Artifacts that carry the id of the document whose text they repeat, where there is one."""
    return i.candidates.select(
        F.concat(F.lit("a"), F.col("ordinal").cast("string")).alias("artifact_id"), "question",
        F.col("expected_sql").alias("sql_text"),
    )


def _benchmark_items(i):
    german = F.contains("sql_text", F.lit("/* de */"))
    return i.corpus.select(F.concat(F.lit("a"), (F.col("item_id") * 7).cast("string")).alias("item_id"), "question",
                           F.when(german, F.replace("sql_text", F.lit(",  total from sales"), F.lit(""))).otherwise(F.col("sql_text")).alias("sql_text"))


@FAMILY.add(
    "tx_exact_leak",
    oracle(
        f"""WITH a AS (SELECT 'a' || CAST(ordinal AS VARCHAR) AS id, {_PLAIN.format('expected_sql')} AS s,
                         {_CANON.format('question')} AS q FROM candidates),
        c AS (SELECT 'a' || CAST(item_id * 7 AS VARCHAR) AS id,
                     {_PLAIN.format("CASE WHEN contains(sql_text, '/* de */') THEN replace(sql_text, ',  total from sales', '') ELSE sql_text END")} AS s,
                     {_CANON.format('question')} AS q FROM corpus)
        SELECT id AS artifact_id,
               CASE WHEN id IN (SELECT id FROM c) THEN 'question_id=' || id
                    WHEN s <> '' AND s IN (SELECT s FROM c) THEN 'sql_hash' ELSE 'question_text' END AS reason
        FROM a WHERE id IN (SELECT id FROM c) OR (s <> '' AND s IN (SELECT s FROM c)) OR (q <> '' AND q IN (SELECT q FROM c))""",
        "candidates", "corpus",
    ),
)
def exact_leak(i):
    return t.exact_leaks(_artifact_ids(i), _benchmark_items(i))


def _brute(tokens: str, left: str, right: str, threshold: float) -> str:
    """Every pair that shares a token, counted: the plain reading of the definition."""
    return f"""
      lt AS (SELECT artifact_id, unnest({tokens.format(left)}) AS tok FROM artifacts),
      rt AS (SELECT item_id, unnest({tokens.format(right)}) AS tok FROM corpus),
      ln AS (SELECT artifact_id, count(*) AS n FROM lt GROUP BY 1),
      rn AS (SELECT item_id, count(*) AS n FROM rt GROUP BY 1),
      both_ AS (SELECT artifact_id, item_id, count(*) AS c FROM lt JOIN rt USING (tok) GROUP BY ALL),
      best AS (SELECT artifact_id, item_id, c / (ln.n + rn.n - c) AS score
               FROM both_ JOIN ln USING (artifact_id) JOIN rn USING (item_id)
               WHERE c / (ln.n + rn.n - c) >= {threshold}
               QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY score DESC, item_id) = 1)"""


_STOP = "[" + ", ".join(f"'{w}'" for w in fx.STOPWORDS) + ", '']"
_TOKENS = "list_filter(list_distinct(string_split(" + _CANON + ", ' ')), lambda w: NOT list_contains(" + _STOP + ", w))"
_SQUEEZED = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
# All 3-grams: the consecutive ones from each of three starting positions.
_SHINGLES = (
    "list_distinct(list_concat(regexp_extract_all(" + _SQUEEZED + ", '(?s).{{3}}'), regexp_extract_all((" + _SQUEEZED
    + ")[2:], '(?s).{{3}}'), regexp_extract_all((" + _SQUEEZED + ")[3:], '(?s).{{3}}')))"
)


def _brute_fields(name: str, own: str, other: str) -> str:
    """3-grams of an artifact field against both corpus fields, every pair counted."""
    return f"""
      {name}_l AS (SELECT artifact_id, unnest({_SHINGLES.format(own)}) AS tok FROM artifacts),
      {name}_r AS (SELECT 0 AS f, item_id, unnest({_SHINGLES.format(own)}) AS tok FROM corpus
                   UNION ALL SELECT 1, item_id, unnest({_SHINGLES.format(other)}) FROM corpus),
      {name}_c AS (SELECT artifact_id, f, item_id, count(*) AS c FROM {name}_l JOIN {name}_r USING (tok) GROUP BY ALL),
      {name} AS (SELECT artifact_id, item_id, f, c / (a.n + b.n - c) AS score FROM {name}_c
                 JOIN (SELECT artifact_id, count(*) AS n FROM {name}_l GROUP BY ALL) a USING (artifact_id)
                 JOIN (SELECT f, item_id, count(*) AS n FROM {name}_r GROUP BY ALL) b USING (f, item_id)
                 WHERE c / (a.n + b.n - c) >= 0.6
                 QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY score DESC, f, item_id) = 1)"""


@FAMILY.add(
    "tx_token_jaccard",
    oracle(
        f"WITH {_brute(_TOKENS, 'question', 'question', 0.85)} SELECT artifact_id, item_id, round(score, 6) AS score FROM best",
        "artifacts", "corpus",
    ),
)
def token_jaccard(i):
    return t.token_matches(i.artifacts, i.corpus).withColumn("score", F.round("score", 6))


@FAMILY.add(
    "tx_ngram_jaccard",
    oracle(
        f"""WITH {_brute_fields('m', 'question', 'sql_text')}
        SELECT artifact_id, item_id, CASE f WHEN 0 THEN 'question' ELSE 'sql_text' END AS field, round(score, 6) AS score FROM m""",
        "artifacts", "corpus",
    ),
)
def ngram_jaccard(i):
    return t.ngram_matches(i.artifacts, i.corpus).withColumn("score", F.round("score", 6))


@FAMILY.add(
    "tx_ngram_jaccard_sql",
    oracle(
        f"WITH {_brute(_SHINGLES, 'sql_text', 'sql_text', 0.6)} SELECT artifact_id, item_id, round(score, 6) AS score FROM best",
        "artifacts", "corpus",
    ),
)
def ngram_jaccard_sql(i):
    best = t.ngram_matches(i.artifacts, i.corpus, "sql_text", both_fields=False)
    return best.select("artifact_id", "item_id", F.round("score", 6).alias("score"))


@FAMILY.add("tx_ngram_indexed")
def ngram_indexed(i):
    """The matches of tx_ngram_jaccard from an index that is written in two batches; tests measure its recall."""
    path = f"{session_folder(i.spark)}/minhash-{uuid.uuid4().hex}"
    late = F.col("item_id") % 4 == 3
    t.index_texts(i.corpus.filter(~late), path)
    t.index_texts(i.corpus.filter(late), path, batch="1")
    return t.ngram_indexed(i.artifacts, path).withColumn("score", F.round("score", 6))


def _vectors(i):
    """Corpus: every vector. Artifacts: every vector with a quarter of its components, chosen by label, set to 0."""
    corpus = i.embeddings.select(F.col("vec_id").alias("item_id"), "embedding")
    rough = F.transform("embedding", lambda x, k: F.when(k % 4 == F.col("label") % 4, F.lit(0.0)).otherwise(x.cast("double")))
    return i.embeddings.select(F.col("vec_id").alias("artifact_id"), rough.alias("embedding")), corpus


@FAMILY.add(
    "tx_cosine_match",
    """WITH a AS (SELECT vec_id AS artifact_id,
                         list_transform(embedding, lambda x, k: CASE WHEN (k - 1) % 4 = label % 4 THEN 0.0::DOUBLE ELSE x::DOUBLE END) AS v
                  FROM embeddings),
       c AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings),
       p AS (SELECT artifact_id, item_id, list_cosine_similarity(a.v, c.v) AS s FROM a JOIN c ON true)
       SELECT artifact_id, item_id, round(s, 6) AS score FROM p WHERE s >= 0.85
       QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY s DESC, item_id) = 1""",
)
def cosine_match(i):
    return t.cosine_matches(*_vectors(i)).withColumn("score", F.round("score", 6))


@FAMILY.add("tx_cosine_indexed")
def cosine_indexed(i):
    """The matches of tx_cosine_match from an index that is written in two batches; tests measure its recall."""
    artifacts, corpus = _vectors(i)
    path = f"{session_folder(i.spark)}/index-{uuid.uuid4().hex}"
    late = F.col("item_id") % 4 == 3
    t.index_corpus(corpus.filter(~late), path)
    append_vectors(corpus.filter(late), path, "1", "item_id")
    return t.cosine_indexed(artifacts, path).withColumn("score", F.round("score", 6))


_DECISION = f"""
  WITH {_brute(_TOKENS, 'question', 'question', 0.75)},
  q AS (SELECT artifact_id, score AS qs FROM best),
  ls AS (SELECT artifact_id, unnest({_SHINGLES.format('sql_text')}) AS tok FROM artifacts),
  rs AS (SELECT item_id, unnest({_SHINGLES.format('sql_text')}) AS tok FROM corpus),
  sc AS (SELECT artifact_id, item_id, count(*) AS c FROM ls JOIN rs USING (tok) GROUP BY ALL),
  sq AS (SELECT artifact_id, max(c / (a.n + b.n - c)) AS ss FROM sc
         JOIN (SELECT artifact_id, count(*) AS n FROM ls GROUP BY 1) a USING (artifact_id)
         JOIN (SELECT item_id, count(*) AS n FROM rs GROUP BY 1) b USING (item_id) GROUP BY 1),
  f AS (SELECT a.artifact_id, a.kind, q.qs, CASE WHEN sq.ss >= 0.6 THEN sq.ss END AS ss,
               {_PLAIN.format('a.sql_text')} IN (SELECT {_PLAIN.format('sql_text')} FROM corpus) AS ex
        FROM artifacts a LEFT JOIN q USING (artifact_id) LEFT JOIN sq USING (artifact_id)),
  d AS (SELECT *, CASE WHEN qs >= 0.85 AND ex THEN 'exact_question_and_sql'
                       WHEN qs IS NOT NULL AND (ex OR ss IS NOT NULL) THEN 'high_question_and_sql_similarity'
                       WHEN qs >= 0.85 THEN 'benchmark_question_echo'
                       WHEN ex OR ss IS NOT NULL THEN 'sql_pattern_overlap_warning' END AS reason FROM f)
  SELECT artifact_id, kind, reason, round(qs, 6) AS question_score,
         CASE WHEN ex THEN 1.0 ELSE round(ss, 6) END AS sql_score,
         CASE WHEN reason IS NULL THEN 'pass' WHEN reason = 'sql_pattern_overlap_warning' THEN 'warn' ELSE 'block' END AS decision
  FROM d"""


@FAMILY.add("tx_leak_decision", oracle(_DECISION, "artifacts", "corpus"))
def leak_decision(i):
    df = t.leak_decisions(i.artifacts, i.corpus, strict=False)
    return df.withColumns({c: F.round(c, 6) for c in ("question_score", "sql_score")})


@FAMILY.add(
    "tx_leak_counts",
    oracle(
        f"""WITH {_brute_fields('q', 'question', 'sql_text')}, {_brute_fields('s', 'sql_text', 'question')},
        hit AS (SELECT artifact_id FROM q UNION SELECT artifact_id FROM s
                UNION SELECT artifact_id FROM artifacts
                WHERE {_PLAIN.format('sql_text')} IN (SELECT {_PLAIN.format('sql_text')} FROM corpus))
        SELECT kind, count(*) AS leaks FROM artifacts JOIN hit USING (artifact_id) GROUP BY 1""",
        "artifacts", "corpus",
    ),
)
def leak_counts(i):
    return t.leak_counts(i.artifacts, i.corpus)


_SHAPE = r"sha256(regexp_replace(lower(statement_text), '\b[0-9]+\b', '?', 'g'))"


@FAMILY.add("tx_shape_hash", oracle(f"SELECT statement_id, {_SHAPE} AS shape_hash FROM query_log", "query_log"))
def shape_hash(i):
    return i.query_log.select("statement_id", fx.shape_hash(F.col("statement_text")).alias("shape_hash"))


@FAMILY.add(
    "tx_shape_recency",
    types={"recency_weight": "DOUBLE"},
    oracle_sql=oracle(
        f"""WITH s AS (SELECT {_SHAPE} AS shape_hash, count(*) AS frequency, count(DISTINCT executed_by) AS users,
                              max(start_time) AS last_used_at FROM query_log GROUP BY 1),
        d AS (SELECT *, epoch(TIMESTAMP '2024-02-05 00:00:00' - last_used_at) / 86400 AS age FROM s)
        SELECT shape_hash, frequency, users, last_used_at,
               CASE WHEN age <= 7 THEN '0_7_days' WHEN age <= 14 THEN '8_14_days' WHEN age <= 30 THEN '15_30_days'
                    WHEN age <= 90 THEN '31_90_days' END AS recency_bucket,
               CASE WHEN age <= 7 THEN 1.0 WHEN age <= 14 THEN 0.5 WHEN age <= 30 THEN 0.25 WHEN age <= 90 THEN 0.1 END
                 AS recency_weight FROM d""",
        "query_log",
    ),
)
def shape_recency(i):
    return t.shape_rollup(i.query_log, AS_OF)


@FAMILY.add(
    "tx_keyword_search",
    oracle(
        """WITH tabs AS (SELECT table_name, max(row_count) || ' rows of ' || min(column_name) AS table_comment,
                                CAST(max(cardinality) AS BIGINT) AS last_altered FROM named_columns GROUP BY 1),
        j AS (SELECT t.*, c.column_name, c.description,
                     coalesce(regexp_matches(lower(c.column_name), 'status|promo'), false)
                       OR coalesce(regexp_matches(lower(c.description), 'status|promo'), false) AS col_hit,
                     coalesce(regexp_matches(lower(t.table_name), 'status|promo'), false)
                       OR coalesce(regexp_matches(lower(t.table_comment), 'status|promo'), false) AS tab_hit
              FROM tabs t LEFT JOIN named_columns c USING (table_name))
        SELECT table_name, table_comment, last_altered,
               coalesce(string_agg(DISTINCT column_name, ',' ORDER BY column_name) FILTER (WHERE col_hit), '') AS matching_columns,
               count(DISTINCT column_name) AS total_columns
        FROM j WHERE col_hit OR tab_hit GROUP BY ALL ORDER BY last_altered DESC NULLS LAST, table_name LIMIT 20""",
        "named_columns",
    ),
)
def keyword_search(i):
    tables = i.named_columns.groupBy("table_name").agg(
        F.concat(F.max("row_count").cast("string"), F.lit(" rows of "), F.min("column_name")).alias("table_comment"),
        F.max("cardinality").alias("last_altered"),
    )
    found = t.keyword_search(tables, i.named_columns.select("table_name", "column_name", "description"), ["Status", "promo"])
    return found.withColumn("matching_columns", F.array_join("matching_columns", ","))


@FAMILY.add(
    "tx_keyword_tables",
    oracle(
        """WITH tabs AS (SELECT table_name, max(row_count) || ' rows of ' || min(column_name) AS table_comment,
                                CAST(max(cardinality) AS BIGINT) AS last_altered FROM named_columns GROUP BY 1),
        k AS (SELECT DISTINCT lower(unnest(string_split(p_type, ' '))) AS keyword FROM part UNION SELECT lower(p_brand) FROM part
              UNION SELECT DISTINCT 'tbl' || p_size FROM part),
        j AS (SELECT k.keyword, t.*, c.column_name,
                     coalesce(contains(lower(c.column_name), keyword), false) OR coalesce(contains(lower(c.description), keyword), false) AS col_hit,
                     coalesce(contains(lower(t.table_name), keyword), false) OR coalesce(contains(lower(t.table_comment), keyword), false) AS tab_hit
              FROM k, tabs t LEFT JOIN named_columns c USING (table_name)),
        g AS (SELECT keyword, table_name, last_altered,
                     coalesce(string_agg(DISTINCT column_name, ',' ORDER BY column_name) FILTER (WHERE col_hit), '') AS matching_columns,
                     count(DISTINCT column_name) AS total_columns
              FROM j WHERE col_hit OR tab_hit GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY last_altered DESC NULLS LAST, table_name) AS place
        FROM g QUALIFY place <= 20""",
        "named_columns",
    ),
    types={"place": "INTEGER"},
)
def keyword_tables(i):
    tables = i.named_columns.groupBy("table_name").agg(
        F.concat(F.max("row_count").cast("string"), F.lit(" rows of "), F.min("column_name")).alias("table_comment"),
        F.max("cardinality").alias("last_altered"),
    )
    words = (
        i.part.select(F.explode(F.split("p_type", " ")).alias("keyword"))
        .union(i.part.select("p_brand"))
        .union(i.part.select(F.concat(F.lit("TBL"), F.col("p_size").cast("string"))))
    )
    found = t.keyword_tables(tables, i.named_columns.select("table_name", "column_name", "description"), words, limit=20)
    return found.drop("table_comment").withColumn("matching_columns", F.array_join("matching_columns", ","))


@FAMILY.add(
    "tx_sql_stability",
    oracle(
        """SELECT question_id, unnest(CASE question_id % 8 WHEN 1 THEN ['UNORDERED_LIMIT'] WHEN 3 THEN ['UNORDERED_LIMIT']
                    WHEN 4 THEN ['NONDETERMINISTIC_SQL', 'VOLATILE_TIME_REFERENCE'] WHEN 6 THEN ['NONDETERMINISTIC_SQL'] END) AS code,
                  unnest(CASE question_id % 8 WHEN 1 THEN ['error'] WHEN 3 THEN ['error']
                    WHEN 4 THEN ['error', 'warning'] WHEN 6 THEN ['error'] END) AS severity
           FROM qa_pairs""",
        "qa_pairs",
    ),
)
def sql_stability(i):
    return t.statement_findings(i.qa_pairs)


@FAMILY.add(
    "tx_format_coverage",
    oracle(
        """WITH f AS (SELECT count(*) AS total,
             count(*) FILTER (WHERE question LIKE '%total%' OR expected_sql LIKE '%sum(%') AS aggregation,
             count(*) FILTER (WHERE question LIKE 'What is%' OR question LIKE '%how me%' OR category = 'detail') AS lookup,
             count(*) FILTER (WHERE question LIKE 'Compare%') AS comparison,
             count(*) FILTER (WHERE question LIKE '%since%') AS time_filter,
             count(*) FILTER (WHERE question LIKE 'Top%' OR category = 'ranking'
                              OR (expected_sql LIKE '%LIMIT%' AND expected_sql LIKE '%ORDER BY%')) AS top_n FROM qa_pairs)
           SELECT format, n, round(n / total, 4) AS share, n = 0 AS missing
           FROM (UNPIVOT f ON aggregation, lookup, comparison, time_filter, top_n INTO NAME format VALUE n)""",
        "qa_pairs",
    ),
)
def format_coverage(i):
    return t.format_coverage(i.qa_pairs)


_RULES = [
    {"name": "active_only", "column": "is_active", "terms": ["active", "current"], "issue": "extra filter on {column}"},
    {"name": "customer", "column": "o_custkey", "terms": ["customer"], "issue": "question names no customer: {column}"},
]


@FAMILY.add(
    "tx_rule_findings",
    oracle(
        """SELECT question_id, 'active_only' AS rule, 'extra filter on is_active' AS issue FROM qa_pairs
           WHERE expected_sql LIKE '%is_active%' AND lower(question) NOT LIKE '%active%' AND lower(question) NOT LIKE '%current%'
           UNION ALL
           SELECT question_id, 'customer', 'question names no customer: o_custkey' FROM qa_pairs
           WHERE expected_sql LIKE '%o_custkey%' AND lower(question) NOT LIKE '%customer%'""",
        "qa_pairs",
    ),
)
def rule_findings(i):
    return t.rule_findings(i.qa_pairs, _RULES)


@FAMILY.add(
    "tx_rules_at_scale",
    oracle(
        """SELECT question_id, 'customer ' || c_custkey AS rule, 'question does not name ' || c_custkey || ': o_custkey = ' || c_custkey AS issue
           FROM qa_pairs JOIN customer ON contains(lower(expected_sql), 'o_custkey = ' || c_custkey)
           WHERE NOT contains(lower(question), 'customer ' || c_custkey)""",
        "qa_pairs",
    ),
)
def rules_at_scale(i):
    number = F.col("c_custkey").cast("string")
    rules = i.customer.select(
        F.concat(F.lit("customer "), number).alias("name"), F.concat(F.lit("o_custkey = "), number).alias("column"),
        F.array(F.concat(F.lit("Customer "), number)).alias("terms"),
        F.concat(F.lit("question does not name "), number, F.lit(": {column}")).alias("issue"),
    )
    return t.rule_findings_of(i.qa_pairs, rules)


@FAMILY.add(
    "tx_sql_in_prose",
    oracle(
        """SELECT doc_id, 2 AS line_no, string_split(body, chr(10))[2] AS line FROM instructions
           WHERE doc_id % 9 IN (0, 2, 3, 5, 6, 7)""",
        "instructions",
    ),
)
def sql_in_prose(i):
    return t.sql_in_prose(i.instructions)
