"""Named queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import backoff, decontaminate, gam, language, pages, raking, rules, sanitize, sharding, simhash, spelling, tokens, whitening
from auditframe.llm._table import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Target marginals of the mix: shares of tokens to these powers, which evens all three out in part.
MIX = {"source": 0.7, "lang": 0.6, "topic": 0.7}
# Longest n-grams of the scores.
ORDER = 3
# Documents of more tokens are over the limit.
TOKEN_LIMIT = 4096


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def unsigned_crc32(text: str):
    """crc32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


@_query
def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a field learnt outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


@_query
def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents under the law `rows`."""
    return sharding.deal(read(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), sharding.text_size("text").alias("size"), unsigned_crc32("text").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op3_crf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = read(spark, sf_dir, "pages")
    return pages.extract(rows, pages.learn(rows)).select("page_id", "url", "text", "n_chars")


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the base rules and the learnt decision list."""
    docs = read(spark, sf_dir, "documents")
    learnt = rules.learn(docs, read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0))
    judged = rules.judge(docs.select("doc_id", "text"), learnt)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@_query
def op6_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model learnt outside the held-out fifth."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = gam.learn(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = gam.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@_query
def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches and disclosing terms of every document."""
    found = sanitize.all_spans(read(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in sanitize.KINDS])
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(sanitize.KINDS[:4])],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@_query
def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score of every document by the n-grams of up to ORDER words of all others."""
    scored = backoff.score(read(spark, sf_dir, "documents"), ORDER)
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("mean_log_score", 6).alias("mean_log_score"))


@_query
def op9_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the distance and place of the best match."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op10_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, sampling probability and draw of every document."""
    return raking.mix(read(spark, sf_dir, "documents"), MIX).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "tokens",
        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled",
    )


@_query
def op11_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document by the vocabulary of a public sentencepiece model."""
    import public_tokenizers

    counted = tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@_query
def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more with its spelling form, its root and the number of words near it."""
    words = spelling.spelling_words(read(spark, sf_dir, "documents"), noise=31)
    return spelling.spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every embedding."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


ORACLES["op8_stupid_backoff"] = backoff.score_sql(ORDER)
ORACLES["op10_raking"] = raking.mix_sql(MIX)
