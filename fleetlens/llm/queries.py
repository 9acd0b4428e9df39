"""The registered queries of this subpackage: each applies its operator to the whole given table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (ann, bpe, clusters, html_text, importance, language, lexical, minhash, mixing, ngram_lm,
                           quality_rules, token_counts, toxicity)
from fleetlens.llm.common import bounded_batches, fold, table, whole_text, written
from fleetlens.plans.durable import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BPE_FILE = "byte_bpe_50k.json"
PIECES_FILE = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql.strip()


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    sized = written(docs, "sized")
    return mixing.mix(sized, sized).select("doc_id", "source", "epoch", "block", "position", "n_tokens")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op4_html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "visible_text", "n_chars", "n_lines")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_FILE)
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(whole_text(), path).alias("ids"))
    both = ids.withColumn("decoded", bpe.decode(F.col("ids"), path))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
                       .alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh cache for each call, so every distinct text is encoded."""
    counts = token_counts.cached_counts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        public_tokenizers.path(PIECES_FILE), scratch_path(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"),
                         toxicity.score(whole_text(), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_ngram_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold("doc_id", 3) != 1), public_tokenizers.path(PIECES_FILE))
    held = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return language.predict(held, model).select("doc_id", "held_out", "lang_pred", "score")


_add("op1_importance_resampling", op1_importance_resampling)
_add("op2_source_mixing", op2_source_mixing, mixing.SQL)
_add("op3_quality_rules", op3_quality_rules)
_add("op4_html_visible_text", op4_html_visible_text)
_add("op5_bpe_round_trip", op5_bpe_round_trip)
_add("op6_token_counts", op6_token_counts)
_add("op7_minhash_near_dedup", op7_minhash_near_dedup)
_add("op8_learned_partitions", op8_learned_partitions)
_add("op9_toxicity", op9_toxicity)
_add("op10_ngram_automaton", op10_ngram_automaton)
_add("op11_simplex_clusters", op11_simplex_clusters, clusters.sql())
_add("op12_bitsliced_search", op12_bitsliced_search, lexical.SQL)
_add("op13_language_pieces", op13_language_pieces)
