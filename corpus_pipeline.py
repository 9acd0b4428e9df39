"""From raw documents to decoded training text: five stages, each written and read again by ``run``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, minhash, mixing, quality_rules, toxicity
from fleetlens.llm.common import bounded_batches, table, whole_text, written
from fleetlens.llm.queries import BPE_FILE


#: words of a shingle of the near-duplicate stage; op7 has its own
DEDUP_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no risk-controlled cutoff rejects."""
    bounded_batches(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labelled ones among them finds clean."""
    bounded_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies by shingles of five words."""
    bounded_batches(spark)
    return minhash.keep_one(docs, words=DEDUP_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources has them: some sources are thinned, some repeated."""
    # the documents' own columns travel packed, whatever their names
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")
    sized = mixing.with_tokens(rows).drop("doc_id", "text", "source")
    narrow = written(sized.drop("_row"), "sized")
    return mixing.mix(sized, narrow).select("_row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its ids, their number, and the text that they decode to, in columns ``ids``, ``n_tokens``
    and ``decoded``; the documents' own columns of these names are replaced."""
    bounded_batches(spark)
    path = public_tokenizers.path(BPE_FILE)
    ids = docs.drop("ids", "n_tokens", "decoded").withColumn("ids", bpe.encode(whole_text(), path))
    return ids.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded", bpe.decode(F.col("ids"), path))


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", dedup_stage),
          ("source_mixing", mixing_stage), ("bpe", bpe_stage)]

#: cutoffs, a trained classifier and token ids are beyond SQL; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
