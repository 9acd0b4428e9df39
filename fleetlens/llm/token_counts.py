"""Token counts of a piece vocabulary, through a table of digests.

Counts are kept under (digest of the content, digest of the vocabulary file).  A run joins the
digests of its documents to the stored counts, encodes one copy of each content that is not there,
and appends those counts.  Content is normalised by taking null as empty; nothing else is changed,
since any other change could change a count.

Copies meet on their digest: the first aggregation keeps one row per digest and task before the
shuffle, and the join back to the documents has one row per digest on its other side, so Spark can
split a digest that very many documents share.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import whole_text, written

SCHEMA = "content string, vocabulary string, n_tokens long"


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def count_tokens(text: Column, path: str) -> Column:
    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        model = _pieces(path)
        return pa.array([len(model.encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return counted(text)


def stored(spark: SparkSession, cache: str) -> DataFrame:
    """The counts kept so far; no table yet is an empty one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(SCHEMA).parquet(cache)
    return spark.createDataFrame([], SCHEMA)


def cached_counts(docs: DataFrame, path: str, cache: str, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_bytes``, ``content`` (digest) and ``n_tokens``; the text itself is dropped.

    Only contents missing in ``cache`` are encoded; their counts are appended to it.  Null and empty
    texts count 0 tokens.  Repeated documents each get a row.  Input columns that bear one of
    the three names are replaced.
    """
    spark, version = docs.sparkSession, vocabulary_digest(path)
    docs = docs.drop("n_bytes", "content", "n_tokens").withColumn("_whole", whole_text(text))
    digest = F.sha2(F.col("_whole").cast("binary"), 256)
    known = stored(spark, cache).where(F.col("vocabulary") == version).select("content", "n_tokens")
    # one text per digest and task before the shuffle; the join after it needs no other
    misses = (docs.select(digest.alias("content"), "_whole")
              .groupBy("content").agg(F.first("_whole").alias("_whole"))
              .join(known.select("content"), "content", "left_anti")
              .select("content", F.lit(version).alias("vocabulary"),
                      count_tokens(F.col("_whole"), path).alias("n_tokens")))
    misses.write.mode("append").parquet(cache)
    # two runs may have appended the same digest; written, since Spark splits a hot key only in a join
    # whose sides come straight from a shuffle
    counts = written(stored(spark, cache).where(F.col("vocabulary") == version)
                     .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return (docs.withColumn("n_bytes", F.octet_length("_whole").cast("long"))
            .withColumn("content", digest).drop("_whole", text)
            .join(counts, "content", "left"))
