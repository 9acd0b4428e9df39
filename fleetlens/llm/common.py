"""Reading, hashing and writing shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.durable import scratch_path


#: rows, and bytes, of whole texts that travel to Python at once
ARROW_ROWS, ARROW_BYTES = 1024, 4 << 20


#: a join's side up to this size may be broadcast without a hint; many such tables wait on the driver
BROADCAST_BYTES = 1 << 20


#: bits of the broadcast bitmap that spares rows a shuffle, as a power of two: 4 MB
BITMAP_BITS = 25


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches and automatic broadcasts of bounded size for this session; a batch ends at the first
    limit it meets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))


def written(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is in the only column of ``ids``, and few others: an exact join after it moves less.

    Each id sets one of ``2**BITMAP_BITS`` bits, which are broadcast, 4 KB a row; of many more ids than bits
    nothing but time is lost.
    """
    def spot(column: str) -> list[Column]:
        bit = F.xxhash64(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
        return [F.shiftright(bit, 15).alias("_block"), F.shiftright(bit, 6).bitwiseAND(F.lit(511)).cast("int").alias("_word"),
                bit.bitwiseAND(F.lit(63)).cast("int").alias("_bit")]

    bits = (ids.select(*spot(ids.columns[0])).groupBy("_block", "_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("set"))
            .groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "set"))).alias("set"))
            .select("_block", F.transform(F.sequence(F.lit(0), F.lit(511)),
                                          lambda i: F.coalesce(F.col("set")[i], F.lit(0).cast("long"))).alias("_words")))
    return (rows.select("*", *spot(key)).join(F.broadcast(bits), "_block")
            .where(F.getbit(F.col("_words")[F.col("_word")], F.col("_bit")) == 1).select(*rows.columns))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
