"""Text lines to typed columns: one regex pass per line, no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line formats
CALL_LINE = (r"^\[save_count (\d+)\] \[([\d.]+)\] \[Rank (\d+)\] Fun (\w+) Data (\d+)"
             r" stream (0x[0-9a-fA-F]+) opCount (\d+)(?: groupHash (-?\d+))?.*$")
SHORT_CALL_LINE = r"^\[([\d.]+)\] \[Rank (\d+)\] Fun (\w+) Data (\d+).*$"
LINK_LINE = (r"^(\S+):(\S+):(\d+): Group:(\d+), from rank (\d+) to rank (\d+), channel_id:(\d+),"
             r" func:(\d+),FuncTimes:(\d+), (\d+\.\d+\.\d+\.\d+)->(\d+\.\d+\.\d+\.\d+)"
             r" send (\d+) Bytes used (\d+) nsec.*$")
RANK_FILE_NAMES = (r"rank_(\d+)\.log", r"(\d+)\.log", r"log_(\d+)\.txt", r"rank(\d+)\.log")
MESSAGE_LIMIT = 127

_SEP = "\u0001"


def _fields(line: Column, pattern: str, count: int) -> Column:
    """Array of the groups of ``pattern``, or null when the line does not match."""
    swapped = F.regexp_replace(line, pattern, _SEP.join(f"${i + 1}" for i in range(count)))
    parts = F.split(swapped, _SEP, -1)
    return F.when((swapped != line) & (F.size(parts) == count), parts)


def _matched(lines: DataFrame, line: Column, pattern: str, count: int, keep: list[str]) -> DataFrame:
    """Lines that match, with the groups as array ``_p``; the pattern meets each line once."""
    swap = _SEP.join(f"${i + 1}" for i in range(count))
    both = F.transform(F.array(line), lambda x: F.struct(x.alias("line"), F.regexp_replace(x, pattern, swap).alias("swapped")))
    parts = F.transform(both, lambda b: F.when(b["swapped"] != b["line"], F.split(b["swapped"], _SEP, -1)))
    # a filter on the fields themselves would be computed beside them
    return lines.select(*keep, F.explode_outer(parts).alias("_p")).where(F.size("_p") == count)


def nanos(seconds_text: Column) -> Column:
    """``sec.nanos`` text to epoch nanoseconds, exactly."""
    exact = F.regexp_extract(seconds_text, r"^\d+(?:\.\d+)?", 0).try_cast("decimal(20,9)")
    return (exact * F.lit(1_000_000_000)).cast("bigint")


def parse_calls(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed call rows; other columns of ``lines`` are kept.  Unmatched lines are dropped."""
    keep = [c for c in lines.columns if c != column]
    p = F.col("_p")
    hit = _matched(lines, F.col(column), CALL_LINE, 8, keep)
    return hit.select(
        *keep,
        p[0].try_cast("int").alias("save_count"), nanos(p[1]).alias("ts_ns"),
        (nanos(p[1]) / F.lit(1e9)).alias("timestamp"), p[2].try_cast("int").alias("rank"),
        p[3].alias("function"), p[4].try_cast("bigint").alias("data_size"), p[5].alias("stream"),
        p[6].try_cast("bigint").alias("op_count"),
        p[7].try_cast("bigint").alias("group_hash"))


def unparsed_calls(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quarantine: lines that are no call lines."""
    return lines.where(_fields(F.col(column), CALL_LINE, 8).isNull())


def parse_short_calls(lines: DataFrame, column: str = "value") -> DataFrame:
    keep = [c for c in lines.columns if c != column]
    p = F.col("_p")
    hit = _matched(lines, F.col(column), SHORT_CALL_LINE, 4, keep)
    return hit.select(*keep, nanos(p[0]).alias("ts_ns"), p[1].try_cast("int").alias("rank"),
                      p[2].alias("function"), p[3].try_cast("bigint").alias("data_size"))


def parse_links(lines: DataFrame, column: str = "value") -> DataFrame:
    keep = [c for c in lines.columns if c != column]
    p = F.col("_p")
    hit = _matched(lines, F.trim(column), LINK_LINE, 13, keep)
    names = ["node", "card", "ts", "grp", "from_rank", "to_rank", "channel", "func", "func_times",
             "src_ip", "dst_ip", "bytes_sent", "nsec"]
    kinds = ["string", "string", "bigint", "bigint", "int", "int", "int", "int", "bigint",
             "string", "string", "bigint", "bigint"]
    return hit.select(*keep, *[p[i].try_cast(k).alias(n)
                               for i, (n, k) in enumerate(zip(names, kinds))])


def rank_of_file(name: Column) -> Column:
    """Rank in a file name: known patterns in order, else the first digits, else -1."""
    tries = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in RANK_FILE_NAMES]
    tries.append(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")))
    return F.coalesce(*[t.try_cast("int") for t in tries], F.lit(-1))


def truncated(line: Column) -> Column:
    """A message that filled the producer's buffer, or lost its group hash, is unreliable."""
    message = F.regexp_replace(line, r"^\[save_count \d+\] ", "")
    return (F.length(message) >= MESSAGE_LIMIT) | ~line.rlike(r"groupHash -?\d+")


def signed64(unsigned: Column) -> Column:
    """Unsigned 64-bit decimal text (or number) to the signed value with the same bits."""
    wide = unsigned.cast("decimal(20,0)")
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(20,0)"),
                  (wide - F.lit("18446744073709551616").cast("decimal(20,0)")).cast("bigint")
                  ).otherwise(wide.cast("bigint"))
