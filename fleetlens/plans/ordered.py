"""Ordered work inside a key, safe when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  ``OrderedGroups`` first counts
rows per key (one column-pruned, map-side combined aggregation).  Keys above a row limit are cut
into consecutive pieces of the order column at approximate quantiles, and windows run per
``(key, piece)``.  Rows a frame needs from the piece before are copied over as halo rows and
removed again afterwards, so results equal those of the uncut window.  Keys below the limit keep
the plain plan with no extra column at all.

The limit is the same for every input, so a task's share does not grow with the data.  What the
driver holds is bounded by it: a hot key has more than ``limit`` rows, so there are fewer than
``total / limit`` hot keys and fewer than twice as many cut points (a number of 8 bytes each; half a
million of them for 10^12 rows at the default limit).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_FLOOR = 4_000_000

_HELPERS = ("_hot", "_piece", "_halo", "_rows_before", "_key_rows")


def _look_up(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Broadcast lookup that also matches null keys.  Callers state why ``small`` is small."""
    theirs = small.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(F.broadcast(theirs), on, how).drop(*[f"_of_{k}" for k in keys])


class OrderedGroups:
    """Rows of ``df`` per ``keys`` in the order of ``order`` (first column numeric, rest ties).

    ``halo`` is how many preceding rows of the same key a later frame looks at.  ``sizes_from`` is
    a cheaper table to count keys in (its counts only decide what is cut, never the result);
    ``like`` is an earlier grouping of at least these rows by the same keys, whose finding that
    no key is hot is taken over.  ``most`` is a number of rows that no key exceeds, where that is known.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int = 0,
                 row_floor: int | None = None, sizes_from: DataFrame | None = None,
                 like: OrderedGroups | None = None, most: int | None = None):
        self.keys, self.order, self.halo = list(keys), list(order), halo
        self._df = df
        self._limit = max(ROW_FLOOR if row_floor is None else row_floor, 1)
        if (like is not None and not like.split and like.keys == self.keys) or (most is not None and most <= self._limit):
            self._hot = []
        else:
            self._hot = self._find_hot(sizes_from if sizes_from is not None else df)
        self._layout = self._cut(self._hot) if self._hot else None

    # ---- planning -------------------------------------------------------------------------
    def _find_hot(self, df: DataFrame) -> list:
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        return counts.where(F.col("_n") > self._limit).collect()

    def _cut(self, hot: list) -> DataFrame:
        spark = self._df.sparkSession
        count = T.LongType()
        hot_df = spark.createDataFrame([tuple(r) for r in hot], self._schema(_n=count))
        small = self._df.select(*self.keys, self.order[0])
        # fewer than total / limit rows
        joined = _look_up(small, hot_df, self.keys, "inner")
        want = F.ceil(F.col("_n") / F.lit(float(self._limit)))
        # the largest key takes every step of the grid, a smaller one as many as it needs
        grid = -(-max(r["_n"] for r in hot) // self._limit)
        steps = F.expr("array(" + ", ".join(f"{i / grid:.12f}D" for i in range(1, grid)) + ")")
        cuts = (joined.groupBy(*self.keys)
                .agg(F.percentile_approx(self.order[0], steps, F.lit(max(10000, 4 * grid))).alias("_grid"),
                     F.max("_n").alias("_n"))
                .withColumn("_want", want)
                .select(*self.keys, F.array_distinct(F.filter(
                    "_grid", lambda x, i: ((i + 1) * F.col("_want")) % grid < F.col("_want")
                )).alias("_cuts")))
        rows = cuts.collect()
        cut_type = cuts.schema["_cuts"].dataType
        plan = spark.createDataFrame([tuple(r) for r in rows], self._schema(_cuts=cut_type))
        self._most_cuts = max(len(r[-1]) for r in rows)
        sizes: dict = {}
        for r in (self._tag(self._df.select(*self.keys, self.order[0]), plan)
                  .where("_hot").groupBy(*self.keys, "_piece").count().collect()):
            sizes.setdefault(tuple(r[:-2]), {})[r[-2]] = r[-1]
        final = []
        for r in rows:
            final.append(self._merge_thin(tuple(r[:-1]), r[-1], sizes.get(tuple(r[:-1]), {})))
        return spark.createDataFrame(
            [k + (c, o, t) for k, c, o, t in final],
            self._schema(_cuts=cut_type, _offsets=T.ArrayType(count), _key_rows=count))

    def _schema(self, **extra: T.DataType) -> T.StructType:
        keys = self._df.select(*self.keys).schema.fields
        return T.StructType(keys + [T.StructField(n, t) for n, t in extra.items()])

    def _merge_thin(self, key, cuts, sizes):
        """Drop cuts until every piece but the last has at least ``halo`` rows."""
        kept, offsets, run, done = [], [0], 0, 0
        for i, cut in enumerate(cuts):
            run += sizes.get(i, 0)
            if run >= max(self.halo, 1):
                done += run
                kept.append(cut)
                offsets.append(done)
                run = 0
        total = done + run + sizes.get(len(cuts), 0)
        return key, kept, offsets, total

    def _tag(self, df: DataFrame, layout: DataFrame) -> DataFrame:
        """Piece number = how many cuts are <= the order value, by binary search in codegen."""
        # one row per hot key, fewer than 2 * total / limit cut points in all
        out = _look_up(df, layout, self.keys, "left").withColumn("_piece", F.lit(0))
        step = 1 << max(self._most_cuts.bit_length() - 1, 0)
        while step >= 1:
            probe = F.get(F.col("_cuts"), F.col("_piece") + F.lit(step - 1))
            out = out.withColumn("_piece", F.col("_piece") + F.when(
                probe <= F.col(self.order[0]), F.lit(step)).otherwise(F.lit(0)))
            step //= 2
        # the cuts end here: no shuffle carries them
        return out.withColumn("_hot", F.col("_cuts").isNotNull()).drop("_cuts")

    # ---- use ------------------------------------------------------------------------------
    @property
    def split(self) -> bool:
        return self._layout is not None

    @property
    def hot_keys(self) -> list:
        return self._hot

    @property
    def parts(self) -> list[str]:
        return self.keys + (["_piece"] if self.split else [])

    def rows(self) -> DataFrame:
        """The rows, plus halo copies where keys were cut."""
        if not self.split:
            return self._df
        tagged = (self._tag(self._df, self._layout)
                  .withColumn("_rows_before", F.coalesce(F.get("_offsets", F.col("_piece")), F.lit(0)))
                  .drop("_offsets").withColumn("_halo", F.lit(False)))
        if not self.halo:
            return tagged
        back = Window.partitionBy(*self.parts).orderBy(*[F.col(c).desc() for c in self.order])
        # No filter may name _piece: pushed below the search steps it would grow exponentially.
        # The copies made past a key's last piece stand alone there and are trimmed.
        tails = (tagged.where("_hot")
                 .withColumn("_rn", F.row_number().over(back))
                 .where(F.col("_rn") <= self.halo).drop("_rn")
                 .withColumn("_piece", F.col("_piece") + 1).withColumn("_halo", F.lit(True)))
        return tagged.unionByName(tails)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def trim(self, df: DataFrame, keep_piece: bool = False) -> DataFrame:
        """Remove halo rows and helper columns."""
        if not self.split:
            return df
        df = df.where(~F.col("_halo"))
        return df.drop("_halo") if keep_piece else df.drop(*_HELPERS)

    def running(self, df: DataFrame, value: Column, name: str, kind: str = "max") -> DataFrame:
        """Running ``max`` or ``sum`` of ``value``; ``df`` is trimmed but still has its piece.

        Pieces of a hot key first reduce to one row each; the running total over those rows is
        what the next piece starts from.
        """
        fold = {"max": F.max, "sum": F.sum}[kind]
        upto = self.window().rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn("_mark", value).withColumn(name, fold("_mark").over(upto))
        if not self.split:
            return out.drop("_mark")
        earlier = (Window.partitionBy(*self.keys).orderBy("_piece")
                   .rowsBetween(Window.unboundedPreceding, -1))
        carry = (out.where("_hot").groupBy(*self.parts)
                 .agg(fold("_mark").alias("_m"))
                 .withColumn("_carry", fold("_m").over(earlier))
                 .select(*self.parts, "_carry"))
        # one row per piece of a hot key: fewer than 2 * total / limit rows
        out = _look_up(out.drop("_mark"), carry, self.parts, "left")
        both = (F.greatest(F.col(name), F.col("_carry")) if kind == "max"
                else F.coalesce(F.col(name), F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        return out.withColumn(name, both).drop("_carry")

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(*_HELPERS) if self.split else df

    def numbered(self, pos: str = "_pos", n: str | None = "_n") -> DataFrame:
        """Zero-based position of each row in its key, and the key's row count."""
        rows = self.rows()
        if self.split:
            rows = rows.where(~F.col("_halo"))
        out = rows.withColumn(pos, F.row_number().over(self.window()) - 1)
        here = F.count(F.lit(1)).over(Window.partitionBy(*self.parts))
        if not self.split:
            return out.withColumn(n, here) if n else out
        out = out.withColumn(pos, F.col(pos) + F.col("_rows_before"))
        if n:
            out = out.withColumn(n, here).withColumn(n, F.coalesce("_key_rows", n))
        return out.drop(*_HELPERS)


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], hot: list | None = None,
           how: str = "inner") -> DataFrame:
    """Join per-key facts back to the rows; rows of hot keys meet theirs by broadcast.

    ``hot`` holds one key per ``limit`` rows at most, which bounds the broadcast part.
    """
    keys = list(keys)
    if not hot:
        return df.join(facts, keys, how)
    spark = df.sparkSession
    # one key per limit rows, and one fact row for each
    hot_df = F.broadcast(spark.createDataFrame([tuple(r[k] for k in keys) for r in hot],
                                               df.select(*keys).schema))
    cold = df.join(hot_df, keys, "left_anti").join(facts, keys, how)
    warm = df.join(hot_df, keys, "left_semi").join(
        F.broadcast(facts.join(hot_df, keys, "left_semi")), keys, how)
    return cold.unionByName(warm)
