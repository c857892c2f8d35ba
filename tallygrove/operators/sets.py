"""Exact distinct sets that can be merged: bitmaps by bucket of 64 ids.

A set is rows of (set, bucket, bits); the sets of two days are one set after the bits of equal buckets are or-ed, so
daily sets give the exact distinct count of any range, and counting several columns is one additive aggregate.  The
buckets are as small as a word, since the sets of a day and a location are sparse: a row never holds less than an id,
while the 4 KB of ``bitmap_construct_agg`` would mostly be empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ranking import global_row_number
from ..semantics import join_on


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with a whole number for every value of a column, null staying null: the value itself, or its place among all values."""
    if isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(name, F.col(column).cast("long"))
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return join_on(df, global_row_number(values, [F.col(column)], name), [column], "left")


def distinct_sets(df: DataFrame, groups: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """``groups``, ``set``, ``bucket``, ``bits`` for several columns (set name -> whole-number column); bits are set in each task before rows move."""
    ids = F.explode(F.array(*[F.struct(F.lit(n).alias("set"), F.col(c).cast("long").alias("id")) for n, c in columns.items()]))
    long = df.select(*groups, ids.alias("e")).where("e.id is not null").select(*groups, "e.set", F.shiftright("e.id", 6).alias("bucket"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("e.id").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    return long.groupBy(*groups, "set", "bucket").agg(F.bit_or("bit").alias("bits"))


def merge_sets(sets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sets of coarser groups: of a range of days, of all locations."""
    return sets.groupBy(*groups, "set", "bucket").agg(F.bit_or("bits").alias("bits"))


def set_sizes(sets: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Distinct values of each named set by group; groups without any have no row."""
    n = lambda name: F.coalesce(F.sum(F.when(F.col("set") == name, F.bit_count("bits"))), F.lit(0)).alias(name)
    return sets.groupBy(*groups).agg(*[n(name) for name in names])
