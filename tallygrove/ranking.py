"""Global order without a single-task window.

A window without PARTITION BY sends every row to one task, and a window over a hot
group does the same for that group.  Here rows are range-partitioned on the full sort
key (so equal leading values can still be split by the later keys), numbered inside
each range partition, and shifted by the row counts of the earlier partitions - a
list as long as the number of partitions.  Counted values and rows with a number that
follows the order need no stored set: approximate quantiles cut them into ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .semantics import join_on
from .session import cut_lineage

_LOW = (1 << 33) - 1  # monotonically_increasing_id keeps the row index in the low 33 bits


def _range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    return stored.withColumns(
        {"_pid": F.shiftright("_mid", 33), "_idx": F.col("_mid").bitwiseAND(F.lit(_LOW))}
    ).drop("_mid")


def _earlier(parts: DataFrame, amount: str) -> DataFrame:
    # one row per range partition, so this window is as small as the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_pid", F.coalesce(F.sum(amount).over(w), F.lit(0)).alias("_before"))


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """1-based position of every row in the given total order."""
    rows = _range_sorted(df, order)
    starts = _earlier(rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")), "_n")
    return (
        rows.join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_before") + F.col("_idx") + 1)
        .drop("_pid", "_idx", "_before")
    )


def group_row_number(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """1-based position inside each group, without gathering a group in one task."""
    ranked = global_row_number(df, [*[F.col(g).asc_nulls_first() for g in groups], *order], "_all")
    first = ranked.groupBy(*groups).agg(F.min("_all").alias("_first"))
    return join_on(ranked, first, groups).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_all", "_first")


def running_total(df: DataFrame, order: Sequence[Column], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over this row and all earlier rows."""
    rows = _range_sorted(df, order)
    starts = _earlier(rows.groupBy("_pid").agg(F.sum(amount).alias("_n")), "_n")
    w = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_run", F.sum(amount).over(w))
        .join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_before") + F.col("_run"))
        .drop("_pid", "_idx", "_run", "_before")
    )


def _bucketed(df: DataFrame, groups: Sequence[str], value: Column, buckets: int) -> DataFrame:
    """``df`` with ``_bucket``, the range of values a row lies in: 0 for null, then by approximate quantiles of its group, rising with the value."""
    cuts = F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_cuts")
    if groups:
        cut = join_on(df, df.groupBy(*groups).agg(cuts), list(groups))
    else:
        cut = df.withColumn("_cuts", df.agg(cuts).scalar())
    # null sorts first
    at = F.when(value.isNull(), 0).otherwise(1 + F.coalesce(F.size(F.filter("_cuts", lambda e: e < value)), F.lit(0)))
    return cut.withColumn("_bucket", at).drop("_cuts")


def running_in_groups(counts: DataFrame, groups: Sequence[str], value: str, amounts: Sequence[str], buckets: int = 64) -> DataFrame:
    """``counts`` with ``<amount>_below`` (sum over smaller values of the group) and ``<amount>_all`` (sum over the group).

    One row per (groups, value), null values first.  A group is summed up in ranges of its values and the ranges' sums
    are joined back, so a large group is many tasks; nothing runs before the result is asked for.
    """
    groups = list(groups)
    cut = _bucketed(counts, groups, F.col(value), buckets)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumns({f"_in_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts})
    sums = cut.groupBy(*groups, "_bucket").agg(*[F.sum(a).alias(f"_s_{a}") for a in amounts])
    # as many rows per group as there are ranges
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    sums = sums.select(*groups, "_bucket", *[F.coalesce(F.sum(f"_s_{a}").over(earlier), F.lit(0)).alias(f"_b_{a}") for a in amounts], *[F.sum(f"_s_{a}").over(whole).alias(f"{a}_all") for a in amounts])
    out = join_on(rows, sums, [*groups, "_bucket"]).withColumns({f"{a}_below": F.col(f"_in_{a}") + F.col(f"_b_{a}") for a in amounts})
    return out.drop("_bucket", *[f"_in_{a}" for a in amounts], *[f"_b_{a}" for a in amounts])


def bucketed_row_number(df: DataFrame, near: Column, order: Sequence[Column], name: str = "row_number", buckets: int = 64) -> DataFrame:
    """1-based position of every row in a total order, without storing anything; ``near`` is a number that never falls along the order."""
    cut = _bucketed(df.withColumn("_near", near), [], F.col("_near"), buckets).drop("_near")
    rows = cut.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return join_on(rows, sizes, ["_bucket"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_before")


def positions(counts: DataFrame, groups: list[str], value: str, n: str = "_n") -> DataFrame:
    """For counted values: rows of the group with a smaller value (``_smaller``), with this value (``_n``), in all (``_size``).

    ``counts`` holds one row per (groups, value) with its row count, so equal values never travel as single rows.
    """
    run = running_in_groups(counts.select(*groups, value, F.col(n).alias("_n")), groups, value, ["_n"])
    return run.select(*groups, value, F.col("_n_below").alias("_smaller"), "_n", F.col("_n_all").alias("_size"))


def _value_positions(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return positions(df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n")), groups, value)


def quantiles(counts: DataFrame, groups: list[str], value: str, points: dict[str, float], n: str = "_n") -> DataFrame:
    """Exact quantiles with linear interpolation per group, from counted values.

    The built-in exact percentile keeps every distinct value of a group in one task; here a group may be
    spread over any number of tasks.  ``points`` maps result name -> quantile; ``rows`` is the group size.
    """
    pos = positions(counts.where(F.col(value).isNotNull()), groups, value, n)
    at = lambda k: F.max(F.when((F.col("_smaller") <= k) & (k < F.col("_smaller") + F.col("_n")), F.col(value)))
    aggs = []
    for name, q in points.items():
        exact = (F.col("_size") - 1) * F.lit(q)
        aggs += [at(F.floor(exact)).alias(f"_lo_{name}"), at(F.ceil(exact)).alias(f"_hi_{name}"), F.max(exact - F.floor(exact)).alias(f"_f_{name}")]
    g = pos.groupBy(*groups).agg(*aggs, F.sum("_n").alias("rows"))
    mix = lambda name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")
    return g.select(*groups, "rows", *[mix(name).alias(name) for name in points])


def percent_ranks(df: DataFrame, key: list[str], groups: list[str], measures: dict[str, str]) -> DataFrame:
    """``percent_rank`` (nulls first) of several measures inside ``groups``, one row per ``key``.

    ``measures`` maps result name -> column.  All measures share one set of shuffles: they are
    stacked to long form, counted by value (equal values collapse before the shuffle) and ranked together.
    """
    pairs = ", ".join(f"'{out}', cast(`{src}` as double)" for out, src in measures.items())
    long = df.select(*key, *groups, F.expr(f"stack({len(measures)}, {pairs}) as (_m, _v)"))
    pos = _value_positions(long, [*groups, "_m"], "_v")
    ranked = join_on(long, pos, [*groups, "_m", "_v"]).select(
        *key,
        "_m",
        F.when(F.col("_size") > 1, F.col("_smaller") / (F.col("_size") - 1)).otherwise(F.lit(0.0)).alias("_pr"),
    )
    return ranked.groupBy(*key).agg(*[F.max(F.when(F.col("_m") == out, F.col("_pr"))).alias(out) for out in measures])


def average_ranks(df: DataFrame, key: list[str], columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """Rank from 1 with ties sharing their mean rank, for several columns; NULL stays NULL."""
    groups = groups or []
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.select(*key, *groups, F.expr(f"stack({len(columns)}, {pairs}) as (_m, _v)")).where("_v is not null")
    pos = _value_positions(long, [*groups, "_m"], "_v")
    ranked = join_on(long, pos, [*groups, "_m", "_v"]).select(
        *key, *groups, "_m", (F.col("_smaller") + (F.col("_n") + 1) / 2).alias("_r")
    )
    return ranked.groupBy(*key, *groups).agg(*[F.max(F.when(F.col("_m") == c, F.col("_r"))).alias(c) for c in columns])
