"""Relational source with partitioned reads, and landing from a staging schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..semantics import literal_for


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, cursor: str | None = None,
              watermark=None, partition: tuple[str, int, int, int] | None = None, fetch_size: int = 50_000, **options) -> DataFrame:
    """A table or a query over JDBC.

    The cursor predicate is a DataFrame filter, which Spark pushes into the database query.  ``partition`` is
    (column, lower, upper, parts): that many range queries run in parallel instead of one connection.
    """
    source = f"({query}) q" if query else table
    r = spark.read.format("jdbc").option("url", url).option("dbtable", source).option("fetchsize", fetch_size)
    for k, v in options.items():
        r = r.option(k, v)
    if partition:
        c, lo, hi, n = partition
        r = r.option("partitionColumn", c).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", n)
    df = r.load()
    return df.where(F.col(cursor) > literal_for(df, cursor, watermark)) if cursor and watermark is not None else df


# Fixed names of the staging schema's bookkeeping columns.
STAGED_AT = "_airbyte_extracted_at"
STAGED_META = ["_airbyte_raw_id", "_airbyte_meta", "_airbyte_generation_id"]


def land(staged: DataFrame, mark=None) -> DataFrame:
    """Rows newer than the mark, with ``_synced_at`` instead of the bookkeeping columns."""
    if mark is not None:
        staged = staged.where(F.col(STAGED_AT) > literal_for(staged, STAGED_AT, mark))
    return staged.drop(*STAGED_META).withColumnRenamed(STAGED_AT, "_synced_at")


def land_tables(staged: Mapping[str, DataFrame], prefix: str, marks: Mapping[str, object]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(rows to append, one-row new mark) for every staged table whose name starts with the prefix."""
    out = {}
    for name, df in staged.items():
        if name.startswith(prefix):
            rows = land(df, marks.get(name))
            out[name[len(prefix):]] = (rows, df.agg(F.max(STAGED_AT).alias("mark")))
    return out


def tables_with_prefix(names: Sequence[str], prefix: str) -> list[str]:
    return sorted(n for n in names if n.startswith(prefix))
