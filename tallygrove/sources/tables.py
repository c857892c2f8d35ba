"""Table, SQL and catalog sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import run_with_params


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


# quoted text, comments, or a statement end
_SCRIPT = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)|;", re.S)


def statements(script: str) -> list[str]:
    """Statements of a script; a ``;`` inside quotes or comments does not end one."""
    marked = _SCRIPT.sub(lambda m: m.group(1) or "\0", script)
    return [s.strip() for s in marked.split("\0") if s.strip()]


def run_sql(spark: SparkSession, script: str, limit: int | None = None, params: Mapping | None = None, **views: DataFrame) -> DataFrame:
    """Run every statement in order; the last one's rows are the result."""
    out = None
    for s in statements(script):
        out = run_with_params(spark, s, params, **{k: v for k, v in views.items() if "{" + k + "}" in s})
    if out is None:
        raise ValueError("the script has no statement")
    return out.limit(limit) if limit else out


def lookup(df: DataFrame, order: Sequence[str | Column], first_row_only: bool = True, limit: int | None = None) -> DataFrame:
    """Rows in order: the first, the first ``limit``, or all."""
    rows = df.orderBy(*order)
    return rows.limit(1) if first_row_only else rows.limit(limit) if limit else rows


def sales_daily(sales: DataFrame) -> DataFrame:
    """Daily sales by region, channel and category of an order table."""
    return sales.groupBy("order_date", "region", "channel", "category").agg(
        F.round(F.sum("net_sales"), 2).alias("net_sales"), F.count(F.lit(1)).alias("orders"),
        F.round(F.sum("discount"), 2).alias("discount"), F.round(F.sum("cost"), 2).alias("cost"))


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(database, table, kind, position, column, type, partition) of the session catalog - metadata only."""
    rows = []
    for db in [database] if database else [d.name for d in spark.catalog.listDatabases()]:
        for t in spark.catalog.listTables(db):
            where = t.name if t.isTemporary else f"{db}.{t.name}"
            for i, c in enumerate(spark.catalog.listColumns(where)):
                rows.append((db, t.name, t.tableType, i, c.name, c.dataType, bool(c.isPartition)))
    schema = "database string, table string, kind string, position int, column string, type string, partition boolean"
    return spark.createDataFrame(rows, schema)
