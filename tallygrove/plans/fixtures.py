"""The given tables, and the star-shaped fact that the dashboard operators run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with day, place, category and measures.

    No broadcast hints: Spark broadcasts a side when its statistics (or AQE's measured size)
    are below the threshold and shuffles otherwise, so the plan follows the data size.
    """
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer")
    place = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    money = F.col("l_extendedprice").cast("decimal(12,2)")
    keep = F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(4,2)")
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("c_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.col("n_name").alias("site"),
            F.col("r_name").alias("zone"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderpriority").alias("category"),
            F.col("o_orderstatus").alias("status"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_extendedprice").alias("amount"),
            (money * keep).alias("net"),
            F.col("l_quantity").alias("qty"),
            F.col("l_discount").alias("rate"),
        )
    )


FACT = """
fact AS (
  SELECT o_orderkey AS order_id, c_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day,
         n_name AS site, r_name AS zone, c_mktsegment AS segment, o_orderpriority AS category,
         o_orderstatus AS status, l_returnflag AS flag, l_suppkey AS supplier_id, l_partkey AS part_id,
         l_extendedprice AS amount,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(5,2)) - CAST(l_discount AS DECIMAL(4,2))) AS net,
         l_quantity AS qty, l_discount AS rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def rnd(c, n: int, name: str):
    return F.round(c, n).alias(name)


def i64(c, name: str):
    return c.cast("bigint").alias(name)
