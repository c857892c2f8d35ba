"""Usage costing, budgets and invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..semantics import label


def usage_rows(usage: DataFrame, clusters: DataFrame, month: str) -> DataFrame:
    """Node-hours, cost and charge per cluster and user of a month.

    Usage is added up before the join: local clusters count attached hours, others executor hours.
    """
    u = usage.where(F.date_format("day", "yyyy-MM") == month).groupBy("cluster_id", "user").agg(F.sum("kernel_minutes").alias("km"), F.sum("executor_minutes").alias("em"))
    c = clusters.select("cluster_id", F.col("name").alias("cluster"), "cloud", "price_per_node_hour", "markup_pct")
    j = u.join(c, "cluster_id", "left")
    hours = F.coalesce(F.when(F.col("cloud") == "local", F.col("km")).otherwise(F.col("em")), F.lit(0.0)) / 60.0
    cost = hours * F.coalesce("price_per_node_hour", F.lit(0.0))
    return j.select("cluster_id", F.coalesce("cluster", F.concat(F.lit("(deleted "), F.col("cluster_id").cast("string"), F.lit(")"))).alias("cluster"), "user",
                    F.round(F.coalesce("km", F.lit(0.0)) / 60.0, 2).alias("attached_hours"), F.round(hours, 2).alias("node_hours"), F.round(cost, 2).alias("cost"),
                    F.round(cost * (1 + F.coalesce("markup_pct", F.lit(0.0)) / 100), 2).alias("charge"))


def budget_status(budgets: DataFrame, rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Spend, percent, warned and exceeded per budget.

    ``budgets``: name, scope (all, cluster, user, company), scope_value, basis (cost, charge), amount, warn_pct.
    Each usage row is opened into its scopes, added up per scope, and joined by equality.
    """
    j = rows.join(companies.select(F.lower("user").alias("_u"), "company"), F.lower("user") == F.col("_u"), "left")
    s = lambda scope, c: F.struct(F.lit(scope).alias("scope"), F.lower(c.cast("string")).alias("value"))
    scopes = F.array_distinct(F.array(s("all", F.lit("")), s("cluster", F.col("cluster_id")), s("cluster", F.col("cluster")), s("user", F.col("user")), s("company", F.col("company"))))
    per = j.select("cost", "charge", F.explode(scopes).alias("s")).groupBy("s.scope", "s.value").agg(F.sum("cost").alias("cost"), F.sum("charge").alias("charge"))
    b = budgets.withColumn("value", F.when(F.col("scope") == "all", "").otherwise(F.lower("scope_value")))
    out = b.join(per, ["scope", "value"], "left")
    spend = F.coalesce(F.when(F.col("basis") == "charge", F.col("charge")).otherwise(F.col("cost")), F.lit(0.0))
    pct = F.when(F.col("amount") != 0, 100 * spend / F.col("amount")).otherwise(0.0)
    return out.select("name", F.round(spend, 2).alias("spend"), F.round(pct, 1).alias("pct"), (pct >= F.col("warn_pct")).alias("warned"), (pct >= 100).alias("exceeded"))


def invoice_lines(rows: DataFrame, companies: DataFrame, month: str, by: str = "company", tax_pct: float = 0.0) -> DataFrame:
    """Lines per customer and cluster with subtotal, tax and total rows (cluster NULL) and a repeatable invoice number."""
    if by == "company":
        c = companies.select(F.lower("user").alias("_u"), "company")
        d = rows.join(c, F.lower("user") == F.col("_u"), "left").withColumn("customer", F.coalesce("company", F.nullif("user", F.lit("")), F.lit("system")))
    else:
        d = rows.withColumn("customer", label(F.nullif("user", F.lit("")), "system"))
    g = d.rollup("customer", "cluster").agg(F.sum("node_hours").alias("hours"), F.sum("charge").alias("amount"), F.grouping_id().alias("_g")).where("_g <= 1")
    total = F.col("_g") == 1
    number = F.concat(F.lit(month.replace("-", "") + "-"), F.lpad((F.crc32(F.col("customer").cast("binary")) % 100000).cast("string"), 5, "0"))
    tax = F.when(total, F.col("amount") * tax_pct / 100)
    return g.select("customer", number.alias("number"), F.when(total, "total").otherwise("line").alias("kind"), "cluster", F.round("hours", 2).alias("hours"), F.round("amount", 2).alias("amount"),
                    F.round(tax, 2).alias("tax"), F.round(F.when(total, F.col("amount") + tax), 2).alias("total"))
