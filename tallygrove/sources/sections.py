"""Market data files: exchange day files, sectioned price lists, rate documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import number_lines


def _num(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _by_prefix(df: DataFrame, *prefixes: str) -> Column:
    for c in df.columns:
        if c.strip().lower().startswith(prefixes):
            return F.col(f"`{c}`")
    return F.lit(None).cast("string")


def parse_equity_day(raw: DataFrame, day: dt.date) -> DataFrame:
    """Exchange end-of-day rows: padded names and values trimmed, ``-`` and blanks NULL, turnover in lacs, no row without close."""
    df = raw.toDF(*[c.strip().upper().replace(" ", "_") for c in raw.columns])
    pick = lambda c: _num(F.col(c)) if c in df.columns else F.lit(None).cast("double")
    # Fixed column names of the file.
    out = df.select(
        F.lit(day).alias("trade_date"), F.trim("SYMBOL").alias("symbol"), F.trim("SERIES").alias("series"),
        pick("PREV_CLOSE").alias("prev_close"), pick("OPEN_PRICE").alias("open"), pick("HIGH_PRICE").alias("high"),
        pick("LOW_PRICE").alias("low"), pick("LAST_PRICE").alias("last"), pick("CLOSE_PRICE").alias("close"),
        pick("AVG_PRICE").alias("avg_price"), pick("TTL_TRD_QNTY").alias("volume"), (pick("TURNOVER_LACS") * 1e5).alias("traded_value"),
        pick("NO_OF_TRADES").alias("trades"), pick("DELIV_QTY").alias("delivery_qty"), pick("DELIV_PER").alias("delivery_pct"))
    return out.where("close is not null")


def parse_index_day(raw: DataFrame, day: dt.date) -> DataFrame:
    """Index rows; columns are found by the start of their header."""
    p = lambda *n: _num(_by_prefix(raw, *n))
    out = raw.select(
        F.lit(day).alias("trade_date"), F.trim(_by_prefix(raw, "index name")).alias("index_name"),
        p("open index").alias("open"), p("high index").alias("high"), p("low index").alias("low"), p("closing index").alias("close"),
        p("change(%)", "change (%)").alias("change_pct"), p("p/e").alias("pe"), p("p/b").alias("pb"), p("div yield").alias("div_yield"))
    return out.where("close is not null")


def _carry(lines: DataFrame, values: dict[str, Column]) -> DataFrame:
    """For each name the last non-null value at or before each line of a file.

    Lines are swept inside chunks of a file; what a chunk inherits comes from one row per chunk.
    """
    names = list(values)
    d = lines.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_c", F.floor((F.col("_line") - 1) / 100_000))
    w = Window.partitionBy("_file", "_c").orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("_file").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.groupBy("_file", "_c").agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_line"))).alias(f"_e_{n}") for n in names])
    carry = edge.select("_file", "_c", *[F.last(f"_e_{n}", ignorenulls=True).over(across).alias(f"_e_{n}") for n in names])
    out = d.withColumns({f"_in_{n}": F.last(f"_v_{n}", ignorenulls=True).over(w) for n in names}).join(carry, ["_file", "_c"], "left")
    return out.select(*lines.columns, *[F.coalesce(f"_in_{n}", f"_e_{n}").alias(n) for n in names])


# Fixed patterns of fund lists.
KEEP_NAME = "(?i)growth"
DROP_NAME = "(?i)idcw|dividend|bonus|payout|reinvest"
CATEGORY_LINE = r"(?i)schemes?\s*\(|^(open ended|close ended|interval fund)"


def parse_sections(text: DataFrame, growth_only: bool = True) -> DataFrame:
    """Semicolon rows below category and fund-house headings, as typed rows.

    ``text`` is ``spark.read.text(path)``.  Headings and the column header line are carried forward per file.
    """
    t = number_lines(text).withColumn("value", F.trim("value")).where("value <> ''")
    heading = ~F.contains("value", F.lit(";"))
    is_category = heading & F.col("value").rlike(CATEGORY_LINE)
    header = F.contains("value", F.lit(";")) & F.startswith(F.lower("value"), F.lit("scheme code"))
    t = _carry(t, {
        "category": F.when(is_category, F.regexp_replace("value", r"\s+", " ")),
        "amc": F.when(heading & ~is_category, F.col("value")),
        "_header": F.when(header, F.lower("value")),
    })
    parts = F.transform(F.split("value", ";"), lambda x: F.trim(x))
    names = F.transform(F.split("_header", ";"), lambda x: F.trim(x))
    t = t.where(F.contains("value", F.lit(";")) & F.col("_header").isNotNull()).withColumns({"_p": parts, "_h": names})
    t = t.where(F.element_at("_p", 1).rlike(r"^\d+$"))

    def get(*prefixes: str) -> Column:
        test = lambda h: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(h, p))
        pairs = F.filter(F.arrays_zip(F.col("_h").alias("h"), F.col("_p").alias("p")), lambda z: test(z["h"]) & z["p"].isNotNull())
        return F.get(pairs, 0)["p"]

    out = t.select(
        F.element_at("_p", 1).cast("bigint").alias("scheme_code"), get("scheme name", "nav name").alias("scheme_name"),
        get("isin").alias("isin"), get("net asset value").try_cast("double").alias("nav"),
        F.try_to_timestamp(get("date"), F.lit("dd-MMM-yyyy")).cast("date").alias("nav_date"), "category", "amc")
    if growth_only:
        out = out.where(F.col("scheme_name").rlike(KEEP_NAME) & ~F.col("scheme_name").rlike(DROP_NAME))
    cat = F.coalesce("category", F.lit(""))
    out = out.withColumns({
        "fund_type": F.nullif(F.trim(F.regexp_extract(cat, r"\(\s*([A-Za-z ]+?) Scheme", 1)), F.lit("")),
        "sub_category": F.nullif(F.trim(F.regexp_extract(cat, r"-\s*([^)]+)\)", 1)), F.lit("")),
        "plan": F.when(F.col("scheme_name").rlike("(?i)direct"), "Direct").otherwise("Regular")})
    return out.where("nav > 0 and nav_date is not null")


def parse_rates(docs: DataFrame, body: str = "value", currency: str = "currency") -> DataFrame:
    """``{"rates": {day: {"INR": v}}}`` documents as long rows; yen are quoted per 100."""
    r = docs.select(currency, F.explode(F.from_json(F.get_json_object(body, "$.rates"), "map<string, map<string, double>>")).alias("day", "quotes"))
    yen = F.col(currency) == "JPY"
    return r.where(F.map_contains_key("quotes", F.lit("INR"))).select(
        F.col("day").cast("date").alias("rate_date"),
        F.concat(F.col(currency), F.lit("/INR"), F.when(yen, " (100)").otherwise("")).alias("pair"), F.col(currency).alias("currency"),
        (F.col("quotes")["INR"] * F.when(yen, 100).otherwise(1)).alias("rate"))
