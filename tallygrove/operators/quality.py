"""Quality rules in one pass, their verdicts, and reconciliation checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import is_blank
from .joins import orphans


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, between, in_set, regex, row_count, freshness, expression, custom_sql."""

    name: str
    kind: str
    column: str | None = None
    params: Mapping = field(default_factory=dict)
    severity: str = "fail"


def bad_row(rule: Rule) -> Column | None:
    """The condition that marks a bad row, or None for rules about the whole table."""
    p = rule.params
    if rule.kind == "expression":
        return ~F.coalesce(F.expr(p["expr"]), F.lit(False))
    if rule.column is None:
        return None
    c = F.col(f"`{rule.column}`")
    if rule.kind == "not_null":
        return is_blank(c)
    if rule.kind == "between":
        bad = F.lit(False)
        if p.get("min") not in (None, ""):
            bad = bad | (c < F.lit(p["min"]))
        if p.get("max") not in (None, ""):
            bad = bad | (c > F.lit(p["max"]))
        return c.isNotNull() & bad
    if rule.kind == "in_set":
        return c.isNotNull() & ~c.cast("string").isin([str(v) for v in p["values"]])
    if rule.kind == "regex":
        return c.isNotNull() & (F.regexp_extract(c.cast("string"), p["pattern"], 0) == "")
    return None


def _unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, copies beyond the first): counted by value so that no column is gathered in one place."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("e")).select("e.*")
    per = long.where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("column").agg((F.sum("n") - F.count(F.lit(1))).alias("bad"))


def run_rules(df: DataFrame, rules: Sequence[Rule], as_of=None) -> DataFrame:
    """One row per rule: bad rows, percent, value and status.

    Row rules, row count and freshness share one scan.  Uniqueness needs a shuffle by value; all unique
    rules share one, instead of several COUNT(DISTINCT) that would each multiply the rows.
    """
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    uniques = [r for r in rules if r.kind == "unique"]
    customs = [r for r in rules if r.kind == "custom_sql"]
    entries = []
    null_bad, null_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for i, r in enumerate(rules):
        if r.kind == "unique" or r.kind == "custom_sql":
            continue
        bad, value, age = null_bad, null_text, F.lit(None).cast("double")
        cond = bad_row(r)
        if cond is not None:
            bad = F.count_if(cond)
        elif r.kind == "freshness":
            newest = F.max(F.col(f"`{r.column}`").cast("timestamp"))
            value = F.date_format(newest, "yyyy-MM-dd HH:mm:ss")
            age = (F.unix_micros(now) - F.unix_micros(newest)) / 3.6e9
        elif r.kind == "row_count":
            value = F.count(F.lit(1)).cast("string")
        entries.append(F.struct(F.lit(i).alias("i"), F.count(F.lit(1)).alias("rows"), bad.alias("bad"), value.alias("value"), age.alias("age")))
    facts = df.agg(F.array(*entries).alias("r")).select(F.inline("r")) if entries else None
    if uniques:
        n = df.agg(F.count(F.lit(1))).scalar()
        counted = _unique_counts(df, sorted({r.column for r in uniques}))
        which = df.sparkSession.createDataFrame([(i, r.column) for i, r in enumerate(rules) if r.kind == "unique"], "i int, column string")
        u = which.join(counted, "column", "left").select("i", n.alias("rows"), F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad"), null_text.alias("value"), F.lit(None).cast("double").alias("age"))
        facts = u if facts is None else facts.unionByName(u)
    for r in customs:
        q = df.sparkSession.sql(r.params["sql"], t=df)
        one = q.limit(1).select(F.lit(rules.index(r)).alias("i"), F.lit(None).cast("bigint").alias("rows"), F.coalesce(F.col(q.columns[0]).cast("bigint"), F.lit(0)).alias("bad"),
                                null_text.alias("value"), F.lit(None).cast("double").alias("age"))
        facts = one if facts is None else facts.unionByName(one)
    return _verdicts(facts, rules)


def _verdicts(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    status = None
    pct = F.when(F.col("rows") > 0, 100.0 * F.col("bad") / F.col("rows")).otherwise(0.0)
    for i, r in enumerate(rules):
        p = r.params
        if r.kind == "row_count":
            n, ok = F.col("value").cast("bigint"), F.lit(True)
            if p.get("min") not in (None, ""):
                ok = ok & (n >= F.lit(p["min"]))
            if p.get("max") not in (None, ""):
                ok = ok & (n <= F.lit(p["max"]))
        elif r.kind == "freshness":
            ok = F.coalesce(F.col("age") <= F.lit(float(p["max_hours"])), F.lit(False))
        elif r.kind == "custom_sql":
            ok = F.col("bad") == 0
        else:
            ok = (F.col("bad") == 0) | (pct <= F.lit(float(p.get("max_bad_pct", 0))))
        verdict = F.when(ok, "pass").otherwise(r.severity)
        status = F.when(F.col("i") == i, verdict) if status is None else status.when(F.col("i") == i, verdict)
    text = lambda get: F.element_at(F.array(*[F.lit(get(r)) for r in rules]), F.col("i") + 1)
    no_pct = [i for i, r in enumerate(rules) if r.kind in ("row_count", "freshness", "custom_sql")]
    return facts.select(text(lambda r: r.name).alias("rule"), text(lambda r: r.kind).alias("kind"), text(lambda r: r.column).alias("column"), "bad",
                        F.when(~F.col("i").isin(no_pct), F.round(pct, 3)).alias("pct"), "value", status.alias("status"))


def run_status(results: DataFrame) -> DataFrame:
    """passed, warned, failed and the run's status: ERROR, FAILED, WARN or PASSED."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = results.agg(n("pass").alias("passed"), n("warn").alias("warned"), n("fail", "error").alias("failed"), n("error").alias("_e"))
    status = F.when(F.col("_e") > 0, "ERROR").when(F.col("failed") > 0, "FAILED").when(F.col("warned") > 0, "WARN").otherwise("PASSED")
    return out.withColumn("status", status).drop("_e")


def bad_samples(df: DataFrame, rule: Rule, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first bad rows of a row rule."""
    return df.where(bad_row(rule)).orderBy(*order).limit(n)


def duplicate_samples(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The most repeated values of a column that should be unique."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return g.orderBy(F.col("copies").desc(), column).limit(n)


# ---------------------------------------------------------------- reconciliation


def judge(left: Column, right: Column, tolerance_pct: float) -> Column:
    """pass within 1e-6 (relative) or the tolerance, warn up to 5 percent, else fail; one missing side is a warning."""
    gap = F.abs(left - right)
    pct = gap / F.coalesce(F.nullif(F.abs(right), F.lit(0.0)), F.lit(1.0)) * 100
    return (F.when(left.isNull() & right.isNull(), "pass").when(left.isNull() | right.isNull(), "warn")
            .when(gap <= 1e-6 * F.greatest(F.lit(1.0), F.abs(right)), "pass").when(pct <= tolerance_pct, "pass").when(pct <= 5, "warn").otherwise("fail"))


def check_unique_key(df: DataFrame, key: str, name: str) -> DataFrame:
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).cast("double").alias("left")).select(
        F.lit(name).alias("check"), F.lit("unique_key").alias("kind"), "left", F.lit(None).cast("double").alias("right"),
        F.when(F.col("left") == 0, "pass").otherwise("fail").alias("status"))


def check_orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str, name: str) -> DataFrame:
    n = orphans(fact, fk, dim, pk).agg(F.count(F.lit(1)).cast("double").alias("left"))
    rows = fact.agg(F.count(F.lit(1))).scalar()
    return n.select(F.lit(name).alias("check"), F.lit("orphans").alias("kind"), "left", (100 * F.col("left") / F.nullif(rows, F.lit(0))).alias("right"),
                    F.when(F.col("left") == 0, "pass").otherwise("warn").alias("status"))


def check_totals(dataset: DataFrame, alias: str, source: DataFrame, column: str | None, name: str, tolerance_pct: float = 0.05) -> DataFrame:
    """The dataset's total against the source's (or its row count when no column is named)."""
    right = source.agg((F.sum(column) if column else F.count(F.lit(1))).cast("double")).scalar()
    one = dataset.agg(F.sum(alias).cast("double").alias("left")).withColumn("right", right)
    return one.select(F.lit(name).alias("check"), F.lit("totals").alias("kind"), "left", "right",
                      judge(F.col("left"), F.col("right"), tolerance_pct if column else 0).alias("status"))


def last_runs(runs: DataFrame, table: str = "object", time: str = "time") -> DataFrame:
    """The latest run of every table."""
    rest = [c for c in runs.columns if c not in (table, time)]
    return runs.groupBy(table).agg(F.max_by(F.struct(*rest), time).alias("r"), F.max(time).alias(time)).select(table, time, "r.*")
