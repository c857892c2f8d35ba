"""Dashboard aggregation: charts, KPIs, top lists, funnels, flows, heat maps, play frames.

Every chart first reduces its rows with one partial-aggregating ``groupBy``; ranking,
"Other" rows and shares then run on the small grouped result.  Grand totals are scalar
subqueries and top lists are ``orderBy.limit`` (at most n rows), so neither needs a
window over all groups.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ranking import global_row_number, quantiles
from ..semantics import MISSING, OTHER, RATE_LIKE, aggregate, change, col, label, natural_key, total
from .filters import Days, bucket, overview_grain, split_periods


@dataclass(frozen=True)
class ChartSpec:
    y: Sequence[str]
    x: str | None = None
    series: str | None = None
    agg: str = "sum"
    sort: str = "label"
    top: int = 0
    grain: str | None = None


def _axis(c, grain: str | None, null: str = "(blank)") -> Column:
    return label(bucket(c, grain) if grain else c, null)


def _ordered(df: DataFrame, sort: str, name: str = "label") -> DataFrame:
    if sort == "value_desc":
        return df.orderBy(F.col("_total").desc(), F.col(name))
    if sort == "value_asc":
        return df.orderBy(F.col("_total").asc(), F.col(name))
    return df.orderBy(*natural_key(name))


def chart(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """Long chart data (label, series, value); without x one row per measure."""
    if spec.x is None:
        cells = df.agg(*[aggregate(spec.agg, y).alias(y) for y in spec.y])
        return _unpivot(cells.withColumn("label", F.lit("")), spec.y)
    x = _axis(spec.x, spec.grain).alias("label")
    if spec.series:
        y = spec.y[0]
        cells = df.groupBy(x, label(spec.series).alias("series")).agg(aggregate(spec.agg, y).cast("double").alias("value"))
        totals = cells.groupBy("label").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("_total"))
        totals = _top(totals, spec)
        return _ordered(cells.join(totals, "label"), spec.sort).select("label", "series", "value")
    wide = df.groupBy(x).agg(*[aggregate(spec.agg, y).cast("double").alias(y) for y in spec.y])
    wide = wide.withColumn("_total", reduce(lambda a, b: a + b, [F.coalesce(F.col(y), F.lit(0.0)) for y in spec.y]))
    return _unpivot(_top(wide, spec), spec.y)


def _top(totals: DataFrame, spec: ChartSpec) -> DataFrame:
    return _ordered(totals, spec.sort).limit(spec.top) if spec.top > 0 else totals


def _unpivot(wide: DataFrame, ys: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{y}', cast(`{y}` as double)" for y in ys)
    return wide.select("label", F.expr(f"stack({len(ys)}, {pairs}) as (series, value)"))


def group_measures(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Several labelled keys with several measures; ``measures`` maps name -> (aggregation, column)."""
    return df.groupBy(*[label(k).alias(k) for k in keys]).agg(*[aggregate(a, c).alias(n) for n, (a, c) in measures.items()])


def viewer_chart(df: DataFrame, x: str, y: str, agg: str, by: str | None = None, is_date: bool = False,
                 max_series: int | None = None, max_labels: int | None = None) -> DataFrame:
    """Table-viewer chart: dates cut to the day, missing keys labelled, largest first; all series and labels unless limits are given."""
    keys = [label(F.col(x).cast("date") if is_date else x, MISSING).alias("label")] + ([label(by, MISSING).alias("series")] if by else [])
    names = ["label", "series"] if by else ["label"]
    if agg == "median":
        counts = df.select(*keys, F.col(y).cast("double").alias("v")).groupBy(*names, "v").agg(F.count(F.lit(1)).alias("_n"))
        out = quantiles(counts, names, "v", {"value": 0.5}).drop("rows")
        if by and max_series:
            out = out.join(counts.groupBy(*names).agg(F.sum("_n").alias("_n")), names)
    else:
        out = df.groupBy(*keys).agg(aggregate(agg, y).cast("double").alias("value"), F.count(F.lit(1)).alias("_n"))
    if not by:
        out = out.select("label", "value").orderBy(F.col("value").desc_nulls_last(), "label")
        return out.limit(max_labels) if max_labels else out
    if max_series:
        kept = out.groupBy("series").agg(F.sum("_n").alias("_n")).orderBy(F.col("_n").desc(), "series").limit(max_series)
        out = out.join(kept.select("series"), "series", "left_semi")
    return out.select("label", "series", "value")


def kpi(df: DataFrame, y: str | None, agg: str = "sum", name: str = "value") -> DataFrame:
    return df.agg(aggregate(agg, y).alias(name))


def kpi_compare(df: DataFrame, day: str, y: str, agg: str, cur: Days, prev: Days | None = None,
                target: float | None = None, lower_is_better: bool = False) -> DataFrame:
    """One KPI against the previous period, last year, or a target, from a single scan."""
    if target is not None:
        one = df.where(cur.holds(day)).agg(aggregate(agg, y).cast("double").alias("cur")).withColumn("prev", F.lit(float(target)))
    elif prev is None:
        one = df.where(cur.holds(day)).agg(aggregate(agg, y).cast("double").alias("cur")).withColumn("prev", F.lit(None).cast("double"))
    else:
        part = split_periods(df, day, {"cur": cur, "prev": prev})
        per = part.groupBy("period").agg(aggregate(agg, y).cast("double").alias("v"))
        one = per.agg(
            F.max(F.when(F.col("period") == "cur", F.col("v"))).alias("cur"),
            F.max(F.when(F.col("period") == "prev", F.col("v"))).alias("prev"),
        )
    out = one.withColumn("change", change("cur", "prev"))
    up = F.col("change") > 0
    good = ~up if lower_is_better else up
    return out.withColumn("tone", F.when(F.col("change").isNull() | (F.abs("change") < 0.0005), "flat").when(good, "good").otherwise("bad"))


def year_before(w: Days) -> Days:
    """The same dates one year earlier (29 February becomes the 28th)."""
    def shift(d):
        try:
            return d.replace(year=d.year - 1)
        except ValueError:
            return d.replace(year=d.year - 1, day=28)

    return Days(shift(w.start), shift(w.end))


def mixed_measures(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rate-like columns are averaged, all others added up."""
    pick = lambda c: "avg" if re.search(RATE_LIKE, c, re.I) else "sum"
    return group_measures(df, keys, {c: (pick(c), c) for c in columns})


@dataclass(frozen=True)
class ProfiledColumn:
    name: str
    kind: str
    distinct: int


def plan_summary(columns: Sequence[ProfiledColumn], days: int, limit: int | None = None, categories: int | None = None, values: int | None = None, measures: int | None = None) -> tuple[list[str], list[str], int]:
    """Categories by rising number of values, and measures: all, or as many as the limits leave (``limit`` holds for days x values)."""
    kept, size = [], max(1, days)
    for c in sorted((c for c in columns if c.kind == "cat"), key=lambda c: (c.distinct, c.name)):
        if (categories is None or len(kept) < categories) and (values is None or c.distinct <= values) and (limit is None or size * c.distinct <= limit):
            kept.append(c.name)
            size *= c.distinct
    return kept, [c.name for c in columns if c.kind == "num"][:measures], size


def planned_summary(df: DataFrame, day: str, grain: str | None = None, **limits) -> DataFrame:
    """The summary table of a fact: its text and boolean columns as categories, its numbers as measures, by day, week or month.

    ``limits`` go to ``plan_summary``; without them every category stays.  Without ``grain`` the calendar span decides
    (``overview_grain``), never the size of the table.
    """
    span = df.agg(F.datediff(F.max(day), F.min(day)).alias("d")).first()["d"]
    days = 1 + (span or 0)
    kinds = {f.name: "num" if isinstance(f.dataType, T.NumericType) else "cat" for f in df.schema if f.name != day and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))}
    cats = [c for c, kind in kinds.items() if kind == "cat"]
    sizes = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in cats]).first().asDict() if cats else {}  # one row
    kept, nums, _ = plan_summary([ProfiledColumn(c, kind, sizes.get(c, 0)) for c, kind in kinds.items()], days, **limits)
    return summary(df, day, kept, nums, grain or overview_grain(days))


def summary(df: DataFrame, day: str, cats: Sequence[str], nums: Sequence[str], grain: str = "day") -> DataFrame:
    """Daily (weekly, monthly) summary table: measures by day and categories, plus the record count."""
    d = F.col(day).cast("date")
    key = d if grain == "day" else F.trunc(d, grain)
    aggs = [(F.avg(n) if re.search(RATE_LIKE, n, re.I) else F.sum(n)).alias(n) for n in nums]
    return df.groupBy(key.alias(day), *cats).agg(*aggs, F.count(F.lit(1)).alias("records"))


# ---------------------------------------------------------------- top lists with a remainder


def top_with_other(grouped: DataFrame, name: str, value: str, n: int, other: str = OTHER) -> DataFrame:
    """The n largest groups and one row that adds up all the others; totals are unchanged."""
    top = grouped.orderBy(F.col(value).desc_nulls_last(), F.col(name)).limit(n).select(F.col(name).alias("_keep"))
    marked = grouped.join(F.broadcast(top), F.col(name).eqNullSafe(F.col("_keep")), "left")  # at most n rows
    return (
        marked.groupBy(F.coalesce("_keep", F.lit(other)).alias(name), F.col("_keep").isNull().alias("is_other"))
        .agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("members"))
    )


def donut(df: DataFrame, x: str, y: str, agg: str = "sum", top: int = 8) -> DataFrame:
    """Positive slices; beyond ``top`` slices the smallest become one "Other" slice."""
    g = df.groupBy(label(x).alias("label")).agg(aggregate(agg, y).cast("double").alias("value")).where("value > 0")
    n = g.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = top_with_other(g, "label", "value", max(2, top) - 1)
    last = g.orderBy(F.col("value").desc(), "label").limit(max(2, top)).select("label", "value", F.lit(False).alias("is_other"))
    few = last.where(n <= max(2, top))
    many = first.select("label", "value", "is_other").where(n > max(2, top))
    return few.unionByName(many)


def category_list(df: DataFrame, x: str, y: str, agg: str = "sum", top: int | None = None) -> DataFrame:
    """Ranked categories with their share of the positive total (null where values do not add up); beyond ``top`` rows the rest is one."""
    g = df.groupBy(label(x).alias("label")).agg(aggregate(agg, y).cast("double").alias("value")).where("value is not null")
    ranked = g.orderBy(F.col("value").desc(), "label")
    facts = g.agg(F.sum(F.greatest("value", F.lit(0.0))).alias("t"), F.count(F.lit(1)).alias("n"))
    whole, n = facts.select("t").scalar(), facts.select("n").scalar()
    if agg in ("avg", "min", "max"):
        row = lambda d, name, other: d.select(name.alias("label"), "value", F.lit(None).cast("double").alias("share"), F.lit(other).alias("is_other"))
        if top is None:
            return row(g, F.col("label"), False)
        head = ranked.limit(top - 1)
        rest = df.withColumn("_label", label(x)).join(F.broadcast(head.select(F.col("label").alias("_keep"))), F.col("_label") == F.col("_keep"), "left_anti")  # fewer than top rows
        rest = rest.agg(aggregate(agg, y).cast("double").alias("value")).where(n > top)
        few, many = row(ranked.limit(top).where(n <= top), F.col("label"), False), row(head.where(n > top), F.col("label"), False)
        return few.unionByName(many).unionByName(row(rest, F.concat(F.lit("Other ("), n - (top - 1), F.lit(")")), True))
    few = (g if top is None else ranked.limit(top).where(n <= top)).withColumn("is_other", F.lit(False)).withColumn("members", F.lit(1).cast("bigint"))
    both = few.select("label", "value", "is_other", "members")
    if top is not None:
        both = both.unionByName(top_with_other(g, "label", "value", top - 1).where(n > top).select("label", "value", "is_other", "members"))
    name = F.when(F.col("is_other"), F.concat(F.lit("Other ("), F.col("members"), F.lit(")"))).otherwise(F.col("label"))
    return both.select(name.alias("label"), "value", F.coalesce(F.greatest("value", F.lit(0.0)) / F.nullif(whole, F.lit(0.0)), F.lit(0.0)).alias("share"), "is_other")


def by_period(df: DataFrame, day: str, x: str, y: str, agg: str, cur: Days, prev: Days) -> DataFrame:
    """(label, value, prev): both windows in one scan, distinct counts included."""
    part = split_periods(df, day, {"cur": cur, "prev": prev})
    cells = part.groupBy(label(x).alias("label"), "period").agg(aggregate(agg, y).cast("double").alias("v"))
    return cells.groupBy("label").agg(
        F.max(F.when(F.col("period") == "cur", F.col("v"))).alias("value"),
        F.max(F.when(F.col("period") == "prev", F.col("v"))).alias("prev"),
    )


def top_list(df: DataFrame, day: str, x: str, y: str, agg: str, cur: Days, prev: Days, top: int = 8, lower_is_better: bool = False) -> DataFrame:
    """Rank, value, growth against the previous period and tone for the n largest."""
    best = (by_period(df, day, x, y, agg, cur, prev).where("value is not null")
            .orderBy(F.col("value").desc(), "label").limit(top))
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), "label")))  # <= top rows
    out = out.withColumn("growth", change("value", "prev"))
    good = (F.col("growth") < 0) if lower_is_better else (F.col("growth") > 0)
    tone = F.when(F.col("growth").isNull() | (F.abs("growth") < 0.0005), "flat").when(good, "good").otherwise("bad")
    return out.withColumn("tone", tone)


def funnel(df: DataFrame, stage: str, y: str | None, agg: str = "sum", top: int | None = None, sort: str = "value") -> DataFrame:
    """All stages, or the first ``top``, with their share of the first and of the previous stage."""
    g = df.groupBy(label(stage).alias("stage")).agg(aggregate(agg, y).cast("double").alias("value")).where("value is not null")
    order = natural_key("stage") if sort == "label" else [F.col("value").desc(), F.col("stage").asc()]
    placed = global_row_number(g.orderBy(*order).limit(top) if top else g, order, "position")
    before = placed.select((F.col("position") + 1).alias("position"), F.col("value").alias("_before"))
    first = placed.where("position = 1").agg(F.max("value")).scalar()
    return placed.join(before, "position", "left").select(
        "position", "stage", "value", (F.col("value") / first).alias("of_first"), (F.col("value") / F.nullif("_before", F.lit(0.0))).alias("of_previous"))


def heatmap(df: DataFrame, x: Column | str, y: Column | str, value: str | None, agg: str = "sum", max_x: int | None = None, max_y: int | None = None) -> DataFrame:
    """The cells that have a value; with both ``max_x`` and ``max_y`` the whole matrix of so many axis values at most, first ones in calendar or natural order, zero where a cell has none.

    Only a matrix whose sides are bounded is filled: without bounds, cells that are not listed are zero.
    """
    cells = df.groupBy(label(x).alias("x"), label(y).alias("y")).agg(aggregate(agg, value).cast("double").alias("value"))
    axis = lambda c, n: (lambda d: d.orderBy(*natural_key(c)).limit(n) if n else d)(cells.select(c).distinct())
    if not (max_x and max_y):
        kept = cells.join(axis("x", max_x), "x", "left_semi") if max_x else cells
        return kept.join(axis("y", max_y), "y", "left_semi").select("x", "y", "value") if max_y else kept.select("x", "y", "value")
    # every row label gets the column labels as one array of ``max_y``: the matrix asked for, not a join of rows
    columns = axis("y", max_y).agg(F.collect_list("y").alias("ys")).scalar()
    grid = axis("x", max_x).select("x", F.explode(columns).alias("y"))
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def flows(df: DataFrame, source: str, target: str, y: str, agg: str = "sum", top: int | None = None, self_loops: bool = True) -> DataFrame:
    """Positive source -> target sums, largest first; all of them unless ``top`` is given."""
    g = df.groupBy(label(source).alias("source"), label(target).alias("target")).agg(aggregate(agg, y).cast("double").alias("value"))
    g = g.where("value > 0")
    if not self_loops:
        g = g.where("source <> target")
    g = g.orderBy(F.col("value").desc(), "source", "target")
    return g.limit(top) if top else g


def bubbles(df: DataFrame, name: str, x: str, y: str, size: str | None = None, agg: str = "sum", agg_x: str | None = None,
            color: str | None = None, time: str | None = None, grain: str = "month") -> DataFrame:
    """One bubble per label (and time step); x may use its own aggregation; a text colour is looked up per label."""
    keys = [label(name).alias("label")] + ([_axis(time, grain).alias("step")] if time else [])
    aggs = [aggregate(agg_x or agg, x).cast("double").alias("x"), aggregate(agg, y).cast("double").alias("y")]
    if size:
        aggs.append(aggregate(agg, size).cast("double").alias("size"))
    if color:
        aggs.append(F.min(color).alias("color"))
    out = df.groupBy(*keys).agg(*aggs).where("x is not null and y is not null")
    if color and time:  # colour belongs to the label, not to the step
        look = out.groupBy("label").agg(F.min("color").alias("color"))
        out = out.drop("color").join(look, "label")
    return out


def map_points(df: DataFrame, lat: str, lon: str, name: str, y: str, agg: str = "sum", color: str | None = None) -> DataFrame:
    """Values by coordinates; impossible coordinates are left out."""
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    aggs = [aggregate(agg, y).cast("double").alias("value")]
    if color:
            aggs.append(aggregate("avg" if re.search(RATE_LIKE, color, re.I) else agg, color).cast("double").alias("color"))
    return df.where(ok).groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon"), label(name).alias("name")).agg(*aggs)


def play_frames(df: DataFrame, time: str, x: str, y: str, agg: str = "sum", grain: str = "month", cumulative: bool = True, last: int | None = None) -> DataFrame:
    """Every category at every time step (of the ``last`` steps if given): running (default) or per step.

    Sums and counts run over the grouped cells.  Other aggregations are not additive over
    steps: min and max run as windows, and the average runs on its sum and count.
    """
    d = df.where(F.col(time).isNotNull()).select(bucket(time, grain).alias("step"), label(x).alias("label"), F.col(y).alias("_y"))
    if agg == "countd" and cumulative:  # a value counts from the first step it appears in
        d = d.where("_y is not null").groupBy("label", "_y").agg(F.min("step").alias("step"))
        cells = d.groupBy("step", "label").agg(F.count(F.lit(1)).cast("double").alias("s"), F.lit(1).alias("c"))
    else:
        parts = {"sum": (total("_y"), F.count("_y")), "avg": (total("_y"), F.count("_y")), "count": (F.count("_y"), F.lit(1)),
                 "min": (F.min("_y"), F.lit(1)), "max": (F.max("_y"), F.lit(1)), "countd": (F.count_distinct("_y"), F.lit(1))}[agg]
        cells = d.groupBy("step", "label").agg(parts[0].cast("double").alias("s"), parts[1].alias("c"))
    steps = df.where(F.col(time).isNotNull()).select(bucket(time, grain).alias("step")).distinct()
    # axis: the step list is bounded by the calendar; one array per category, then exploded
    axis = steps.agg(F.sort_array(F.collect_set("step")).alias("steps")).scalar()
    labels = df.select(label(x).alias("label")).distinct()
    recent = F.slice(axis, F.greatest(F.size(axis) - last + 1, F.lit(1)), last) if last else axis
    grid = labels.withColumn("step", F.explode(axis if cumulative else recent))
    full = grid.join(cells, ["label", "step"], "left")
    w = Window.partitionBy("label").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # calendar-bounded
    if cumulative:
        run = {"min": F.min, "max": F.max}.get(agg, F.sum)
        s, c = run("s").over(w), F.sum("c").over(w)
    else:
        s, c = F.col("s"), F.col("c")
    value = F.when(c > 0, s / c) if agg == "avg" else s
    return (full.withColumn("value", F.coalesce(value, F.lit(0.0)))
            .where(F.array_contains(recent, F.col("step"))).select("step", "label", "value"))


def grouped_table(df: DataFrame, by: str, ys: Sequence[str], agg: str = "sum") -> DataFrame:
    """Summary table with min-max heat per measure and a totals row (not for averages, minima, maxima)."""
    g = df.groupBy(label(by).alias(by)).agg(*[aggregate(agg, y).cast("double").alias(y) for y in ys])
    edge = g.agg(*[F.min(y).alias(f"lo_{y}") for y in ys], *[F.max(y).alias(f"hi_{y}") for y in ys])
    lo = {y: edge.select(f"lo_{y}").scalar() for y in ys}
    hi = {y: edge.select(f"hi_{y}").scalar() for y in ys}
    heat = {f"{y}_heat": F.when(hi[y] > lo[y], (F.col(y) - lo[y]) / (hi[y] - lo[y])).otherwise(F.lit(0.5)) for y in ys}
    body = g.withColumns(heat).withColumn("is_total", F.lit(False))
    if agg in ("avg", "min", "max"):
        return body
    foot = g.agg(*[F.sum(y).alias(y) for y in ys]).withColumn(by, F.lit("Total"))
    foot = foot.withColumns({f"{y}_heat": F.lit(None).cast("double") for y in ys}).withColumn("is_total", F.lit(True))
    return body.unionByName(foot)


def filter_options(df: DataFrame, c: str, limit: int | None = None) -> DataFrame:
    """Distinct non-null values for a filter list, in order; all of them unless a limit is given."""
    values = df.where(F.col(c).isNotNull()).select(F.col(c).alias("value")).distinct().orderBy("value")
    return values.limit(limit) if limit else values


def chart_facts(points: DataFrame, time: bool) -> DataFrame:
    """The facts a caption needs from (label, value): trend and extremes of a time chart, or leaders of a category chart."""
    p = points.where("value is not null")
    if time:
        return p.agg(
            F.min_by("value", "label").alias("first"), F.max_by("value", "label").alias("last"),
            F.max("value").alias("_hi"), F.min("value").alias("_lo"),
            F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"),
            F.min_by("label", F.struct(-F.col("value"), F.col("label"))).alias("peak"),
            F.min_by("label", F.struct(F.col("value"), F.col("label"))).alias("low"),
        ).select("first", "last", change("last", "first").alias("trend"), "peak", F.col("_hi").alias("peak_value"),
                 "low", F.col("_lo").alias("low_value"), "points", "total")
    return p.agg(
        F.min_by("label", F.struct(-F.col("value"), F.col("label"))).alias("top"), F.max("value").alias("top_value"),
        F.max_by("label", F.struct(-F.col("value"), F.col("label"))).alias("bottom"), F.min("value").alias("bottom_value"),
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("count"),
    ).withColumn("top_share", F.when(F.col("total") != 0, F.col("top_value") / F.col("total")))


def running_totals(df: DataFrame, day: str, x: str, y: str, grain: str = "month") -> DataFrame:
    """Running total per category over calendar steps."""
    cells = df.groupBy(label(x).alias("label"), bucket(day, grain).alias("step")).agg(total(y).alias("value"))
    w = Window.partitionBy("label").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("running", F.sum("value").over(w))


def top_k(df: DataFrame, value: str, key: Sequence[str], k: int) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), *key).limit(k)


def layered(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two (label, value) charts on one axis: the union of their labels."""
    a = first.select("label", F.col("value").alias("value_a"))
    b = second.select("label", F.col("value").alias("value_b"))
    return a.join(b, "label", "full_outer")


def period_movers(df: DataFrame, day: str, x: str, y: str, cur: Days, prev: Days) -> DataFrame:
    """Change per category between two periods; a category missing on one side counts as 0."""
    part = split_periods(df, day, {"cur": cur, "prev": prev}).where(F.col(y).isNotNull())
    sums = part.groupBy(label(x).alias("label")).agg(
        total(F.when(F.col("period") == "cur", F.col(y))).alias("cur"),
        total(F.when(F.col("period") == "prev", F.col(y))).alias("prev"),
    )
    return sums.withColumn("delta", F.col("cur") - F.col("prev")).withColumn("relative", F.when(F.col("prev") != 0, F.col("delta") / F.col("prev")))

